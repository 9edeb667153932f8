"""The pattern catalog and other constant tables. Fixed values, in natural order."""

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_STREET = r"Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Way|Place|Pl"

#: type, variant, pattern, confidence, needs context, any case
PATTERNS = [
    ("SSN", "dashed", r"\b(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.92, False, False),
    ("SSN", "spaced", r"\b(?!000|666)\d{3}\s(?!00)\d{2}\s(?!0000)\d{4}\b", 0.88, False, False),
    ("SSN", "bare", r"\b(?!000|666)\d{9}\b", 0.50, True, False),
    ("SSN", "partial", r"\b(?:SSN|Social\s+Security(?:\s+Number)?)\s*(?:last\s+(?:4|four)\s+digits\s*|ending\s+(?:in\s+)?|no\.?\s*)?\(?\d{4}\)?\b", 0.88, False, True),
    ("SSN", "last_digits", r"\b(?:last\s+(?:4|four)\s+digits|ending\s+in)\s*\(\d{4}\)", 0.75, True, True),
    ("EMAIL", "standard", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.95, False, False),
    ("PHONE", "international", r"(?<!\w)\+\d{1,3}[\s\-.]?(?:\(?\d{1,4}\)?[\s\-.]?)?(?:\d{1,4}[\s\-.]?){2,5}\d{1,4}\b", 0.92, False, False),
    ("PHONE", "pl", r"(?<!\w)\+48[\s\-.]?\d{3}[\s\-.]?\d{3}[\s\-.]?\d{3,4}\b", 0.92, False, False),
    ("PHONE", "fr", r"(?<!\w)\+33[\s\-.]?[1-9](?:[\s\-.]?\d{2,4}){2,4}\b", 0.92, False, False),
    ("PHONE", "uk", r"(?:(?<!\w)\+44[\s\-.]?|\b0)\d{2,4}[\s\-.]?\d{3,4}[\s\-.]?\d{3,4}\b", 0.85, False, False),
    ("PHONE", "us", r"(?:(?<!\w)\+1[\s\-.]?|\b)\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b", 0.82, False, False),
    ("PHONE", "in", r"(?:(?<!\w)\+91[\s\-]?|\b0|\b)[6-9]\d{4}[\s\-]?\d{5}\b", 0.82, False, False),
    ("PAN", "holder", r"\b[A-Z]{3}[PCHATBLJFG][A-Z]\d{4}[A-Z]\b", 0.90, False, False),
    ("PAN", "relaxed", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.75, True, False),
    ("AADHAAR", "spaced", r"\b[2-9]\d{3}\s\d{4}\s\d{4}\b", 0.88, False, False),
    ("AADHAAR", "dashed", r"\b[2-9]\d{3}-\d{4}-\d{4}\b", 0.88, False, False),
    ("AADHAAR", "bare", r"\b[2-9]\d{11}\b", 0.50, True, False),
    ("PASSPORT", "prefixed", r"\b(?:TK|C)\d{7}\b", 0.92, False, False),
    ("PASSPORT", "letters", r"\b[A-Z]{1,2}[0-9]{7,9}\b", 0.75, True, False),
    ("PASSPORT", "digits", r"\b\d{9}\b", 0.40, True, False),
    ("PESEL", "digits", r"\b(?:PESEL\s*:?\s*)?(\d{11}|\d{6}[xX]{5})\b", 0.92, False, True),
    ("PESEL", "cue", r"\bPESEL\s*:?\s*[0-9A-Za-z]{6,12}\b", 0.90, False, True),
    ("CARD", "issuer", r"\b(?:4\d{3}|5[1-5]\d{2}|6011|622[1-9]|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.92, False, False),
    ("CARD", "separated", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b", 0.80, False, False),
    ("CARD", "partial", r"\b(?:card|credit\s+card|debit\s+card|visa|mastercard|amex)\s+(?:ending\s+(?:in\s+)?|no\.?\s*|#\s*)?\d{4}\b", 0.88, False, True),
    ("CARD", "ending", r"\bending\s+(?:in\s+)?\d{4}\b", 0.75, True, True),
    ("EMPLOYEE_ID", "emp", r"\bEMP[-\s]?\d{4,8}\b", 0.90, False, True),
    ("EMPLOYEE_ID", "short", r"\bE\d{5,7}\b", 0.65, True, False),
    ("DIRECTOR_ID", "din", r"\b(?:DIN|DIR)[-\s]?\d{4,8}\b", 0.90, False, True),
    ("DOB", "dmy", r"\b(?:0[1-9]|[12]\d|3[01])[/\-.](?:0[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b", 0.65, True, False),
    ("DOB", "iso", r"\b(?:19|20)\d{2}[/\-.](?:0[1-9]|1[0-2])[/\-.](?:0[1-9]|[12]\d|3[01])\b", 0.65, True, False),
    ("DOB", "month_first", rf"\b(?:{_MONTHS})\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b", 0.60, True, True),
    ("DOB", "day_first", rf"\b\d{{1,2}}\s+(?:{_MONTHS})\s+(?:19|20)\d{{2}}\b", 0.60, True, True),
    ("IFSC", "code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.85, False, False),
    ("GST", "number", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b", 0.92, False, False),
    ("UPI", "handle", r"\b[\w.]+@(?:upi|paytm|ybl|oksbi|okaxis|okhdfcbank|okicici|apl|ibl)\b", 0.90, False, True),
    ("BANK_ACCOUNT", "digits", r"\b\d{9,18}\b", 0.30, True, False),
    ("BANK_ACCOUNT", "partial", r"\b(?:savings\s+account|checking\s+account|bank\s+account|savings|checking|account)\s+(?:ending\s+(?:in\s+)?|no\.?\s*|#\s*)?\d{4}\b", 0.88, False, True),
    ("NINO", "number", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.88, False, False),
    ("TAX_ID", "ein", r"\b\d{2}-\d{7}\b", 0.60, True, False),
    ("ADDRESS", "street", rf"\b\d{{1,5}}\s+(?:[A-Za-z0-9.]+\s+){{1,4}}(?:{_STREET})\.?(?:,\s*(?:Suite|Ste|Apt|Unit|Floor|Fl)\s*[A-Za-z0-9\-]+)?\b", 0.88, False, True),
]

#: By pattern, what every match of it holds; a text without it needs no search. Patterns of other catalogs have no entry.
SIGNS = {p: "@" if kind in ("EMAIL", "UPI") else "(?iuU)pesel" if variant == "cue" else r"(?U)\d" for kind, variant, p, *_ in PATTERNS}

ALLOWED = [r"\bINC[-\s]?\d{4}[-\s]?\d+\b", r"\bRSK[-\s]?\d+\b", r"\bGRP[-\s]?POL[-\s]?\d+\b", r"\bCTL[-\s]?IAM[-\s]?\d+\b", r"\bREQ[-\s]?\d+\b", r"\bAUDIT[-\s]?\d+\b", r"\bVEN[-\s]?\d+\b", r"\bTPRM[-\s]?\d+\b", r"\bPOL[-\s]?\d+\b", r"\bCTL[-\s]?\d+\b", r"\bISO[-\s]?\d{4,5}(?::\d{4})?\b", r"\bNIST[-\s]?\w+[-\s]?\d+\b"]
#: Values that resolution drops.
RESOLVER_ALLOWED = [r"\bINC[-\s]?\d{4}[-\s]?\d+\b", r"\bRSK[-\s]?\d+\b", r"\bGRP[-\s]?POL[-\s]?\d+\b", r"\bCTL[-\s]?IAM[-\s]?\d+\b", r"\bISO[-\s]?\d{4,5}(?::\d{4})?\b", r"\bNIST[-\s]?\w+[-\s]?\d+\b"]
TABLE_HEADERS = ["employee name", "employee id", "risk code", "control id", "policy title", "reviewer", "status", "department", "business unit", "role", "users", "approver", "condition", "trigger"]
CUES = {
    "SSN": ["ssn", "social security", "ss#", "ss no", "soc sec"],
    "AADHAAR": ["aadhaar", "aadhar", "uid", "unique id", "unique identification"],
    "PASSPORT": ["passport", "travel document", "travel doc"],
    "DOB": ["dob", "date of birth", "born", "birth date", "birth day", "d.o.b"],
    "BANK_ACCOUNT": ["account no", "a/c", "bank account", "account number", "savings", "current account", "acct"],
    "TAX_ID": ["tin", "tax id", "tax identification", "ein", "employer id"],
    "EMPLOYEE_ID": ["employee", "emp id", "staff no", "employee number"],
    "PAN": ["pan", "permanent account", "pan card", "pan no"],
    "DIRECTOR_ID": ["din", "director id", "director identification", "dir no"],
    "PESEL": ["pesel", "polish national id", "national id", "polish id"],
}
#: type, risk, specificity
TYPES = [
    ("SSN", "CRITICAL", 1), ("PASSPORT", "CRITICAL", 2), ("PAN", "CRITICAL", 3), ("AADHAAR", "CRITICAL", 4), ("PESEL", "CRITICAL", 5), ("NATIONAL_ID", "CRITICAL", 5),
    ("CARD", "CRITICAL", 6), ("NINO", "CRITICAL", 7), ("EMAIL", "HIGH", 10), ("PHONE", "HIGH", 11), ("EMPLOYEE_ID", "HIGH", 12), ("DIRECTOR_ID", "HIGH", 13), ("DOB", "HIGH", 14),
    ("BANK_ACCOUNT", "HIGH", 15), ("TAX_ID", "HIGH", 16), ("IFSC", "MEDIUM", 20), ("GST", "MEDIUM", 21), ("UPI", "MEDIUM", 22), ("ADDRESS", "HIGH", 25), ("PERSON", "HIGH", 30),
    ("SIGNATURE", "HIGH", 40), ("FACE_PHOTO", "HIGH", 41), ("SENSITIVE_SCREENSHOT", "HIGH", 42),
]
#: Values that the policy lets through.
POLICY_ALLOWED = [r"\bINC-\d{4}-\d{1,6}\b", r"\bRSK-\d{1,6}\b", r"\bGRP-POL-\d{1,6}\b", r"\bCTL-IAM-\d{1,6}\b"]
RISKS = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: tier, types, least confidence, action when sure, action when not
POLICY = [
    ("CRITICAL", ["SSN", "PASSPORT", "PAN", "AADHAAR", "CARD", "NINO", "TAX_ID"], 0.50, "REDACT", "BLOCK"),
    ("HIGH", ["PERSON", "EMAIL", "PHONE", "ADDRESS", "DOB", "EMPLOYEE_ID", "DIRECTOR_ID", "BANK_ACCOUNT", "SIGNATURE", "FACE_PHOTO", "SENSITIVE_SCREENSHOT"], 0.70, "REDACT", "REDACT"),
    ("MEDIUM", ["IFSC", "GST", "UPI"], 0.80, "REDACT", "REDACT"),
]
INJECTIONS = [
    r"(?i)\bignore\s+(all\s+)?(previous|above|prior)\s+(instructions|directives|rules|prompts)\b",
    r"(?i)\bdisregard\s+(all\s+)?(previous|above|prior)\s+(instructions|directives)\b",
    r"(?i)\byou\s+are\s+now\s+(in\s+developer\s+mode|dan|an\s+unrestricted\s+ai)\b",
    r"(?i)\bsystem\s+prompt\s*(override|bypass|injection)\b",
    r"(?i)\bnew\s+system\s+instruction(s)?:\b",
    r"(?i)\bdo\s+not\s+redact\b",
    r"(?i)\breveal\s+(all\s+)?(pii|personal\s+data|secrets|credentials|passwords)\b",
    r"(?i)<\s*(system|assistant|instruction|prompt)\s*>",
    r"\[\s*(system|instruction|prompt)\s*\]",
    r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>",
    r"\[INST\]|\[/INST\]",
]
HIDDEN = ["‮", "‭", "​", "‌", "‍", "﻿", "⁠", "­"]
