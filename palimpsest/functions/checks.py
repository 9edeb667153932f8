"""Validators as columns: (status, delta) for a value of a type. Native expressions throughout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PAN_HOLDERS = "PCHATBLJFG"
KNOWN_TLDS = ["com", "org", "net", "edu", "gov", "mil", "int", "co", "io", "ai", "us", "uk", "in", "de", "fr"]
NINO_PREFIXES = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]
PESEL_WEIGHTS = [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy", "yyyy.M.d", "MMMM d, yyyy", "d MMMM yyyy", "MMMM d yyyy", "MMM d, yyyy", "d MMM yyyy", "MMM d yyyy"]
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def strip(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _each(d: Column) -> Column:
    return F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn_ok(d: Column) -> Column:
    doubled = F.transform(_each(d), lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _dihedral(a: int, b: int) -> int:
    """The product in the symmetry group of the pentagon: rotations are 0 to 4, reflections 5 to 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def verhoeff_ok(d: Column) -> Column:
    rows, p = [], list(range(10))
    for _ in range(8):
        rows.append(p)
        p = [VERHOEFF_STEP[x] for x in p]
    step = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    times = F.array(*[F.array(*[F.lit(_dihedral(a, b)) for b in range(10)]) for a in range(10)])
    moved = F.transform(_each(d), lambda x, i: F.get(F.get(step, i % 8), x))
    return F.aggregate(moved, F.lit(0), lambda c, x: F.get(F.get(times, c), x)) == 0


def pesel_ok(d: Column) -> Column:
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(PESEL_WEIGHTS)), F.lit(0))
    return (10 - total % 10) % 10 == F.substring(d, 11, 1).cast("int")


def entropy(v: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return -F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a + p * F.log2(p))


def date_of(v: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(strip(v), F.lit(f)) for f in DATE_FORMATS])


def validate(kind: Column, value: Column, this_year: int = 2025) -> Column:
    """struct(status, delta): PASS, FAIL or NOT_APPLICABLE, and what it adds to the confidence.

    this_year stands for today in the check of birth dates. Null values are not applicable.
    """
    d, up = digits(value), F.upper(strip(value))
    res = lambda ok, good, bad: F.struct(F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.when(ok, F.lit(good)).otherwise(F.lit(bad)).cast("double").alias("delta"))
    case = lambda status, delta: F.struct(F.lit(status).alias("status"), F.lit(float(delta)).alias("delta"))
    plain = F.regexp_replace(value, r"[\s-]", "")
    nino = F.regexp_replace(up, r"(?U)\s", "")
    year = F.year(date_of(value))
    email = strip(value).rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$")
    tld = F.element_at(F.split(F.lower(strip(value)), r"\."), -1)
    masked = F.regexp_replace(value, r"[\s:-]", "").rlike(r"\b[0-9]{6}[xX]{5}\b")
    ssn = (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 3) < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    state = F.substring(up, 1, 2).try_cast("int")
    return (
        F.when(value.isNull(), case("NOT_APPLICABLE", 0))
        .when(kind == "CARD", res(plain.rlike("^[0-9]{13,19}$") & luhn_ok(F.when(plain.rlike("^[0-9]+$"), plain).otherwise("1")), 0.05, -0.20))
        .when(kind == "AADHAAR", res((F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1") & verhoeff_ok(d), 0.05, -0.15))
        .when(kind == "PHONE", res(F.length(d).between(7, 15), 0.05, -0.10))
        .when((kind == "PESEL") & masked, case("PASS", 0.08))
        .when((kind == "PESEL") & (F.length(d) == 11) & pesel_ok(d), case("PASS", 0.10))
        .when((kind == "PESEL") & (F.length(d) == 11), case("PASS", 0.05))
        .when(kind == "PESEL", case("FAIL", -0.10))
        .when(kind == "PAN", res(up.rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$"), 0.05, -0.20))
        .when(kind == "SSN", res(ssn, 0.05, -0.25))
        .when((kind == "DOB") & year.isNull(), case("FAIL", -0.10))
        .when((kind == "DOB") & year.between(1900, 2010), case("PASS", 0.10))
        .when((kind == "DOB") & (year > 2010) & (year <= this_year), case("PASS", 0.05))
        .when(kind == "DOB", case("FAIL", -0.15))
        .when((kind == "EMAIL") & email, F.struct(F.lit("PASS").alias("status"), F.when(tld.isin(KNOWN_TLDS), 0.03).otherwise(0.0).alias("delta")))
        .when(kind == "EMAIL", case("FAIL", -0.10))
        .when(kind == "IFSC", res((F.length(up) == 11) & (F.substring(up, 5, 1) == "0"), 0.05, -0.15))
        .when((kind == "GST") & (F.length(up) == 15) & F.coalesce(state.between(1, 37), F.lit(False)), res(F.substring(up, 14, 1) == "Z", 0.05, -0.10))
        .when(kind == "GST", case("FAIL", -0.15))
        .when(kind == "NINO", res((F.length(nino) == 9) & ~F.substring(nino, 1, 2).isin(NINO_PREFIXES) & ~F.substring(nino, 1, 1).isin(list("DFIQUV")), 0.05, -0.15))
        .otherwise(case("NOT_APPLICABLE", 0))
    )
