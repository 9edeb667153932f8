"""Secret scans with a recursive decoding worklist."""

import base64
import binascii
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .spans import SECRET_KINDS, digest, joined, ordered, secret_spans

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HAS_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16}")
#: A line of base64 after another one: a break, also a written-out one, and the run that follows.
NEXT = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+)")
BEFORE = re.compile(r"[A-Za-z0-9+/_-]+(?=[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*\Z)")
#: No secret, however encoded, is shorter than this; other bytes that are not text hold none.
PRINTABLE = re.compile(rb"[\t\n\r -~]{16}")
#: Bytes of contents inflated at a time, and looked at to tell whether they are compressed again.
STEP = 1 << 16
#: Levels of compressed data in compressed data that have several members or contents of many megabytes.
LEVELS = 100
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


LOST = re.compile("[\udc80-\udcff]")


class Layer:
    """A text, and for each of its characters the range of the original text that it comes from; or one range for all."""

    def __init__(self, text: str, starts=None, ends=None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def origin(self, i: int, j: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return i, j
        return min(self.starts[i:j]), max(self.ends[i:j])


def _utf8(data: bytes) -> tuple[str, list[int]]:
    """Decoded text, each invalid byte a U+FFFD, and the byte at which each character starts, with one more for the end."""
    text = data.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text, list(range(len(text) + 1))
    at = [0]
    for c in text:
        at.append(at[-1] + (1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4))
    return LOST.sub("\ufffd", text), at


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[int], list[int]]]) -> Layer:
    """The layer with ranges replaced; the new characters come with ranges in the layer's own offsets."""
    if layer.whole:
        cuts = zip([0, *[j for _, j, *_ in pieces]], [*[i for i, *_ in pieces], len(layer.text)], [*[new for _, _, new, *_ in pieces], ""])
        return Layer("".join(layer.text[i:j] + new for i, j, new in cuts), whole=layer.whole)
    text, starts, ends, done = [], [], [], 0
    for i, j, new, a, b in pieces:
        text.append(layer.text[done:i])
        starts += range(done, i)
        ends += range(done + 1, i + 1)
        text.append(new)
        starts += a
        ends += b
        done = j
    text.append(layer.text[done:])
    starts += range(done, len(layer.text))
    ends += range(done + 1, len(layer.text) + 1)
    if layer.starts is not None:
        pairs = [layer.origin(a, b) for a, b in zip(starts, ends)]
        starts, ends = [p[0] for p in pairs], [p[1] for p in pairs]
    return Layer("".join(text), starts, ends)


def _percent(layer: Layer) -> Layer | None:
    pieces = []
    for m in PERCENT.finditer(layer.text):
        new, at = _utf8(binascii.unhexlify(m.group().replace("%", "")))
        pieces.append((m.start(), m.end(), new, [m.start() + 3 * k for k in at[:-1]], [m.start() + 3 * k for k in at[1:]]))
    return _replaced(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    pieces, high = [], None
    for m in UNICODE.finditer(layer.text):
        code = int(next(g for g in m.groups() if g is not None), 16)
        if 0xD800 <= code < 0xDC00:
            high = (m, code)
        elif 0xDC00 <= code < 0xE000:
            if high and high[0].end() == m.start():
                pieces.append((high[0].start(), m.end(), chr(0x10000 + ((high[1] - 0xD800) << 10) + code - 0xDC00), [high[0].start()], [m.end()]))
        elif code < 0x110000:
            pieces.append((m.start(), m.end(), chr(code), [m.start()], [m.end()]))
    return _replaced(layer, pieces) if pieces else None


def _packed(data: bytes) -> int | None:
    """The wbits with which zlib inflates what begins so; None for other data."""
    if data[:2] == b"\x1f\x8b":
        wbits = 31
    elif data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        wbits = 15
    else:
        return None
    try:
        zlib.decompressobj(wbits).decompress(data[:STEP], STEP)
    except zlib.error:
        return None
    return wbits


def _fed(d, source) -> Iterator[bytes]:
    """What one compressed member holds, and into source, a list with the rest and an iterator, what follows it."""
    while not d.eof:
        if not source[0] and not (rest := next(source[1], b"")):
            yield d.flush()
            return
        try:
            out = d.decompress(source[0] or rest, STEP)
        except zlib.error:
            source[:] = [b"", iter(())]
            return
        source[0] = d.unused_data if d.eof else d.unconsumed_tail
        yield out


def _unpacked(head: bytes, more: Iterator[bytes], above: frozenset) -> Iterator[bytes]:
    """The contents of gzip or zlib members in bounded steps, one member after the other, and of what is compressed in them.

    above: digests of what this was found in, by which data that hold themselves end; beyond LEVELS of them
    data stay packed. What follows the last member
    comes as it is.
    """
    source = [head, more]
    while True:
        while len(source[0]) < STEP and (rest := next(source[1], b"")):
            source[0] += rest
        key = hashlib.blake2b(source[0][:STEP], digest_size=16).digest()
        wbits = None if key in above or len(above) > LEVELS else _packed(source[0])
        if wbits is None:
            yield source[0]
            yield from source[1]
            return
        inside = _fed(zlib.decompressobj(wbits), source)
        yield from _unpacked(b"", (x for x in inside if x), above | {key})
        if not source[0]:
            source[0] = next(source[1], b"")
            if not source[0]:
                return


def _useful(data: bytes) -> bool:
    """Whether bytes are text, or hold a part that could be a secret."""
    if not data:
        return False
    if PRINTABLE.search(data):
        return True
    try:
        return not CONTROL.search(data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _windows(data: bytes, place: tuple[int, int], most: int) -> Iterator[Layer]:
    """The contents of compressed data as layers of about `most` bytes, each with the last sixteenth of the one before."""
    known: set = set()  # members alone in their data are unwrapped here, however many levels there are
    while (key := hashlib.blake2b(data, digest_size=16).digest()) not in known and (wbits := _packed(data)):
        known.add(key)
        d = zlib.decompressobj(wbits)
        try:
            out = d.decompress(data, most + 1)
        except zlib.error:
            break
        if len(out) > most or not d.eof or d.unused_data:
            break
        data = out
    held, size, old = [], 0, 0
    for part in itertools.chain(_unpacked(data, iter(()), frozenset()), [None]):
        if part is not None:
            held.append(part)
            size += len(part)
        if size >= most or part is None and size > old:
            whole = b"".join(held)
            if _useful(whole):
                yield Layer(LOST.sub("\ufffd", whole.decode("utf-8", "surrogateescape")), whole=place)
            held = [whole[-(most // 16) :]]
            size = old = len(held[0])


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of base64 that follow one another over line breaks, at least one of 16; each run of 16 or more also alone.

    Where no = ends the last run, a word that begins the next line is taken for more of it: rather too much than a cut.
    """
    done = 0
    for m in BASE64.finditer(text):
        end = m.start() + len(m.group().rstrip("="))
        yield [(m.start(), end)]
        if m.start() < done:
            continue
        lines, done = [(m.start(), end)], m.end()
        start = m.start()
        head = BEFORE.search(text, max(0, start - 120), start) if start and text[start - 1] in " \t\r\nn" else None
        if head:
            lines.insert(0, head.span())
        while end == done and (n := NEXT.match(text, done)):
            lines.append(n.span(1))
            end = done = n.end()
        if len(lines) > 1:
            yield lines


def _base64(layer: Layer, most: int) -> list:
    """What base64 in the layer decodes to: layers, and iterators of the layers of compressed contents."""
    out = []
    for lines in _blocks(layer.text):
        body = "".join(layer.text[i:j] for i, j in lines).replace("-", "+").replace("_", "/")
        at = lines[0][0] if len(lines) == 1 else [x for i, j in lines for x in range(i, j)]
        known, first = {}, 0  # for each of the four ways to cut the runs into fours: where it begins, and the bytes
        for i, j in lines:
            if first % 4 not in known:
                tail = body[first:]
                tail = tail[: len(tail) - (len(tail) % 4 == 1)]
                known[first % 4] = first, base64.b64decode(tail + "=" * (-len(tail) % 4))
                out += _plain(layer, at, *known[first % 4])
            begin, data = known[first % 4]
            offset = (first - begin) // 4 * 3
            if data[offset : offset + 1] in (b"\x1f", b"\x78") and _packed(data[offset : offset + STEP]):
                out.append(_windows(data[offset:], layer.origin(i, lines[-1][1]), most))
            first += j - i
    return out


def _plain(layer: Layer, at, begin: int, data: bytes) -> list[Layer]:
    """The layer of decoded bytes; at: the places of the base64 in the layer, or the first one; begin: the first one used."""
    if not _useful(data):
        return []
    text, cut = _utf8(data)
    if layer.whole:
        return [Layer(text, whole=layer.whole)]
    last = (len(data) - 1) // 3 * 4 + (len(data) - 1) % 3 + 1
    place = (lambda k: at + begin + k) if isinstance(at, int) else (lambda k: at[begin + k])
    starts = [place(k // 3 * 4 + k % 3) for k in cut[:-1]]
    ends = [place(min(last, (k - 1) // 3 * 4 + (k - 1) % 3 + 1)) + 1 for k in cut[1:]]
    if layer.starts is not None:
        pairs = [layer.origin(a, b) for a, b in zip(starts, ends)]
        starts, ends = [p[0] for p in pairs], [p[1] for p in pairs]
    return [Layer(text, starts, ends)]


def scan(text: str, raw: bytes | None = None, most: int = 16 << 20) -> tuple[list, list, int]:
    """Base spans, spans that the layers add, and the number of layers.

    The worklist starts with the text. Each layer is rescanned and unwrapped in every way that applies; what
    comes out joins the worklist unless a layer with the same characters from the same place was seen (cycle
    detection), until the list is empty. Each unwrapping shortens what it unwraps, but for compressed data. Their
    contents, however large, are scanned in windows of about `most` bytes, which share a sixteenth; only a layer inside
    them that is longer than that may be cut. Base64 is joined over line breaks, and bytes that are not UTF-8 become
    U+FFFD. An added span overlaps no other span of its kind.
    """
    base = secret_spans(text, raw)
    blob = raw if raw is not None else text.encode("utf-8", "surrogatepass")
    if not (b"%" in blob or b"\\" in blob or HAS_BASE64.search(blob)):
        return base, [], 1
    work, seen, found, layers = [Layer(text)], set(), [], 0
    while work:
        layer = work[-1] if isinstance(work[-1], Iterator) else work.pop()
        if isinstance(layer, Iterator):  # its layers one by one, so that few are held
            if (layer := next(layer, None)) is None:
                work.pop()
                continue
        place = layer.origin(0, len(layer.text)) if layer.text else (0, 0)
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + str(place).encode(), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        if layer.starts is not None or layer.whole:
            found += [(*layer.origin(s, e), k) for s, e, k in secret_spans(layer.text)]
        if "%" in layer.text and (new := _percent(layer)):
            work.append(new)
        if "\\" in layer.text and (new := _unicode(layer)):
            work.append(new)
        work += _base64(layer, most)
    taken = {k: sorted((s, e) for s, e, kind in base if kind == k) for k in SECRET_KINDS}
    added = []
    for s, e, k in sorted(set(found), key=lambda x: (x[0] - x[1], x[0], SECRET_KINDS.index(x[2]))):
        own = taken[k]  # disjoint, so the last that begins before e ends last
        i = bisect.bisect_left(own, (e, 0))
        if i and own[i - 1][1] > s:
            continue
        own.insert(i, (s, e))
        added.append((s, e, k))
    return base, ordered(added, SECRET_KINDS), layers


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, layers int"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in every whole text, also inside nested encodings; one row out for each row in.

    Returns (id, n_assign, n_access, n_hex, base_sha256, spans, n_added, layers). Null and empty texts have no
    spans (the digest is then that of the empty string). Null ids and repeated rows pass through; an empty table
    gives none; other columns are ignored. Each row is judged alone, so a lost executor costs only its tasks.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(RESULT).fields])

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                base, added, layers = scan(raw.decode("utf-8", "replace"), raw)
                counts = [sum(k == kind for *_, k in base) for kind in SECRET_KINDS]
                rows.append((*counts, digest(base), joined(ordered(base + added, SECRET_KINDS)), len(added), layers))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.int32()]
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "layers"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
