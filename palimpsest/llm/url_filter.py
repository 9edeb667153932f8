"""URL filters over a sorted array of 64-bit digests: memory-mapped, probed by binary search, confirmed by string."""

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, small_batches


class DigestArray:
    """Sorted xxhash64 digests of keys, each with its full string, in one flat file image.

    Layout: count (8 bytes); digests, ascending (8 each); offsets into the strings (8 each, count + 1); the UTF-8
    strings. Equal digests of different strings stand side by side and are told apart by the strings.
    """

    def __init__(self, image):
        self.n = int(np.frombuffer(image, np.int64, 1)[0])
        self.digests = np.frombuffer(image, np.uint64, self.n, 8)
        self.offsets = np.frombuffer(image, np.int64, self.n + 1, 8 + 8 * self.n)
        self.base = 16 + 16 * self.n
        self.image = image

    @staticmethod
    def build(keys) -> bytes:
        rows = sorted({(xxhash.xxh64_intdigest(k.encode()), k) for k in keys})
        blob = [k.encode() for _, k in rows]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        return np.int64(len(rows)).tobytes() + np.array([d for d, _ in rows], np.uint64).tobytes() + offsets.tobytes() + b"".join(blob)

    @classmethod
    def mapped(cls, image: bytes) -> "DigestArray":
        """Maps the image from a file that is unlinked at once, so that a worker's pages can be dropped and reread."""
        fd, path = tempfile.mkstemp(prefix="digests-")
        try:
            with os.fdopen(fd, "r+b") as f:
                f.write(image)
                f.flush()
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        finally:
            os.unlink(path)

    def key(self, i: int) -> bytes:
        return bytes(self.image[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])])

    def find(self, keys: list[str]) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not keys:
            return out
        enc = [k.encode() for k in keys]
        probe = np.array([xxhash.xxh64_intdigest(k) for k in enc], np.uint64)
        at = np.searchsorted(self.digests, probe)
        for i in np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == probe):
            j = int(at[i])
            while j < self.n and self.digests[j] == probe[i]:
                if self.key(j) == enc[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    if url is None:
        return "", ""
    cut = url.find("://")
    if cut < 0:
        return "", ""
    rest = url[cut + 3 :]
    end = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    slash = rest.find("/")
    host_end = min(end, slash) if slash >= 0 else end
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:host_end])
    return host, rest[host_end:end]


def suffixes(host: str, longest: int) -> list[str]:
    """The host's suffixes at label borders that have at most `longest` characters: none else can be in a list."""
    out, at = [], len(host)
    while host and at >= 0:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 > longest:
            break
        out.append(host[at + 1 :])
    return out


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    blocked_hosts: DataFrame | list[str] = (),
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Judges every url by the longest rule that fits, else by the list of blocked hosts, else `default`.

    rules: (verdict, 'host/path'); a rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest rule string wins (same length: the longer host). blocked_hosts, a list or the first column of
    a table, block the host and all subdomains. Keys of both live in digest arrays; each url probes them with its
    host's suffixes, of which none is longer than the longest host listed, joined to prefixes of its path no longer
    than the longest rule's. Keys are dealt by a hash into blocks of about block_bytes, each its own array and pass
    over the urls, so lists of any size do; what the passes find is merged by row. Returns
    (id, host, path, rule, verdict). Null or malformed urls have empty host and path and get the default. Null ids
    pass through, repeated rows give repeated rows, an empty table none; null or empty hosts in the list do nothing.
    """
    spark = pages.sparkSession
    small_batches(spark, 10000)
    verdict_of = {k: v for v, k in rules}
    keys = spark.createDataFrame([(k,) for k in verdict_of], "k string")
    if isinstance(blocked_hosts, DataFrame):
        hosts = blocked_hosts.select(F.col(blocked_hosts.columns[0]).cast("string").alias("k"))
    else:
        hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "k string")
    keys = keys.unionByName(hosts.where("k <> '' and not contains(k, '/')")).distinct()
    host = F.substring_index("k", "/", 1)
    size = keys.agg(F.sum(F.octet_length("k") + 40).alias("bytes"), F.max(F.length(host)).alias("host")).first()
    blocks = -(-(size["bytes"] or 0) // block_bytes) or 1
    longest = size["host"] or 0
    lengths = sorted({len(k) - k.index("/") for k in verdict_of}, reverse=True)
    if blocks > 1:
        keys = durable(keys)
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    for k in range(blocks):
        part = keys.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == k).toArrow().column(0).to_pylist()  # about block_bytes
        judged = _pass(judged, spark.sparkContext.broadcast(DigestArray.build(part)), lengths, longest, k)
    best, listed = F.lit(None).cast("string"), F.lit(False)
    weight = lambda c: F.struct(F.length(c), F.length(F.substring_index(c, "/", 1)))
    for k in range(blocks):
        rule = F.col(f"rule{k}")
        best = F.when(best.isNull() | (rule.isNotNull() & (weight(rule) > weight(best))), rule).otherwise(best)
        listed = listed | F.col(f"listed{k}")
    judged = judged.select("id", "host", "path", best.alias("rule"), listed.alias("listed"))
    verdict = F.when(F.col("listed"), "block").otherwise(default)
    for v in {v for v, _ in rules}:
        verdict = F.when(F.col("rule").isin([k for k, x in verdict_of.items() if x == v]), v).otherwise(verdict)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def _pass(df: DataFrame, shared, lengths: list[int], longest: int, k: int) -> DataFrame:
    """Adds the best rule among the keys of one digest array and whether it lists the host; first splits the urls."""
    fields = T.StructType.fromDDL(f"rule{k} string, listed{k} boolean").fields
    if k == 0:
        schema = T.StructType([df.schema["id"], *T.StructType.fromDDL("host string, path string").fields, *fields])
    else:
        schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        index = DigestArray.mapped(shared.value)
        for b in batches:
            if k == 0:
                split = [split_url(url) for url in b.column(1).to_pylist()]
                hosts, paths = [h for h, _ in split], [p for _, p in split]
                columns = [b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string())]
            else:
                hosts, paths, columns = b.column(1).to_pylist(), b.column(2).to_pylist(), b.columns
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                ends = suffixes(host, longest)
                probes += ends
                for n in (n for n in lengths if n <= len(path)):
                    probes += [x + path[:n] for x in ends]
                owner += [i] * (len(probes) - len(owner))
            best: list[str | None] = [None] * len(hosts)
            listed = [False] * len(hosts)
            for at in np.flatnonzero(index.find(probes) >= 0):
                i, key = owner[at], probes[at]
                if "/" not in key:
                    listed[i] = True
                elif best[i] is None or (len(key), key.index("/")) > (len(best[i]), best[i].index("/")):
                    best[i] = key
            yield pa.record_batch([*columns, pa.array(best, pa.string()), pa.array(listed)], names=schema.names)

    return df.mapInArrow(run, schema)
