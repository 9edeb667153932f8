"""The registered queries of the operators, with production parameters, and their SQL where SQL can say it."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontam, mixing, ngram_join, pii, secrets, sharding, suffix_tree, toxicity, url_filter
from .common import table

MAX_TRAINING_ROWS = 3000
GRADES = 4
WEIGHTS = [3.0, 1.0, 2.0]
SHARDS = 16
LISTED_HOSTS = 200_000
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@functools.cache
def tagger() -> pii.Tagger:
    """The tagger of op1, which depends on nothing but its code: trained once in a session."""
    return pii.train(pii.training_spans())


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), tagger())


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, 1.5, 2.0, SHARDS)
    each = lambda f: F.array_join(F.transform("draws", lambda d: d[f].cast("string")), ",")
    return got.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("copies"), each("shard").alias("shards"), each("position").alias("positions"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.OrdinalModel:
    """Fits on at most MAX_TRAINING_ROWS labelled rows; the rows weigh as their class does among all labels."""
    sample = toxicity.training_sample(docs, labels, MAX_TRAINING_ROWS)
    toxic = sample.label
    share = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0] or 0.0
    own = toxic.mean() if len(toxic) else 0.5
    weight = toxic * (share / max(own, 1e-9)) + (1 - toxic) * ((1 - share) / max(1 - own, 1e-9))
    return toxicity.OrdinalModel.fit(sample, toxicity.severities(sample, GRADES), n_grades=GRADES, weight=weight)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def blocked_hosts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The hosts of the pages, without www, m and blog before them, that call themselves spam, and LISTED_HOSTS made by rule."""
    seen = pages.select(F.regexp_extract(F.lower("url"), r"^[^:]*://(?:(?:www|m|blog)\.)*(spam[^/?#]*)", 1).alias("host")).where("host <> ''")
    return seen.unionByName(spark.range(LISTED_HOSTS).select(F.format_string("ads%06d.invalid", "id").alias("host"))).distinct()


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, RULES, blocked_hosts(spark, pages))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mix, op3_shard, op4_decontaminate, op5_toxicity, op6_ngram_join, op7_embedding_dedup, op8_url_filter, op9_lm_score, op10_secrets)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_shard": """
WITH RECURSIVE rest AS (
  SELECT i, i AS r, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM rest WHERE k < 8),
t AS (SELECT list(r ORDER BY i) AS t FROM rest WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
z AS (
  SELECT doc_id, strlen(text) + 1 AS size,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]))) AS crc
  FROM d, t),
a AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS whole FROM z),
s AS (SELECT *, least(15, floor((upto - size / 2) * 16 / whole))::INT AS shard FROM a)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
""",
    "op6_ngram_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.k >= 85 * (x.n + y.n - o.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS m FROM v
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.m > 0 AND b.m > 0 AND list_inner_product(a.v, b.v) / (a.m * b.m) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.k, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
""",
    "op8_url_filter": f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (
  SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, substr(regexp_extract(r, '^[^?#]*'), length(regexp_extract(r, '^[^/?#]*')) + 1) AS path FROM u),
k (verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT p.page_id, k.host || k.path AS rule, k.verdict FROM p JOIN k ON (p.host = k.host OR ends_with(p.host, '.' || k.host)) AND starts_with(p.path, k.path)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id),
h AS (SELECT DISTINCT regexp_extract(lower(url), '^[^:]*://(?:(?:www|m|blog)\\.)*(spam[^/?#]*)', 1) AS h FROM pages),
s AS (SELECT DISTINCT p.page_id FROM p JOIN h ON h.h <> '' AND (p.host = h.h OR ends_with(p.host, '.' || h.h)))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN s.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN b USING (page_id) LEFT JOIN s USING (page_id)
""",
}
