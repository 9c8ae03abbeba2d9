"""The corpus queries, opN_<name>, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hnsw, html, jaccard, lm, mixing, suffix, tokens, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_bytes(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


def op7_embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_copies(table(spark, sf_dir, "embeddings"), least=0.98)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), keys=["doc_id"], columns=["text"], rule="first")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 3) AS INTEGER) AS bucket FROM documents),
s AS (SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, source_size / weight AS ratio FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY ratio, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, max(level) OVER () * weight) END AS target FROM l),
e AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END), 3) AS whole FROM t),
b AS (SELECT none, src, bucket, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY none, src ORDER BY bucket) AS upto FROM d GROUP BY none, src, bucket),
c AS (SELECT b.none, b.src, max(bucket) FILTER (WHERE upto - words / 2 <= target - whole * source_size AND target > whole * source_size AND whole < 3) AS cut FROM b JOIN e USING (none, src) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN bucket <= coalesce(cut, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e USING (none, src) JOIN c USING (none, src)"""

#: All windows of 100 bytes, as hexadecimal digits; those that also start earlier are joined to spans and cut out.
_OP3 = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(len(h) // 2 - 99)) AS p, unnest(list_transform(range(len(h) // 2 - 99), lambda i: md5_number(substr(h, 2 * i + 1, 200)))) AS s FROM b WHERE len(h) >= 200),
f AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= prior + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prior FROM f)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE substr(h, 1, 2 * a[1]) || array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(h, 2 * z[i] + 1, 2 * (coalesce(a[i + 1], len(h) // 2) - z[i]))), '') END)) AS kept_sha256
FROM b LEFT JOIN l USING (doc_id)"""

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY ALL"""

_OP7 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM e UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB over whole tables, where it can express a query and is quick enough."""
    return {"op1_mixing": _OP1, "op3_suffix_dedup": _OP3, "op4_warc": _OP4, "op5_jaccard_join": _OP5, "op7_embedding_near_copies": _OP7}
