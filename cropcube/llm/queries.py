"""Queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.llm import decontaminate as contamination
from cropcube.llm import html_text, licenses, mixing, ngram_join, quality, repeats, secrets, toxicity, url_rules


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM v),
o AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
), h AS (SELECT o.doc_id, o.i, o.m, v.item_id FROM o JOIN v ON v.m = o.m AND v.s = o.s),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""

def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), r(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by the contract; and words in passages of 50 words or more that stand elsewhere too, which may be shorter than 400 bytes."""
    out = repeats.repeated_spans(read(spark, sf_dir, "documents"), keep=["doc_id"], with_kept=False, passage=50)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passage_words", (F.col("n_passage_words") > 0).alias("repeats_passage")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.withColumn("base", F.expr("filter(spans, s -> s.is_base)"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in secrets.BASE]
    return out.select("doc_id", *count, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def _marked(rank: int, rule: secrets.Rule) -> str:
    """Of one rule: the parts of every text that has a match, cut at its matches; matches are the even ones."""
    pattern = secrets.exact(rule).replace("'", "''")
    size = f"length(regexp_extract(part, '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group}))" if rule.group else "length(part)"
    return (
        f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i, part, CASE WHEN i % 2 = 0 AND {size} >= {rule.least} THEN 1 ELSE 0 END AS hit FROM ("
        f"SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS x"
        f" FROM d WHERE regexp_matches(t, '{pattern}')))"
    )


OP8_SQL = (
    "WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS t FROM documents), p AS ("
    + " UNION ALL ".join(_marked(k, r) for k, r in enumerate((*secrets.BASE, *secrets.ADDED)))
    + "), m AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM p),"
    " s AS (SELECT doc_id, rank, kind, (e - length(part))::BIGINT AS a, kind || ':' || (e - length(part))::BIGINT || ':' || e::BIGINT AS said FROM m WHERE hit = 1),"
    " g AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    + f", string_agg(said, ',' ORDER BY a, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)"
    " SELECT d.doc_id, "
    + ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and the base rules of ``op10_quality``, which SQL can say; its verdict on the rest is a sum of logarithms."""
    return op10_quality(spark, sf_dir).drop("kept", "score")


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op3_mixing`` says beside the words it takes, which depend on hashes: sizes and targets, and how near the sources come."""
    out = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    whole = out.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("all_taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    near = (F.abs(F.col("all_taken") - F.col("target")) <= 1) & (F.col("over") <= 0)
    told = whole.select(F.col("source").alias("s"), near.alias("near_target"))
    out = out.join(told, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "near_target")


MIXING_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS stop, row_number() OVER (ORDER BY 3 * source_size / w, source IS NULL, encode(source)) AS k FROM s),
u AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k DESC) AS unit FROM r
), c AS (SELECT arg_min(unit, k) AS unit FROM u WHERE unit <= stop)
SELECT doc_id, size, source_size, round(least(3 * source_size, w * (SELECT unit FROM c)), 4)::DOUBLE AS target, true AS near_target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    told = F.expr("array_join(transform(licenses, x -> concat(x.license, ':', x.matched, '/', x.words, ':', x.start, ':', x.end)), ',')")
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), told.alias("licenses"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.judge(docs, read(spark, sf_dir, "labels"), keep=["doc_id"], spans=False)
    return out.select("doc_id", F.coalesce(toxicity.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules, keep=["page_id"])


OP7_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT row_number() OVER () AS k, page_id, host, path FROM v
), f AS (
  SELECT k, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM m JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m LEFT JOIN f USING (k)
"""


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_ngram_join": op2_ngram_join,
    "op6_repeats": op6_repeats,
    "op3_mixing": op3_mixing,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op7_url_rules": op7_url_rules,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
    "mixing_targets": mixing_targets,
    "quality_base": quality_base,
}
ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op7_url_rules": OP7_SQL,
    "op8_secrets": OP8_SQL,
    "mixing_targets": MIXING_TARGETS_SQL,
    "quality_base": QUALITY_BASE_SQL,
}
