"""Quality rules, in DataFrame and SQL functions alone.

Base rules count words, symbols, repeated lines and words in repeated three-word windows. The verdict on the rest is a
log-likelihood ratio: hashed n-grams (words, and pairs of words) of the trusted documents form one multinomial, those of all
documents another, both smoothed; a document's score is the mean of log(p_trusted / p_raw) over its n-grams, and every
document is held against the same threshold.

The trusted documents come from labels, up to TRUSTED_ROWS of them (chosen by a hash beyond that): that bounds what is
broadcast. The raw counts are of all documents. What is handed back to the tasks is a table of BUCKETS weights.

Nulls: a null or blank text has no words, and fails. A null id is never trusted. Texts of any length are judged whole. An id that several
rows have is trusted in all of them; ties of a score with the threshold are kept. Empty tables give empty results; without
trusted documents all weights are 0, so the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words.
SPACES = " \t\n\x0b\f\r"
BUCKETS = 1 << 16
TRUSTED_ROWS = 1_000_000
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.15
MIN_WORDS = 50
#: N-grams that smooth each cell of the trusted counts, in the corpus' own proportions.
PRIOR = 20.0


def words_of(text: str) -> Column:
    trimmed = F.expr(f"btrim(coalesce({text}, ''), ' \\t\\n\\u000b\\u000c\\r')")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``cc_text``, ``cc_words`` and ``cc_n``."""
    df = docs.withColumn("cc_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn("cc_words", words_of("cc_text"))
    return df.withColumn("cc_n", F.size("cc_words"))


def cell(pair: bool) -> str:
    """The n-gram cell of word x at i of ``cc_words``: of itself, or (behind those) of it with the next word."""
    return f"cast(pmod(xxhash64(x, get(cc_words, i + 1)), {BUCKETS}) as int) + {BUCKETS}" if pair else f"cast(pmod(xxhash64(x), {BUCKETS}) as int)"


def trusted_ids(labels: DataFrame, id_col: str, quality_col: str, most: int) -> DataFrame:
    """Distinct ids of trusted documents: all, or beyond ``most`` a part chosen by a hash of about that size."""
    ids = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("cc_id")).where("cc_id IS NOT NULL").distinct()
    n = ids.count()
    if n > most:
        ids = ids.where(F.pmod(F.xxhash64("cc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))
    return ids


def weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, most: int = TRUSTED_ROWS) -> DataFrame:
    """One row, one array: log(p_trusted / p_raw) of the cells of single words, then of pairs."""
    ids = trusted_ids(labels, id_col, quality_col, most).withColumn("cc_trusted", F.lit(1))
    told = docs.select(F.col(id_col).alias("cc_id"), F.col(text_col).alias("cc_raw"))
    told = told.join(F.broadcast(ids), "cc_id", "left").select("cc_trusted", "cc_raw")
    cells = F.expr(f"concat(transform(cc_words, x -> {cell(False)}), transform(cc_words, (x, i) -> {cell(True)}))")
    cells = with_words(told, "cc_raw").select("cc_trusted", F.explode(cells).alias("b"))
    counts = cells.groupBy("b").agg(F.count("*").alias("raw"), F.count("cc_trusted").alias("good"))
    session = docs.sparkSession
    rows = session.range(2 * BUCKETS).withColumnRenamed("id", "b").join(F.broadcast(counts), "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    order = F.shiftright("b", 16)
    totals = rows.groupBy(order.alias("o")).agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    # q / p with PRIOR n-grams of the corpus' own trusted share added to each cell: rare cells say little
    ratio = (F.col("good") * F.col("raws") / F.col("goods") + PRIOR) / (F.col("raw") + PRIOR)
    scored = rows.join(F.broadcast(totals), order == F.col("o")).select("b", F.when(F.col("goods") == 0, F.lit(0.0)).otherwise(F.log(ratio)).alias("w"))
    return scored.agg(F.expr("transform(array_sort(collect_list(struct(b, w))), x -> x.w)").alias("w"))


def base_columns() -> dict[str, Column]:
    """The base figures from ``cc_text``, ``cc_words``, ``cc_n`` and ``cc_sorted`` (see ``scored``)."""
    blank = F.expr("filter(split(cc_text, '\\n'), x -> btrim(x, ' \\t\\n\\u000b\\u000c\\r') <> '')")
    return {
        "n_words": F.col("cc_n").cast("long"),
        "word_chars": F.length(F.array_join("cc_words", "")).cast("long"),
        "n_symbols": F.regexp_count("cc_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(blank) - F.size(F.array_distinct(blank))).cast("long"),
    }


def fenced(col: Column) -> Column:
    """The column, where no filter on it can be moved below: there its expressions would be repeated inside each other."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def scored(docs: DataFrame, table: Column, text_col: str) -> DataFrame:
    """``docs`` with the base figures, ``base_failed`` and ``score``."""
    df = with_words(docs, text_col)
    # a window's fingerprint above its place: sorted, equal windows stand side by side
    df = df.withColumn("cc_bits", F.expr("cast(ceil(log2(cc_n + 1)) as int)"))
    df = df.withColumn(
        "cc_sorted",
        F.expr("sort_array(transform(slice(cc_words, 1, greatest(cc_n - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(cc_words, i + 1), get(cc_words, i + 2)), cc_bits) | i))"),
    )
    df = df.withColumn(
        "cc_again",
        F.expr(
            "filter(cc_sorted, (x, i) -> shiftrightunsigned(x, cc_bits) = shiftrightunsigned(get(cc_sorted, i + 1), cc_bits)"
            " OR shiftrightunsigned(x, cc_bits) = shiftrightunsigned(get(cc_sorted, i - 1), cc_bits))"
        ),
    )
    places = "sort_array(transform(cc_again, x -> x & (shiftleft(1L, cc_bits) - 1)))"
    repeat = F.expr(
        f"aggregate({places}, named_struct('last', -9L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"
    )
    df = df.withColumn("cc_table", table)
    total = F.expr(f"aggregate(transform(cc_words, (x, i) -> get(cc_table, {cell(False)}) + get(cc_table, {cell(True)})), 0D, (a, x) -> a + x)")
    for name, col in base_columns().items():
        df = df.withColumn(name, col)
    df = df.withColumn("n_repeat_words", fenced(repeat)).withColumn("score", fenced(F.when(F.col("cc_n") > 0, total / (2 * F.col("cc_n")))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", fenced(failed)).drop("cc_text", "cc_words", "cc_n", "cc_bits", "cc_sorted", "cc_again", "cc_table")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    quality_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``score``, ``kept``.

    Columns of ``docs`` of these names are replaced; every row is judged by itself, repeated ones alike.
    """
    named = labels.select(F.col(label_id).alias(id_col), F.col(quality_col).alias("quality"))
    table = weights(docs, named, id_col, text_col, "quality").scalar()
    out = scored(docs, table, text_col)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
