"""A corpus pipeline of five stages; each reads what its predecessor kept, written as Parquet.

All stages take nulls in any column, empty texts and texts of any length whole, repeated rows, empty tables, and other columns than those of
documents, whatever their names, which they leave out. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropcube.llm import decontaminate, mixing, ngram_join, quality, secrets
from cropcube.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: the verdicts of the first stage are sums of logarithms in the order of a text's words.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trained verdict go.

    Null, empty and short texts (under 50 words) fail the base rules; repeated rows stay or go alike; a score at the threshold stays.
    """
    judged = quality.judge(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard 0.75 connect, the row with the smallest id stays (then the least hash of the text).

    Null ids come last. Texts without words are linked with nothing and stay; of rows that are alike in id and text one stays.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"))
    rows = docs.select(*COLUMNS).withColumn("row", row)
    groups = ngram_join.jaccard_components(rows, id_col="row")
    gone = groups.where("id <> component").select(F.col("id").alias("row")).distinct()
    return rows.join(gone, "row", "left_anti").dropDuplicates(["row"]).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts are never contaminated and stay, as do all documents where there is no benchmark; repeated rows go or stay alike.
    """
    found = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's text is replaced by a mark; all documents stay, repeated rows alike.

    Null texts stay null. ``n_chars`` is counted anew where a text changes. Spans that overlap become one mark.
    """
    found = secrets.scan(docs.select(*COLUMNS)).withColumn("hit", F.size("spans") > 0)
    clean = secrets.redact(found)
    return clean.withColumn("n_chars", F.when(F.col("hit"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each.

    Null and empty texts have no words and are never taken; null is a source like others, the last one. Rows with one id follow by size and
    hash of the text; of rows alike in these it does not matter which is which.
    """
    return mixing.mix(docs.select(*COLUMNS)).where("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
