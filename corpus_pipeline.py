"""A training corpus from raw documents: language ID, near-duplicates, repeated passages, benchmark texts, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns a DataFrame that is
written down and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Nulls and ties: a null text has no letter and goes with the first stage. Rows without a ``doc_id`` stay like others; of
a group of near-duplicates the row with the smallest id stays (ids before null, then by a hash of the text). Repeated
rows are near-duplicates. Empty tables pass through. Columns other than those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import decontamination, language, packing, simhash, suffixes
from winnow.llm.common import read_table, shared_folder, ship, written
from winnow.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEQUENCE_TOKENS = 2048


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    ship(spark)
    told = language.identify(docs.select(COLUMNS), carry=tuple(COLUMNS))
    return told.filter(F.col("lang_pred") != language.UNKNOWN).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("mark"), F.coalesce("doc_id", F.lit(suffixes.LAST_ID)).alias("id"))
    groups = simhash.near_duplicates(marked, carry=("doc_id", "id", "mark"))
    stay = written(groups.groupBy("component_print").agg(F.min(F.struct("id", "mark")).alias("row")).select("row.*"))
    return marked.join(stay, ["id", "mark"]).dropDuplicates(["id", "mark"]).select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    ship(spark)
    cut = suffixes.remove_repeats(docs.select(COLUMNS), carry=tuple(COLUMNS), keep=True)
    return cut.withColumn("text", F.coalesce("kept", "text")).withColumn(
        "n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    bad = written(found.filter("contaminated").select("key").distinct())
    keyed = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return keyed.join(bad, "key", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
# Hash functions, suffix arrays and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
