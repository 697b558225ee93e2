"""An index for the substring search of the dashboard: which candidates have which three letters.

``write`` keeps one posting per candidate and *trigram* (three neighbouring letters of its lower-cased name or of one of
its skills), sorted by trigram and batch, and how many postings each trigram has. ``search`` reads the postings of the
rarest trigrams of the wanted text only, intersects them, fetches these candidates and looks at them again, since
trigrams in common do not make a substring. Texts shorter than three letters are searched by a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators import dashboard

GRAM = 3
# Trigrams of a search whose postings are intersected: more of them read more and exclude little.
RAREST = 3
# Candidates up to this number are fetched by their values, which prunes files; more by a join.
FETCHED = 1000


def grams(text: Column) -> Column:
    """All runs of three letters of the lower-cased text; none in shorter texts and null."""
    lowered = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(lowered) - (GRAM - 1))
    return F.when(F.length(lowered) >= GRAM, F.transform(starts, lambda at: F.substr(lowered, at, F.lit(GRAM)))).otherwise(
        F.array().cast("array<string>"))


def write(candidates: DataFrame, path: str, keys: tuple[str, ...] = ("batch_id", "rank")) -> None:
    """Write the index of candidates, each named by its ``keys``. Rows of a frequent trigram are spread over files."""
    texts = F.concat(F.array("name"), F.coalesce("matched_skills", F.array().cast("array<string>")))
    every = F.array_distinct(F.flatten(F.transform(texts, grams)))
    postings = candidates.select(*keys, F.explode(every).alias("gram"))
    postings.repartitionByRange("gram", *keys).sortWithinPartitions("gram", *keys).write.parquet(f"{path}/postings")
    written = candidates.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def posted(spark: SparkSession, path: str, text: str, keys: tuple[str, ...] = ("batch_id", "rank")) -> DataFrame:
    """Keys of the candidates that have the rarest trigrams of a text of three letters or more."""
    lowered = text.lower()
    wanted = sorted({lowered[at:at + GRAM] for at in range(len(lowered) - GRAM + 1)})
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(wanted)).orderBy("n", "gram").collect()
    known = [r["gram"] for r in counts]  # at most one row per letter of the text
    chosen = known[:RAREST] if len(known) == len(wanted) else []
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(chosen))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen)).select(*keys)


def search(candidates: DataFrame, path: str, text: str, keys: tuple[str, ...] = ("batch_id", "rank")) -> DataFrame:
    """What ``dashboard.search`` returns for candidates that were indexed at ``path`` under unique ``keys`` without
    nulls."""
    if len(text) < GRAM or len(text.lower()) < GRAM:
        return dashboard.search(candidates, text)
    found = posted(candidates.sparkSession, path, text, keys)
    few = found.limit(FETCHED + 1).collect()  # bounded
    if len(few) > FETCHED:
        return dashboard.search(candidates.join(found, list(keys), "left_semi"), text)
    rows = candidates
    for key in keys:
        rows = rows.filter(F.col(key).isin(sorted({r[key] for r in few})))  # reaches the scan
    if len(few) > 0 and len(keys) > 1:
        rows = rows.join(F.broadcast(candidates.sparkSession.createDataFrame(few, found.schema)), list(keys), "left_semi")
    return dashboard.search(rows, text)
