"""Incremental screening: files of resumes arrive, their scores are appended, and batches are ranked when read.

A score depends on its own resume and job alone, so a micro-batch costs what it brings: it is scored and written as one
folder of narrow rows, which a replay of the same micro-batch overwrites. Ranks and length limits depend on the whole
batch. Beside its scores a micro-batch therefore writes their *parts*: rows and sums of lengths per batch, score and
slice. They commit the micro-batch (scores without parts do not count), they alone give the limits, and they tell how many
candidates stand before each score, so that ``candidates`` ranks without counting rows again. A batch may arrive over
several micro-batches.

``compact`` joins what many micro-batches left into one folder, clustered by batch. Folders that it replaces no longer
count, a later replay of them neither; they are not deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.operators import scoring
from winnow.operators.slices import SLICE, spread
from winnow.plans.screen import blended_scores, keyword_scores
from winnow.sources import store

RESUME_SCHEMA = "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string"
COMPACTIONS = "last bigint, folder string"


def read_arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(RESUME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def screen_arrivals(arrivals: DataFrame, jobs: DataFrame, out: str, settings: Settings, model=None,
                    keywords_only: bool = False, progress: str = "progress"):
    """Score everything that has arrived, then stop. Returns the finished query.

    Rows are sorted by batch within their files, so a read of a few batches skips most row groups. A micro-batch of few
    files is spread over all cores before it is scored.
    """
    def screen_epoch(rows: DataFrame, epoch: int) -> None:
        rows = spread(rows)
        scored = (keyword_scores(rows, jobs, settings) if keywords_only
                  else blended_scores(rows, jobs, settings, model))
        named = scored.withColumn("batch_id", F.coalesce("batch_id", F.lit("")))
        folder = f"{out}/scores/epoch={epoch}"
        named.sortWithinPartitions("batch_id").write.mode("overwrite").parquet(folder)
        written = rows.sparkSession.read.schema(named.schema).parquet(folder)
        parts = scoring.score_parts(written, settings).withColumn("slice_rows", F.lit(settings.slice_rows).cast("bigint"))
        parts.sortWithinPartitions("batch_id").write.mode("overwrite").parquet(f"{out}/parts/epoch={epoch}")

    query = (
        arrivals.writeStream.foreachBatch(screen_epoch)
        .option("checkpointLocation", f"{out}/{progress}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _compacted(spark: SparkSession, out: str) -> tuple[int, str | None]:
    """The last epoch that is part of a compaction, and its folder."""
    if store.read_rows(spark, f"{out}/compactions") is None:
        return -1, None
    done = spark.read.schema(COMPACTIONS).parquet(f"{out}/compactions").agg(F.max(F.struct("last", "folder")).alias("c"))
    newest = done.head()["c"]  # one row
    return newest["last"], newest["folder"]


def _parts(spark: SparkSession, out: str, last: int, folder: str | None) -> DataFrame | None:
    """Parts that count, those of a compaction with its last epoch."""
    found = store.read_rows(spark, f"{out}/parts")
    if found is None:
        return None
    later = found.withColumn("epoch", F.col("epoch").cast("bigint")).filter(F.col("epoch") > last)
    if folder is None:
        return later
    packed = store.read_rows(spark, f"{out}/compacted/{folder}/parts").withColumn("epoch", F.lit(last).cast("bigint"))
    return packed.unionByName(later)


def _scores(spark: SparkSession, out: str, last: int, folder: str | None, parts: DataFrame) -> DataFrame:
    """Score rows of the same epochs."""
    found = store.read_rows(spark, f"{out}/scores").withColumn("epoch", F.col("epoch").cast("bigint"))
    later = found.filter(F.col("epoch") > last).join(parts.select("epoch").distinct(), "epoch", "left_semi").drop("epoch")
    return later if folder is None else store.read_rows(spark, f"{out}/compacted/{folder}/scores").unionByName(later)


def _chosen(rows: DataFrame, batches: list[str] | None) -> DataFrame:
    return rows if batches is None else rows.filter(F.col("batch_id").isin(batches))


def _check_slices(parts: DataFrame, settings: Settings) -> None:
    other = parts.filter(F.col("slice_rows") != settings.slice_rows).select("slice_rows").head(1)
    if other:
        raise ValueError(f"the stream was written with slice_rows={other[0][0]}, not {settings.slice_rows}")


def candidates(spark: SparkSession, out: str, settings: Settings, batches: list[str] | None = None,
               first: int | None = None) -> DataFrame:
    """Ranked and flagged candidates of the given batches (default: all) from all scores so far, of every batch at most
    the ``first``.

    Before anything has arrived this is an empty store. Settings with other ``slice_rows`` than the stream's are refused.
    """
    last, folder = _compacted(spark, out)
    parts = _parts(spark, out, last, folder)  # listed before the scores: what it names is there
    if parts is None:
        return store.read_store(spark, out)
    _check_slices(parts, settings)
    scored = _chosen(_scores(spark, out, last, folder, parts), batches)
    return store.with_defaults(scoring.rank_and_flag(scored, settings, _chosen(parts, batches), first))


def limits(spark: SparkSession, out: str, batches: list[str] | None = None) -> DataFrame | None:
    """Number of texts, mean length, deviation and limit per batch so far; no score row is read. None before anything
    has arrived."""
    parts = _parts(spark, out, *_compacted(spark, out))
    return None if parts is None else scoring.limits_of_parts(_chosen(parts, batches))


def compact(spark: SparkSession, out: str) -> None:
    """Write all scores and parts so far as one folder each. The row in ``compactions`` is the commit: without it the
    new folders do not count. The stream may go on meanwhile; compactions take turns."""
    last, folder = _compacted(spark, out)
    parts = _parts(spark, out, last, folder)
    newest = parts.agg(F.max("epoch")).head()[0] if parts is not None else None
    if newest is None or newest <= last:
        return
    scored = _scores(spark, out, last, folder, parts)
    packed = uuid.uuid4().hex
    scored.repartitionByRange("batch_id", "ordinal").sortWithinPartitions("batch_id", "ordinal").write.parquet(
        f"{out}/compacted/{packed}/scores")
    scoring.merged_parts(parts, "batch_id", "score", SLICE, "slice_rows").repartitionByRange("batch_id", "score").sortWithinPartitions(
        "batch_id", "score").write.parquet(f"{out}/compacted/{packed}/parts")
    spark.createDataFrame([(newest, packed)], COMPACTIONS).coalesce(1).write.mode("append").parquet(f"{out}/compactions")
