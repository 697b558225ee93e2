"""Keeping hot keys out of single tasks.

One batch, file name or term may hold a third of all rows. A *slice* is a run of at most ``slice_rows`` ordinals
of a batch, so ``(batch_id, slice)`` is a key whose groups have a fixed bound whatever the batch's size. Joins and
ranks below work on such keys: what belongs to the whole batch is computed from one partial row per slice.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import Settings

SLICE = "slice"


def slice_of(ordinal: Column, settings: Settings) -> Column:
    return F.floor(ordinal / F.lit(settings.slice_rows)).cast("bigint")


def scratch_folder(spark) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder.

    Only a local session may do without; it gets a temporary folder, kept in its settings.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="winnow-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where rows are needed twice (totals and rows). The table survives lost executors and is computed once,
    which ``checkpoint()`` is not.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_folder(spark), f"winnow-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Give every core a share of rows that are read in fewer than two splits per core.

    Spark cuts a table into about one split per core until splits have their full size, however few row groups its files
    have, and a row group is read by one task. So only a table of more splits passes unchanged, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def fits_broadcast(small: DataFrame, settings: Settings, text: str | None = None) -> bool:
    """Whether a table is within the broadcast bound, by rows and by characters of its text column."""
    chars = F.length(text) if text else F.lit(0)
    size = small.select(chars.alias("chars")).limit(settings.broadcast_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).head()
    return size["n"] <= settings.broadcast_rows and (size["chars"] or 0) <= settings.broadcast_chars


def join_batch_facts(rows: DataFrame, facts: DataFrame, settings: Settings, text: str | None = None,
                     how: str = "left") -> DataFrame:
    """Join one-row-per-batch ``facts`` to ``rows`` that carry ``batch_id`` and ``slice``.

    Facts within the bound are broadcast. Otherwise they are repeated per existing slice, so a batch holding a
    third of all rows is spread over its slices instead of landing in one task.
    """
    if fits_broadcast(facts, settings, text):
        return rows.join(F.broadcast(facts), "batch_id", how)
    per_slice = rows.select("batch_id", SLICE).distinct().join(facts, "batch_id")
    return rows.join(per_slice, ["batch_id", SLICE], how)


@dataclass(frozen=True)
class Part:
    """A column that splits a key into parts of bounded size, in rank order."""

    column: Column
    descending: bool = False

    def ordered(self, name: str) -> Column:
        return F.col(name).desc() if self.descending else F.col(name).asc()


def ordered_rank(rows: DataFrame, keys: list[str], parts: list[Part], order: list[Column],
                 name: str = "rank") -> DataFrame:
    """Exact ``row_number`` per ``keys`` without sorting a whole key in one task.

    Every row of an earlier part ranks before every row of a later one. Part sizes give each part its first rank;
    only the rows of one part are sorted together. ``order`` must be total within a part. Pass materialized
    ``rows``: they are read twice.
    """
    names = [f"_part{i}" for i in range(len(parts))]
    tagged = rows.select("*", *[p.column.alias(n) for p, n in zip(parts, names)])
    sizes = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys).orderBy(*[p.ordered(n) for p, n in zip(parts, names)])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        tagged.join(offsets, [*keys, *names])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .drop(*names, "_before")
    )
