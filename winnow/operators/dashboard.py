"""Questions the dashboard asks of one batch's ranked candidates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions import scores


def search(candidates: DataFrame, text: str) -> DataFrame:
    """Candidates whose name or any matched skill contains the text, letter case ignored."""
    wanted = text.lower()
    in_skills = F.exists("matched_skills", lambda s: F.lower(s).contains(wanted))
    return candidates.filter(F.lower("name").contains(wanted) | in_skills)


def flagged(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("is_anomaly"))


def top(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` candidates in rank order, all if None. Each task keeps only its own first ``n``."""
    ordered = candidates.orderBy("rank")
    return ordered if n is None else ordered.limit(n)


def top_per_batch(candidates: DataFrame, n: int, settings: Settings) -> DataFrame:
    """The first ``n`` candidates of every batch in rank order, ranks having gaps after a filter.

    The first ``n`` of each slice are found before those of the batch, so a hot batch sends on only ``n`` per slice.
    """
    part = F.floor(F.col("rank") / settings.slice_rows)
    in_slice = Window.partitionBy("batch_id", part).orderBy("rank")
    in_batch = Window.partitionBy("batch_id").orderBy("rank")
    first = candidates.withColumn("_place", F.row_number().over(in_slice)).filter(F.col("_place") <= n)
    return first.withColumn("_place", F.row_number().over(in_batch)).filter(F.col("_place") <= n).drop("_place")


def filtered(candidates: DataFrame, text: str = "", flagged_only: bool = False, n: int | None = None) -> DataFrame:
    """Search, flag filter, then top-n, in that order."""
    rows = search(candidates, text) if text else candidates
    return top(flagged(rows) if flagged_only else rows, n)


def summary(candidates: DataFrame, *keys: str) -> DataFrame:
    """Count, mean score to one decimal, top candidate, number of flags; per ``keys`` if given."""
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.min_by("name", "rank").alias("top_candidate"),
        F.count_if("is_anomaly").alias("anomalies"),
    )


def score_bands(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(scores.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def chart_bars(candidates: DataFrame) -> DataFrame:
    """Candidates with their name cut to its first word."""
    return candidates.withColumn("name", F.split("name", " ")[0])


def chart(candidates: DataFrame, n: int = 10) -> DataFrame:
    """First word of the name and score of the first ``n`` candidates."""
    return chart_bars(top(candidates, n)).select("rank", "name", "score")


def first_uploads(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per ``keys`` in ``order``, which must be unique within a key.

    A name like ``resume.pdf`` may be on a third of all rows. Only narrow keys meet in the aggregation, combined
    on the map side; rows are then kept by their full key, whose groups hold one row.
    """
    first = files.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col("_first")[k].alias(f"_{k}") for k in order])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, *order)])
    return files.join(first, same, "left_semi")
