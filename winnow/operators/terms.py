"""Matching a vocabulary that is a table, for vocabularies too long to be part of a plan.

A term is found where it stands between word boundaries, so it is a row of whole *runs* of the text: runs of word
characters and runs of other characters alternate. That makes the search an equality join. Runs that begin no term
are dropped first, by a join with the distinct first runs of the vocabulary; only what follows the remaining ones is
compared with terms, at the lengths that terms with this first run have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions.common import empty_texts, found, pattern
from winnow.operators.slices import fits_broadcast

# Shares of the rows of one first run or term where its table is too large to be broadcast.
SHARES = 32


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(r"\w+|\W+")), F.lit(0))


def _places(rows: DataFrame, names: list[Column], text: str, longest: int) -> DataFrame:
    """``_at, _first, _ahead`` of each run of the lower-cased text: its place, itself, and the runs from it on, at most
    ``longest``. Runs of other characters at either end are left out: no word boundary lies beyond those.

    The steps are plain columns, not lambdas, so that Spark compiles them together with the joins that follow and slices
    only where a term begins. An inner explode would bring a filter that finds all runs again; the null ``_first`` of a
    text without runs joins nothing.
    """
    runs = rows.select(*names, _runs(F.coalesce(F.lower(text), F.lit(""))).alias("_runs"))
    outer = [F.coalesce(found(F.get("_runs", at), r"^\W"), F.lit(False)).cast("int") for at in (F.lit(0), F.size("_runs") - 1)]
    ends = runs.select(*names, "_runs", outer[0].alias("_skip"), outer[1].alias("_over"))
    inner = ends.select(*names, F.slice("_runs", F.col("_skip") + 1, F.greatest(
        F.size("_runs") - F.col("_skip") - F.col("_over"), F.lit(0))).alias("_inner"))
    each = inner.select(*names, "_inner", F.posexplode_outer("_inner").alias("_at", "_first"))
    return each.select(*names, "_at", "_first", F.slice("_inner", F.col("_at") + 1, F.lit(longest)).alias("_ahead"))


def _lookup(rows: DataFrame, small: DataFrame, key: str, share: Column, settings: Settings) -> DataFrame:
    """Inner join on ``key``. A table beyond the broadcast bound is repeated per share, so that the rows of a frequent
    word are spread over tasks."""
    if fits_broadcast(small, settings, key):
        return rows.join(F.broadcast(small), key)
    shares = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("_share", F.pmod(share, F.lit(SHARES)).cast("int")).join(shares, [key, "_share"]).drop("_share")


def match_terms(rows: DataFrame, vocabulary: DataFrame, settings: Settings, keys: list[str],
                text: str = "raw_text") -> DataFrame:
    """One row per ``keys``: ``keys, matched_skills, skills_count``, terms as whole words in order of ``ord``.

    ``vocabulary`` has ``ord, skill``; a term listed under several ``ord`` is repeated, equal ``ord`` go by the term,
    rows repeated as a whole count once. Terms are compared as given with the lower-cased text. A null or blank text
    and an empty vocabulary give an empty list; rows of equal keys share one list; null and empty terms never match.
    """
    listed = vocabulary.select("ord", F.col("skill").alias("_term"), _runs(F.col("skill")).alias("_parts"))
    listed = listed.filter(F.length("_term") > 0)
    longest = listed.agg(F.max(F.size("_parts"))).head()[0] or 1  # one number
    firsts = listed.groupBy(F.get("_parts", F.lit(0)).alias("_first")).agg(
        F.collect_set(F.size("_parts")).alias("_sizes"))

    names = [F.col(k) for k in keys]
    share = F.xxhash64(*names, F.col("_at"))
    begun = _lookup(_places(rows, names, text, longest), firsts, "_first", share, settings)
    sized = begun.select(*names, "_at", "_ahead", F.explode("_sizes").alias("_size"))
    spans = sized.filter(F.size("_ahead") >= F.col("_size")).select(
        *names, "_at", F.array_join(F.slice("_ahead", F.lit(1), F.col("_size")), "").alias("_term"))
    hits = _lookup(spans, listed.select("ord", "_term"), "_term", share, settings)
    entry = F.struct("ord", "_term")
    none = F.lit(None).cast(hits.select(entry.alias("e")).schema["e"].dataType)
    every = hits.select(*names, entry.alias("_hit")).unionByName(rows.select(*names, none.alias("_hit")))
    found_terms = every.groupBy(*keys).agg(F.array_sort(F.collect_set("_hit")).alias("_hits"))
    return found_terms.select(
        *names, F.when(F.size("_hits") == 0, empty_texts()).otherwise(
            F.transform("_hits", lambda h: h["_term"])).alias("matched_skills"),
        F.size("_hits").alias("skills_count"))
