"""Hot batches: results do not depend on how batches are sliced or which join is used."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from winnow import config
from winnow.catalog import fixture
from winnow.operators import dashboard, scoring
from winnow.operators.slices import Part, join_batch_facts, materialize, ordered_rank, slice_of
from winnow.plans.screen import screen

FOLDER = "/root/testdata/sf0.001"
LARGE = config.scoring(2026)
SMALL = config.scoring(2026, slice_rows=7, broadcast_rows=0)


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("b"), F.col("id") % 40)).alias("batch_id"),
        F.col("id").alias("resume_id"), F.col("id").alias("ordinal"),
        (F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 37 % 100) / 10).alias("score"),
        (F.when(F.col("id") % 97 == 0, 5000).otherwise(F.col("id") * 13 % 200)).cast("int").alias("text_length"))
    return materialize(rows)


@pytest.mark.parametrize("settings", [LARGE, SMALL], ids=["large", "small"])
def test_rank_equals_a_single_window(scored, settings):
    plain = Window.partitionBy("batch_id").orderBy(F.col("score").desc(), "ordinal")
    expected = {(r["resume_id"], r["n"]) for r in scored.select(
        "resume_id", F.row_number().over(plain).alias("n")).collect()}
    assert {(r["resume_id"], r["rank"]) for r in scoring.rank(scored, settings).collect()} == expected
    both = scoring.rank_and_flag(scored, settings).collect()
    assert {(r["resume_id"], r["rank"]) for r in both} == expected


@pytest.mark.parametrize("settings", [LARGE, SMALL], ids=["large", "small"])
def test_flags_equal_the_definition(scored, settings):
    lengths: dict[str, list[int]] = {}
    rows = scored.collect()
    for r in rows:
        lengths.setdefault(r["batch_id"], []).append(r["text_length"])
    limit = {b: statistics.mean(v) + 2 * statistics.stdev(v) for b, v in lengths.items()}
    expected = {r["resume_id"] for r in rows if r["text_length"] > limit[r["batch_id"]]}
    assert expected
    for out in (scoring.flag_outliers(scored, settings), scoring.rank_and_flag(scored, settings)):
        flagged = out.filter("is_anomaly")
        assert {r["resume_id"] for r in flagged.collect()} == expected
        assert {bool(r["anomaly_reason"]) for r in flagged.collect()} == {True}


def test_small_batches_are_never_flagged(spark):
    def flags(n: int) -> int:
        rows = spark.createDataFrame([("b", i, 10 if i else 10000) for i in range(n)],
                                     "batch_id string, ordinal bigint, text_length int")
        return scoring.flag_outliers(rows, LARGE).filter("is_anomaly").count()

    assert [flags(n) for n in (1, 2, 5, 6)] == [0, 0, 0, 1]


def test_batch_facts_beyond_the_broadcast_bound(spark, scored):
    rows = scored.withColumn("slice", slice_of(F.col("ordinal"), SMALL))
    facts = scored.groupBy("batch_id").agg(F.count("*").alias("size"))
    near, far = join_batch_facts(rows, facts, LARGE), join_batch_facts(rows, facts, SMALL)
    assert "Broadcast" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, near.select("resume_id", "size").collect())) == sorted(
        map(tuple, far.select("resume_id", "size").collect()))


def test_ordered_rank_over_hash_parts(spark):
    rows = materialize(spark.range(500).select("id", (F.col("id") % 2).alias("k"),
                                               F.md5(F.col("id").cast("string")).alias("h")))
    plain = Window.partitionBy("k").orderBy("h")
    out = ordered_rank(rows, ["k"], [Part(F.substring("h", 1, 1))], [F.col("h")])
    assert out.withColumn("e", F.row_number().over(plain)).filter("rank <> e").count() == 0


@pytest.mark.parametrize("keywords_only", [True, False])
def test_screening_does_not_depend_on_slices(spark, keywords_only):
    def run(settings):
        out = screen(fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER), settings, keywords_only=keywords_only)
        return sorted(tuple(str(v) for v in r) for r in out.collect())

    assert run(LARGE) == run(SMALL)


def test_missing_batch_and_text_lose_no_rows(spark):
    rows = spark.createDataFrame(
        [(None, 1, 1, "a.docx", "python"), (None, 2, 2, "b.docx", None), ("x", 3, 1, None, "sql")],
        "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    jobs = spark.createDataFrame([("x", "sql")], "batch_id string, job_description string")
    out = {r["resume_id"]: r for r in screen(rows, jobs, LARGE).collect()}
    assert {k: r["rank"] for k, r in out.items()} == {1: 1, 2: 2, 3: 1}
    assert out[2]["text_length"] == 0 and out[3]["jd_matched_skills"] == ["sql"]


def test_first_uploads_treat_missing_names_as_one(spark):
    rows = spark.createDataFrame([("b", None, 2), ("b", None, 1), ("b", "x", 3), (None, None, 4)],
                                 "batch_id string, filename string, ordinal bigint")
    kept = dashboard.first_uploads(rows, ["batch_id", "filename"], ["ordinal"])
    assert sorted(r["ordinal"] for r in kept.collect()) == [1, 3, 4]
