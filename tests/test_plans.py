"""The physical plans that scale depends on."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from winnow import config
from winnow.catalog import files_fixture, fixture
from winnow.operators.features import explode_lines, features, with_segments, with_skills
from winnow.operators.slices import materialize, spread
from winnow.plans.screen import keyword_scores
from winnow.sources import store

FOLDER = "/root/testdata/sf0.001"
SETTINGS = config.scoring(2026)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def resumes(spark):
    return materialize(fixture.resumes(spark, FOLDER))


def test_features_do_not_shuffle(resumes):
    assert "Exchange" not in plan(features(resumes, SETTINGS))


def test_unused_features_are_pruned(resumes):
    whole, some = plan(features(resumes, SETTINGS)), plan(features(resumes, SETTINGS).select("resume_id", "skills_count"))
    assert "map_from_arrays" in whole and "map_from_arrays" not in some
    assert "headings" not in some
    assert re.search(r"ReadSchema: struct<resume_id:bigint,raw_text:string>", some)


def test_filters_stay_above_features(resumes):
    text = plan(features(resumes, SETTINGS).filter(F.col("experience_years") > 5))
    lines = [line.strip(" :+-*()0123456789") for line in text.split("\n")]
    assert lines.index(next(x for x in lines if x.startswith("Filter"))) < lines.index(
        next(x for x in lines if x.startswith("CollectMetrics")))


def test_sliced_join_reads_keys_only_for_the_job_side(spark, resumes):
    jobs = fixture.jobs(spark, FOLDER).select("batch_id", "job_description")
    near = plan(keyword_scores(resumes, jobs, SETTINGS))
    far = plan(keyword_scores(resumes, jobs, config.scoring(2026, broadcast_rows=0)))
    assert len(re.findall(r"FileScan parquet", far)) == len(re.findall(r"FileScan parquet", near)) + 1
    assert "ReadSchema: struct<batch_id:string,ordinal:bigint>" in far


def test_store_readers_open_one_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(spark.createDataFrame([("a", "x"), ("b", "y")], "batch_id string, name string"), path)
    store.append(spark.createDataFrame([("c", "z")], "batch_id string, name string"), path)
    text = plan(store.read_batch(spark, path, "a").select("name"))
    assert re.search(r"PartitionFilters: \[.*epoch.* = 00000001-.*\]", text)
    assert re.search(r"PushedFilters: \[.*EqualTo\(batch_id,a\)", text)
    totals = plan(store.store_totals(spark, path))
    assert len(re.findall("FileScan", totals)) == 1 and "ReadSchema: struct<batch_id:string,uploaded_at:string,candidate_count" in totals


def filtered_below(df) -> list[str]:
    """Filters of ``df`` that look into arrays or texts."""
    return [line for line in plan(df).split("\n") if re.search(r"^[ :+\-*()0-9]*Filter", line)
            and re.search(r"transform|split|regexp|RLIKE", line)]


def test_explodes_bring_no_filter_below_the_work(spark, resumes):
    some = resumes.select("resume_id", "raw_text").repartition(2)
    assert not filtered_below(with_segments(some).select("resume_id", F.explode("segments")))
    assert not filtered_below(with_skills(some, SETTINGS).select("resume_id", F.posexplode("matched_skills")))
    assert not filtered_below(explode_lines(some))


def test_derived_texts_are_filtered_above_the_repartitioning(spark):
    for rows in (fixture.resumes(spark, FOLDER), files_fixture.stored(spark, FOLDER, ("sql",))):
        text = plan(rows.filter(F.length("raw_text") > 5))
        assert text.index("Filter") < text.index("CollectMetrics") < text.index("Exchange")


def test_tables_of_one_split_per_core_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "t")
    spark.range(100).repartition(cores).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        rows = spark.read.parquet(path)
        assert cores <= rows.rdd.getNumPartitions() < 2 * cores
        assert "Exchange" in plan(spread(rows))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
