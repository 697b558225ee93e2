"""The index gives what a scan gives, and opens only what it needs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import dashboard, search_index

SCHEMA = "batch_id string, rank bigint, name string, matched_skills array<string>"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    random.seed(11)
    letters = "abcÉ 12"
    rows = [(f"b{i % 3}", i, "".join(random.choices(letters, k=random.randint(0, 8))),
             ["".join(random.choices(letters, k=random.randint(0, 6))) for _ in range(random.randint(0, 3))])
            for i in range(400)]
    rows += [("b0", 900, None, None), ("b0", 901, "aaaaaaa", None), ("b0", 902, None, [None, "xyzzy", "xyzzy"])]
    folder = str(tmp_path_factory.mktemp("index"))
    spark.createDataFrame(rows, SCHEMA).withColumn("gram", F.lit("x")).write.parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    search_index.write(stored, f"{folder}/index")
    return stored, f"{folder}/index"


@pytest.mark.parametrize("most", [1000, 2], ids=["fetched", "joined"])
def test_equals_the_scan(spark, indexed, most, monkeypatch):
    monkeypatch.setattr(search_index, "FETCHED", most)
    rows, path = indexed
    for text in ["abc", "AB", "", "éÉ ", "aaaa", "xyzzy", "nobody", "c 1", "a b", "abca"]:
        got = search_index.search(rows, path, text).collect()
        assert sorted(map(str, got)) == sorted(map(str, dashboard.search(rows, text).collect())), text


def test_reads_what_is_posted(indexed):
    rows, path = indexed
    plan = search_index.search(rows, path, "xyzzy")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rank,902)" in plan or "In(rank, [902])" in plan
    plan = search_index.posted(rows.sparkSession, path, "xyzzy")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_no_candidates(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    search_index.write(rows, str(tmp_path / "none"))
    assert search_index.search(rows, str(tmp_path / "none"), "abc").collect() == []
