from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from winnow import config
from winnow.catalog import fixture
from winnow.operators import dashboard
from winnow.operators.scoring import length_limits
from winnow.plans.screen import screen
from winnow.sources import store
from winnow.streaming import incremental

FOLDER = "/root/testdata/sf0.001"
SETTINGS = config.scoring(2026)


def test_documents_and_corrupt_ones(spark, tmp_path):
    good = {"last_updated": "2024", "total_batches": 1, "total_resumes": 2, "batches": [
        {"batch_id": "x", "uploaded_at": "2024", "candidate_count": 2, "candidates": [
            {"name": "A", "rank": 1, "score": 5, "matched_skills": ["sql"]}, {"name": "B", "rank": 2}]}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text('{"batches": [')
    batches = store.read_document(spark, str(tmp_path)).cache()
    assert batches.filter("_corrupt is not null").count() == 1
    rows = store.with_defaults(store.flatten(batches.filter("batch_id is not null"))).orderBy("rank").collect()
    assert [(r["name"], r["score"], r["matched_skills"], r["job_description"]) for r in rows] == [
        ("A", 5.0, ["sql"], ""), ("B", 0.0, [], "")]
    assert rows[1]["anomaly_reason"] == "" and rows[1]["is_anomaly"] is False


def test_nesting_is_chunked_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(store, "CHUNK_ROWS", 10)
    rows = store.with_defaults(spark.range(55).select(
        F.when(F.col("id") < 40, "hot").otherwise("b").alias("batch_id"), F.lit("t").alias("uploaded_at"),
        F.lit(None).cast("string").alias("job_description"), F.col("id").alias("ordinal"),
        F.col("id").alias("rank"), F.col("id").cast("string").alias("name")))
    nested = store.nest(rows).cache()
    assert nested.agg(F.max("candidate_count"), F.sum("candidate_count")).head()[:] == (10, 55)
    assert sorted(int(r["name"]) for r in store.flatten(nested).collect()) == list(range(55))
    assert sorted((r["batch_id"], r["candidate_count"]) for r in store.headers(nested).collect()) == [("b", 15), ("hot", 40)]
    head = store.totals(nested).head()
    assert (head["total_batches"], head["total_resumes"]) == (2, 55)


def test_a_missing_store_is_empty(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path / "none")).collect() == []


def test_append_keeps_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "store")

    def batch(name, score):
        return spark.createDataFrame([(name, "p", score)], "batch_id string, name string, score double")

    store.append(batch("a", 1.0), path)
    store.append(batch("b", 2.0), path)
    store.replace_batches(batch("a", 3.0), path)
    assert sorted((r["batch_id"], r["score"]) for r in store.read_store(spark, path).collect()) == [
        ("a", 3.0), ("b", 2.0)]


def test_manifest_and_epochs(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.store_totals(spark, path).head()[:] == (None, 0, 0) and store.newest_batch(spark, path).count() == 0

    def batch(name, at, n):
        return spark.range(n).select(F.lit(name).alias("batch_id"), F.lit(at).alias("uploaded_at"), F.col("id").alias("rank"),
                                     F.lit(None).cast("string").alias("job_description"), F.lit(f"{name}{at}").alias("name"))

    store.append(batch("a", "2024-01-01", 3), path)
    store.append(batch("b", "2024-01-03", 4).unionByName(batch(None, "2024-01-02", 1)), path)
    store.append(batch("a", "2024-01-02", 2), path)  # a batch that grows
    assert store.store_totals(spark, path).head()[:] == ("2024-01-03", 3, 10)
    assert [r["name"] for r in store.newest_batch(spark, path).collect()] == ["b2024-01-03"] * 4
    assert store.read_batch(spark, path, "a").count() == 5 and store.read_batch(spark, path, "none").count() == 0
    store.replace_batches(batch("a", "2024-01-04", 1), path)
    store.append(batch("a", "2024-01-05", 1), path)
    assert {(r["batch_id"], r["candidate_count"]) for r in store.batch_headers(spark, path).collect()} == {("a", 2), ("b", 4), ("", 1)}
    before = sorted((r["batch_id"], r["name"]) for r in store.read_store(spark, path).collect())
    store.compact(spark, path)
    assert sorted((r["batch_id"], r["name"]) for r in store.read_store(spark, path).collect()) == before and len(before) == 7
    assert store.manifest(spark, path).select("epoch").distinct().count() == 1
    # rows of a write that never reached the manifest do not count
    store.with_defaults(batch("b", "2025", 9)).write.parquet(f"{path}/rows/epoch=00000099-x")
    assert store.read_store(spark, path).count() == 7 and store.read_batch(spark, path, "b").count() == 4


def test_many_batches_give_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(spark.range(20_000).select(F.concat(F.lit("b"), F.col("id")).alias("batch_id"), F.lit("n").alias("name")), path)
    assert len(list((tmp_path / "store" / "rows").rglob("*.parquet"))) <= 8
    assert store.read_batch(spark, path, "b777").count() == 1 and store.store_totals(spark, path).head()[1] == 20_000


def test_documents_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHUNK_ROWS", 4)
    rows = store.with_defaults(spark.range(10).select(
        F.when(F.col("id") < 7, "x").otherwise("y").alias("batch_id"), F.lit("2024").alias("uploaded_at"),
        F.lit('quote " and é').alias("job_description"), F.col("id").alias("ordinal"), F.col("id").alias("rank"),
        F.concat(F.lit("n"), F.col("id")).alias("name"), F.array(F.lit("c++")).alias("matched_skills")))
    nested = store.nest(rows).cache()
    store.write_document(nested, str(tmp_path / "one"))
    text = next((tmp_path / "one").glob("part-*")).read_text()
    document = json.loads(text)
    assert list(document) == ["last_updated", "total_batches", "total_resumes", "batches"]
    assert [(b["batch_id"], b["candidate_count"], [c["rank"] for c in b["candidates"]]) for b in document["batches"]] == [
        ("x", 7, list(range(7))), ("y", 3, [7, 8, 9])]
    assert document["total_batches"] == 2 and document["total_resumes"] == 10 and list(document["batches"][0]["candidates"][0]) == store.FIELDS
    store.write_documents(nested, str(tmp_path / "lines"))
    for batches in (store.read_document(spark, str(tmp_path / "one")), store.read_document(spark, str(tmp_path / "lines"), lines=True)):
        back = store.flatten(batches)
        assert sorted(back.select("batch_id", *store.FIELDS).collect(), key=str) == sorted(
            rows.select("batch_id", *store.FIELDS).collect(), key=str)
    with pytest.raises(ValueError, match="one document"):
        store.write_document(nested, str(tmp_path / "no"), most=9)


def test_batch_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "store")
    ids = ["007", "7", "2024-01-01", "1e5"]
    store.append(spark.createDataFrame([(b, "n") for b in ids], "batch_id string, name string"), path)
    assert sorted(r["batch_id"] for r in store.read_store(spark, path).collect()) == sorted(ids)


def test_latest_batch_of_an_empty_store(spark):
    empty = spark.createDataFrame([], "batch_id string, uploaded_at string, name string")
    assert store.latest_batch(empty).count() == 0


def test_csv_quotes(spark, tmp_path):
    rows = store.with_defaults(spark.createDataFrame(
        [("b", 2, 'Jo "J" Doe', ["sql", "c++"]), ("b", 1, "A, B", [])],
        "batch_id string, rank bigint, name string, matched_skills array<string>"))
    store.write_csv(rows, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    lines = text.strip().split("\n")
    assert lines[0].split(",")[:3] == ["Rank", "Name", "Score"]
    assert lines[1].startswith('1,"A, B",0.0,0,No,0,') and lines[2].startswith('2,"Jo ""J"" Doe",0.0,0,No,0,"sql, c++"')


def test_dashboard(spark):
    rows = spark.createDataFrame(
        [(1, "Ann Lee", 80.0, ["sql"], False), (2, "Bob Roe", 40.0, ["PostgreSQL"], True), (3, "Cy", 29.9, [], True)],
        "rank bigint, name string, score double, matched_skills array<string>, is_anomaly boolean").cache()
    assert [r["rank"] for r in dashboard.filtered(rows, "SQL").collect()] == [1, 2]
    assert [r["rank"] for r in dashboard.filtered(rows, "", flagged_only=True, n=1).collect()] == [2]
    assert [r["rank"] for r in dashboard.filtered(rows, "zzz").collect()] == []
    s = dashboard.summary(rows).head()
    assert (s["total"], s["avg_score"], s["top_candidate"], s["anomalies"]) == (3, 50.0, "Ann Lee", 2)
    assert {(r["band"], r["n"]) for r in dashboard.score_bands(rows).collect()} == {("high", 1), ("medium", 1), ("low", 1)}
    assert [r["name"] for r in dashboard.chart(rows).collect()] == ["Ann", "Bob", "Cy"]


@pytest.fixture(scope="module")
def at_once(spark):
    rows = screen(fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER), SETTINGS)
    return sorted((r["batch_id"], r["rank"], r["filename"], r["score"], r["is_anomaly"]) for r in rows.collect())


def test_stream_equals_batch_and_replays(spark, tmp_path, at_once):
    arrived, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows, jobs = fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER)

    def run(progress: str):
        arrivals = incremental.read_arrivals(spark, arrived, files_per_trigger=1)
        incremental.screen_arrivals(arrivals, jobs, out, SETTINGS, progress=progress)
        stored = incremental.candidates(spark, out, SETTINGS)
        return sorted((r["batch_id"], r["rank"], r["filename"], r["score"], r["is_anomaly"]) for r in stored.collect())

    rows.filter("resume_id % 2 = 0").coalesce(1).write.parquet(arrived)
    assert len(run("p1")) < len(at_once)
    rows.filter("resume_id % 2 = 1").coalesce(1).write.mode("append").parquet(arrived)
    assert run("p1") == at_once
    assert run("p1") == at_once  # nothing new
    few = incremental.candidates(spark, out, SETTINGS, ["b0"])
    assert sorted((r["rank"], r["filename"]) for r in few.collect()) == [(r[1], r[2]) for r in at_once if r[0] == "b0"]


def test_compacted_stream(spark, tmp_path, at_once):
    """Three arrivals with compactions between: ranks, first candidates and limits stay those of the whole; a replay of a
    compacted micro-batch, a compaction without its commit and scores without parts change nothing."""
    arrived, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows, jobs = fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER)

    def read(**chosen):
        found = incremental.candidates(spark, out, SETTINGS, **chosen)
        return sorted((r["batch_id"], r["rank"], r["filename"], r["score"], r["is_anomaly"]) for r in found.collect())

    for third in range(3):
        rows.filter(F.col("resume_id") % 3 == third).coalesce(1).write.mode("append").parquet(arrived)
        incremental.screen_arrivals(incremental.read_arrivals(spark, arrived), jobs, out, SETTINGS)
        if third < 2:
            incremental.compact(spark, out)
    assert read() == at_once
    assert read(first=2) == [r for r in at_once if r[1] <= 2]
    old = spark.read.parquet(f"{out}/scores/epoch=0")
    again = str(tmp_path / "again")
    old.write.parquet(again)
    spark.read.parquet(again).write.mode("append").parquet(f"{out}/scores/epoch=0")  # replay, twice the rows
    spark.read.parquet(again).write.parquet(f"{out}/scores/epoch=9")  # no parts yet
    assert read() == at_once
    spark.read.parquet(again).write.parquet(f"{out}/compacted/broken/scores")
    incremental.compact(spark, out)
    incremental.compact(spark, out)  # nothing new
    assert spark.read.parquet(f"{out}/compactions").count() == 3
    assert read() == at_once and read(batches=["b0"]) == [r for r in at_once if r[0] == "b0"]
    found = incremental.limits(spark, out, ["b0", "b1"])
    files = found.inputFiles()
    assert files and not any("/scores/" in f for f in files)
    plain = length_limits(rows.withColumn("text_length", F.length("raw_text"))).filter("batch_id in ('b0', 'b1')")
    assert sorted(map(tuple, found.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError, match="slice_rows"):
        incremental.candidates(spark, out, replace(SETTINGS, slice_rows=7))


def test_stream_before_anything_arrived(spark, tmp_path):
    assert incremental.candidates(spark, str(tmp_path / "none"), SETTINGS).collect() == []
    assert incremental.limits(spark, str(tmp_path / "none")) is None
    incremental.compact(spark, str(tmp_path / "none"))
