from __future__ import annotations

import csv
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow import config, fixed
from winnow.catalog.train_queries import model_rows
from winnow.operators import training as t
from winnow.operators.slices import materialize
from winnow.plans import train as plans
from winnow.plans.screen import blended_scores
from winnow.catalog import fixture
from winnow.sources import sheet

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 1.0], [5.0] * 50, list(np.random.default_rng(0).normal(size=500)),
    [0.0] * 300 + [1e-9 * i for i in range(100)] + [1e6], [0.1, 0.1, 0.2, 0.30000000000000004, 0.3],
])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    for q in (0.0, 0.25, 0.5, 0.75, 1.0):
        assert math.isclose(t.exact_quantile(df, "v", q), float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-15)


def test_labels_move_the_threshold_only_when_needed(spark):
    even = spark.createDataFrame([(i / 10,) for i in range(10)], "quality_score double")
    assert t.label_threshold(even) == fixed.STRONG_THRESHOLD
    low = spark.createDataFrame([(i / 100,) for i in range(21)], "quality_score double")
    labelled = t.pseudo_labels(low)
    assert labelled.head()["threshold"] == pytest.approx(0.15)
    assert labelled.filter("shortlisted = 1").count() == 6


def test_split_folds_and_weights(spark):
    rows = materialize(spark.range(103).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")))
    split = t.stratified_split(rows, "y", "id")
    counts = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert counts == {(0, True): 19, (0, False): 73, (1, True): 3, (1, False): 8}
    folds = t.stratified_folds(rows, "y", "id")
    sizes = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert all(max(v for (y, _), v in sizes.items() if y == c) - min(v for (y, _), v in sizes.items() if y == c) <= 1
               for c in (0, 1))
    weights = {r["y"]: r["weight"] for r in t.balance_weights(rows, "y").collect()}
    assert weights == {0: pytest.approx(103 / (2 * 92)), 1: pytest.approx(103 / (2 * 11))}


def test_report_without_one_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "y int, p int")
    report = {r["class"]: r for r in t.class_report(rows, "y", "p").collect()}
    assert report["Strong"]["precision"] == 0.0 and report["Strong"]["support"] == 0
    assert report["Weak"]["recall"] == pytest.approx(2 / 3)
    assert report["accuracy"]["f1"] == pytest.approx(2 / 3)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in t.confusion(rows, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 0}


@pytest.mark.parametrize("split", ["100", "100000"])
def test_sheet_cells_with_line_breaks(spark, tmp_path, split):
    """Any split of the files gives the records of a plain CSV reader."""
    random.seed(3)
    cells = ["", "a", "b,c", 'say "x"', "two\nlines", "\n", "end\n\n", '"', "\n,\n", "long " * 30]
    expected = []
    for name in ("a.csv", "b.csv"):
        rows = [[f"{name}{i}", random.choice(cells), random.choice(cells)] for i in range(60)]
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["Skills", "Other", "JobRole"])
            out.writerows(rows)
        expected += [(r[0], r[2] or None) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = sheet.read_sheet(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r["Skills"], r["JobRole"]) for r in found), key=key) == sorted(expected, key=key)


def test_sheet_columns_may_be_missing(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Skills,Experience_Years,JobRole\n"python, sql",5,analyst\n,,\n')
    rows = sheet.read_sheet(spark, str(path))
    out = sheet.synthesize(rows).collect()
    assert [(r["raw_text"], r["job_description"]) for r in out] == [
        ("python, sql  5 years experience  ", "analyst"), ("  nan years experience  ", "software engineer")]


def test_sheet_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Note,Email,JobRole,Experience_Years,Skills\nx,a@b.c,analyst,5,python\n")
    row = sheet.read_sheet(spark, str(path)).head().asDict()
    assert row == {"Skills": "python", "Experience_Years": "5", "Email": "a@b.c", "JobRole": "analyst"}


def test_a_file_uploaded_again_counts_once(spark):
    stored = spark.createDataFrame(
        [(1, "b2", "2024-01-02", 0, "cv.pdf", "later"), (2, "b1", "2024-01-01", 0, "cv.pdf", "earlier"),
         (3, "b1", "2024-01-01", 1, "other.pdf", "text"), (4, "b0", "2023-01-01", 0, "cv.pdf", " ")],
        "row_id long, batch_id string, uploaded_at string, ordinal long, filename string, raw_text string"
    ).selectExpr("*", "cast(null as string) AS job_description", "array('sql') AS matched_skills")
    rows = spark.createDataFrame([], "row_id long, Skills string, Experience_Years string, JobRole string")
    frame = plans.training_frame(rows, stored)
    assert sorted(r["row_id"] for r in frame.collect()) == [2, 3]


def test_quantile_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows"):
        t.exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5)


def test_years_by_source(spark):
    rows = spark.createDataFrame([(True, "7.9"), (True, "40"), (True, "many"), (True, None), (False, "3")],
                                 "s boolean, y string")
    out = rows.select(t.years_by_source(F.col("s"), F.col("y"), F.lit(11)).alias("y")).collect()
    assert [r["y"] for r in out] == [7, 25, 11, 11, 11]


@pytest.fixture(scope="module")
def trained(spark):
    rows = materialize(model_rows(spark, FOLDER))
    return rows, plans.train(rows, trees=15)


def test_forest_properties(spark, trained, tmp_path):
    rows, (model, report, cells) = trained
    out = t.predict(model, rows)
    assert out.filter("probability_strong < 0 or probability_strong > 1").count() == 0
    assert out.count() == rows.count()
    importances = t.importances(model, spark).collect()
    assert [r["feature"] for r in importances] != [] and sum(r["importance"] for r in importances) == pytest.approx(1)
    assert [r["importance"] for r in importances] == sorted(r["importance"] for r in importances)
    held_out = sum(r["n"] for r in cells.collect())
    support = {r["class"]: r["support"] for r in report.collect()}
    assert support["accuracy"] == held_out == support["Weak"] + support["Strong"]
    path = str(tmp_path / "model")
    assert t.load_model(spark, path) is None
    t.save_model(model, path)
    again = t.predict(t.load_model(spark, path), rows)
    pairs = out.select("row_id", "probability_strong").exceptAll(again.select("row_id", "probability_strong"))
    assert pairs.count() == 0


def test_nulls_count_as_zero(spark, trained):
    _, (model, _, _) = trained
    empty = spark.createDataFrame([(1,)], "row_id int").select(
        "row_id", *[F.lit(None).cast("double").alias(c) for c in fixed.MODEL_FEATURES])
    zero = empty.fillna(0.0)
    a, b = t.predict(model, empty).head(), t.predict(model, zero).head()
    assert a["probability_strong"] == b["probability_strong"] and a["skills_count"] is None


def test_model_takes_part_in_the_score(spark, trained):
    _, (model, _, _) = trained
    settings = config.scoring(2026)
    args = (fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER), settings)
    neutral = {r["resume_id"]: r["score"] for r in blended_scores(*args).collect()}
    blended = {r["resume_id"]: r["score"] for r in blended_scores(*args, model=plans.model_signal(model)).collect()}
    assert neutral.keys() == blended.keys() and neutral != blended
    assert max(abs(neutral[k] - blended[k]) for k in neutral) <= 10.1


def test_cross_validation(spark, trained):
    rows, _ = trained
    folds = t.cross_validate(t.pseudo_labels(rows), "shortlisted", "row_id", trees=3, folds=3).cache()
    assert folds.count() == 3 and folds.agg(F.sum("n")).head()[0] == rows.count()
    s = t.accuracy_summary(folds).head()
    assert 0 <= s["mean_accuracy"] <= 1 and s["std_accuracy"] >= 0


def test_a_fit_uses_all_cores_whatever_the_files(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    class Fit:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            seen.append([len(part) for part in rows.rdd.glom().collect()])
            raise Stop

    monkeypatch.setattr(t, "Pipeline", Fit)
    rows = materialize(spark.range(800).coalesce(1).select((F.col("id") % 2).cast("int").alias("shortlisted"), *[
        (F.col("id") % 9).alias(c) for c in fixed.MODEL_FEATURES]))
    assert rows.rdd.getNumPartitions() == 1
    with pytest.raises(Stop):
        t.fit_forest(rows)
    cores = spark.sparkContext.defaultParallelism
    assert len(seen[0]) == cores and sum(seen[0]) == 800 and max(seen[0]) <= 2 * 800 // cores


@pytest.mark.parametrize("bound, most", [(1, 1), (10**9, 3)])
def test_fits_side_by_side_are_bounded(spark, monkeypatch, bound, most):
    active, peaks, lock = [], [], threading.Lock()

    def fit(rows, label, trees):
        with lock:
            active.append(1)
            peaks.append(len(active))
        time.sleep(1)
        with lock:
            active.pop()

    monkeypatch.setattr(t, "FIT_COUNTS", bound, raising=False)
    monkeypatch.setattr(t, "fit_forest", fit)
    monkeypatch.setattr(t, "predict", lambda model, rows: rows.withColumn("predicted", F.col("y")))
    rows = materialize(spark.range(31).select("id", (F.col("id") % 2).cast("int").alias("y")))
    found = t.cross_validate(rows, "y", "id", trees=2, folds=3).orderBy("fold").collect()
    assert [(r["fold"], r["accuracy"]) for r in found] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert sum(r["n"] for r in found) == 31 and max(peaks) == most


def walk(nodes):
    """Rows of inner nodes and of leaves, from a tree's node table."""
    by_id = {n["id"]: n for n in nodes}
    assert sorted(by_id) == list(range(len(nodes)))
    inner, leaves, stack = [], [], [0]
    while stack:
        node = by_id.pop(stack.pop())
        if node["leftChild"] < 0:
            assert node["rightChild"] < 0 and node["split"]["featureIndex"] == -1
            leaves.append(node)
        else:
            inner.append(node)
            stack += [node["leftChild"], node["rightChild"]]
    assert not by_id  # every node is reached
    return inner, leaves


def trees_at(spark, path):
    found = {}
    for row in t.forest_nodes(path, spark).collect():
        found.setdefault(row["treeID"], []).append(row["nodeData"].asDict(True))
    return found


def test_no_node_of_few_rows_is_split(spark, trained, tmp_path):
    rows, _ = trained
    labelled = materialize(t.pseudo_labels(rows).withColumn("shortlisted", F.when(
        F.col("row_id") % 7 == 0, 1 - F.col("shortlisted")).otherwise(F.col("shortlisted"))))  # noise makes deep trees
    free, pruned = (t.fit_forest(labelled, trees=6, min_split=m) for m in (1, 5))
    free.stages[1].save(str(tmp_path / "free"))
    t.save_model(pruned, str(tmp_path / "pruned"))
    again = t.load_model(spark, str(tmp_path / "pruned"))
    again.stages[1].save(str(tmp_path / "again"))
    before, after = trees_at(spark, str(tmp_path / "free")), trees_at(spark, str(tmp_path / "again"))
    assert before.keys() == after.keys() and len(after) == 6
    smallest = min(n["rawCount"] for nodes in before.values() for n in walk(nodes)[0])
    assert smallest < 5  # there was something to collapse
    for tree in after:
        inner, leaves = walk(after[tree])
        assert all(n["rawCount"] >= 5 for n in inner)
        assert [n["rawCount"] for n in after[tree]].count(after[tree][0]["rawCount"]) >= 1
        assert sum(n["rawCount"] for n in leaves) == after[tree][0]["rawCount"] == before[tree][0]["rawCount"]
        for leaf in leaves:
            assert leaf["prediction"] == float(np.argmax(leaf["impurityStats"]))
    same = t.predict(pruned, rows).select("row_id", "probability_strong").exceptAll(
        t.predict(again, rows).select("row_id", "probability_strong"))
    assert same.count() == 0


def test_other_labels_stop_the_query(spark):
    for wrong in (None, 2, -1):
        rows = spark.createDataFrame([(1, 0), (2, 1), (3, wrong)], "id long, y int")
        for step in (lambda r: t.stratified_split(r, "y", "id"), lambda r: t.stratified_folds(r, "y", "id"),
                     lambda r: t.balance_weights(r, "y")):
            with pytest.raises(Exception, match="must be 0 or 1"):
                step(rows).collect()


def test_quantiles_by_a_coarse_sketch(spark, monkeypatch):
    values = list(np.random.default_rng(2).integers(0, 400, 3000) / 7.0)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(6).cache()
    for size in (10, 40, 400):
        monkeypatch.setattr(t, "SKETCH", size)
        for q in (0.0, 0.1, 0.5, 0.9901, 1.0):
            assert math.isclose(t.exact_quantile(df, "v", q), float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-15)
