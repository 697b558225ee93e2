"""Supplied vectors and hashed corpus weights in the plan."""

from __future__ import annotations

import math
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.catalog import fixture
from winnow.config import scoring
from winnow.functions import vectors
from winnow.operators import embedded
from winnow.operators.corpus import cell_of, hashed_corpus
from winnow.plans.screen import compared, screen

FOLDER = "/root/testdata/sf0.001"
SETTINGS = scoring(2026)


def test_vectors_that_cannot_be_compared(spark):
    row = spark.createDataFrame([([1.0, 0.0], None, [1.0, 2.0, 3.0], [[1.0, 1.0], None, [0.0, 0.0]], None)],
                                "a array<float>, none array<float>, longer array<float>, many array<array<float>>, "
                                "no array<array<float>>")
    out = row.select(
        vectors.dense_cosine(F.col("none"), F.col("a")).alias("null"), vectors.dense_cosine(F.col("longer"), F.col("a")).alias("length"),
        vectors.dense_cosines(F.col("many"), F.col("a")).alias("many"), vectors.dense_cosines(F.col("no"), F.col("a")).alias("no")).head()
    assert (out["null"], out["length"], out["no"]) == (0.0, 0.0, [])
    assert out["many"] == [pytest.approx(math.sqrt(0.5)), 0.0, 0.0]


def test_texts_are_listed_and_bound_in_order(spark):
    people = spark.createDataFrame([
        ("b", 1, 1, "a.docx", "Projects\n- Web shop built with react and node\n- Chat service in python and docker\n"
                              "Certifications\nAWS Certified Developer\n"),
        ("b", 2, 2, "b.docx", None)], "batch_id string, resume_id long, ordinal long, filename string, raw_text string")
    texts = embedded.texts_to_embed(people, SETTINGS)
    rows = {(r["resume_id"], r["kind"], r["n"]): r["text"] for r in texts.collect()}
    assert rows[2, "text", 0] == "" and "Web shop" in rows[1, "project", 0] and "Chat" in rows[1, "project", 1]
    assert any(kind == "certificate" for _, kind, _ in rows)
    vectors_of = texts.select("resume_id", "kind", "n", F.array(F.col("n").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    bound = {r["resume_id"]: r for r in embedded.bind_vectors(people, vectors_of).collect()}
    assert bound[1]["project_vectors"] == [[0.0, 1.0], [1.0, 1.0]] and bound[2]["project_vectors"] == []
    jobs = spark.createDataFrame([("b", "")], "batch_id string, job_description string")
    described = embedded.job_texts_to_embed(jobs, SETTINGS).withColumn("vector", F.array(F.lit(1.0), F.lit(1.0)))
    ranked = screen(embedded.bind_vectors(people, vectors_of), embedded.bind_job_vectors(jobs, described), SETTINGS,
                    vectors=embedded.TextVectors()).collect()
    assert {r["resume_id"]: r["relevant_projects_count"] for r in ranked} == {1: 2, 2: 0}
    # without any vector nothing is similar and nothing fails
    bare = screen(embedded.bind_vectors(people, vectors_of.limit(0)), embedded.bind_job_vectors(jobs, described.limit(0)), SETTINGS,
                  vectors=embedded.TextVectors()).collect()
    assert {r["relevant_projects_count"] for r in bare} == {0}


def test_hashed_weights_equal_plain_python(spark):
    texts = ["red red blue", "red green", None, "", "Blue blue BLUE x1"]
    people = spark.createDataFrame(list(enumerate(texts)), "resume_id long, raw_text string")
    bits = 5  # so few that terms share cells
    corpus = hashed_corpus(people, bits)
    cells = lambda text: {int(md5(w.encode()).hexdigest()[:2], 16) >> 3 for w in (text or "").lower().split()}
    df = Counter(c for t in texts for c in cells(t))
    assert corpus.idf == pytest.approx([math.log(6 / (df[c] + 1)) + 1 for c in range(32)])
    at = people.limit(1).select(cell_of(F.lit("red")).alias("c")).head()[0]
    assert at == int(md5(b"red").hexdigest()[:5], 16) >> 2


def test_hashed_comparison_shuffles_no_term(spark):
    people, jobs = fixture.resumes(spark, FOLDER), fixture.jobs(spark, FOLDER)
    rows = compared(people, jobs, SETTINGS, corpus=hashed_corpus(people))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "Generate" not in plan
    plain = {r["resume_id"]: r["skills_match_score"] for r in compared(people, jobs, SETTINGS).collect()}
    hashed = {r["resume_id"]: r["skills_match_score"] for r in rows.collect()}
    assert plain.keys() == hashed.keys() and plain != hashed
    assert np.corrcoef([plain[k] for k in plain], [hashed[k] for k in plain])[0, 1] > 0.5
