"""A vocabulary as a table gives what the vocabulary in the plan gives."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from winnow import config, fixed, vocabulary
from winnow.catalog import fixture
from winnow.functions.skills import matched_skills
from winnow.operators.terms import match_terms

FOLDER = "/root/testdata/sf0.001"
LARGE = config.scoring(2026)
SMALL = config.scoring(2026, broadcast_rows=0)
ODD_TERMS = ("c++", ".net", "c", "c++ c", "a-b", "b", "a", "é", "a_b", "data", "a b", "data", "c#", "b  a", "+")


def plain(rows, terms):
    found = rows.select("resume_id", matched_skills(F.col("raw_text"), terms).alias("m")).collect()
    return {r["resume_id"]: r["m"] or [] for r in found}


def by_table(rows, terms, settings):
    table = vocabulary.as_table(rows.sparkSession, terms)
    out = match_terms(rows, table, settings, ["resume_id"]).collect()
    assert all(r["skills_count"] == len(r["matched_skills"]) for r in out)
    return {r["resume_id"]: r["matched_skills"] for r in out}


@pytest.mark.parametrize("settings", [LARGE, SMALL], ids=["broadcast", "shares"])
def test_default_vocabulary(spark, settings):
    rows = fixture.resumes(spark, FOLDER).select("resume_id", "raw_text")
    assert by_table(rows, tuple(fixed.SKILLS), settings) == plain(rows, tuple(fixed.SKILLS))


@pytest.mark.parametrize("settings", [LARGE, SMALL], ids=["broadcast", "shares"])
def test_odd_terms_and_texts(spark, settings):
    random.seed(5)
    pieces = ["c++", ".net", "c", " ", "  ", "a-b", "é", "É", "a", "b", "_", "+", "\n", "DATA", "#", "c# ", "́", "."]
    texts = [None, "", " ", "+", ".net", "c++"] + ["".join(random.choices(pieces, k=random.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "resume_id bigint, raw_text string")
    expected = plain(rows, ODD_TERMS)
    assert any(expected.values()) and by_table(rows, ODD_TERMS, settings) == expected


def test_edges(spark):
    rows = spark.createDataFrame([(1, "data a", "x"), (1, "b", "y"), (None, "a", "z")],
                                 "resume_id bigint, raw_text string, ord string")
    table = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "data"), (3, None), (4, "")], "ord int, skill string")
    got = {r["resume_id"]: r["matched_skills"] for r in match_terms(rows, table, LARGE, ["resume_id"]).collect()}
    assert got == {1: ["a", "b", "data"], None: ["a"]}
    none = match_terms(rows, table.limit(0), LARGE, ["resume_id"]).collect()
    assert {r["resume_id"]: r["matched_skills"] for r in none} == {1: [], None: []}
    assert match_terms(rows.limit(0), table, LARGE, ["resume_id"]).collect() == []


def test_long_text_and_large_vocabulary(spark):
    """Two hundred thousand terms of two words equal one search per term, and do not grow the plan."""
    def terms(n):
        return spark.range(n).select(
            F.col("id").cast("int").alias("ord"),
            F.concat(F.lit("w"), F.col("id") % 997, F.lit(" v"), (F.col("id") / 997).cast("int")).alias("skill"))

    random.seed(7)
    texts = [" ".join(random.choice([f"w{random.randrange(1000)}", f"v{random.randrange(210)}"])
                      for _ in range(n)) for n in (5, 300, 20_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "resume_id bigint, raw_text string")
    found = match_terms(rows, terms(200_000), LARGE, ["resume_id"])
    got = {r["resume_id"]: r["matched_skills"] for r in found.collect()}
    listed = [r["skill"] for r in terms(200_000).orderBy("ord").collect()]
    for at, text in enumerate(texts):
        words = text.split(" ")
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
        assert got[at] == [t for t in listed if t in pairs]
        for term in random.sample(listed, 200):
            assert (term in got[at]) == bool(re.search(rf"\b{re.escape(term)}\b", text))

    def size(n):
        plan = match_terms(rows, terms(n), SMALL, ["resume_id"])._jdf.queryExecution().optimizedPlan().toString()
        return len(re.sub(r"\d+", "", plan))

    assert size(200_000) == size(10)


def test_runs_of_a_text_are_found_once(spark):
    rows = spark.createDataFrame([(1, "data a b"), (2, None), (3, " + ")], "resume_id bigint, raw_text string")
    found = match_terms(rows, vocabulary.as_table(spark, ("data a", "b")), LARGE, ["resume_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    searches = re.findall(r"regexp_extract_all\((?:lower\(|coalesce\(|_ahead|array_join)", plan)
    assert len(searches) == 1
    assert {r["resume_id"]: r["matched_skills"] for r in found.collect()} == {1: ["data a", "b"], 2: [], 3: []}
