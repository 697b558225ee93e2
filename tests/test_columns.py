"""Column functions against plain Python on small inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from winnow import fixed, vocabulary
from winnow.functions import projects, sections, skills, vectors
from winnow.functions.common import alternatives, exact_round, nested, text_lines


def test_exact_round_equals_python(spark):
    values = [i / 20 for i in range(2001)] + [a / b * 100 for b in (*range(1, 41), 302) for a in range(b + 1)]
    values += [0.35, 66.65, 2.675, 1.005, 0.125, 0.375, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = df.select("v", *[exact_round(F.col("v"), d).alias(f"r{d}") for d in (1, 2, 3)]).collect()
    wrong = [(r["v"], d) for r in out for d in (1, 2, 3) if r[f"r{d}"] != round(r["v"], d)]
    assert not wrong


def test_matching_equals_one_search_per_term(spark):
    rng = random.Random(1)
    pieces = ["sql", "sql for finance", "finance", "java", "javascript", "c++", "c++11", "c#", "node.js", "node",
              "supply chain", "supply chain management", "management", "six sigma", "six sigma green belt", "go",
              "google", ",", ".", "\n", "été", "_", "x"]
    terms = ["sql", "sql for finance", "java", "javascript", "c++", "c#", "node.js", "node", "supply chain",
             "supply chain management", "management", "six sigma", "six sigma green belt", "go", "sql"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randint(0, 14)))
             for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = df.select("t", skills.matched_skills(F.col("t"), terms).alias("m")).collect()
    for r in one:
        expected = [t for t in terms if re.search(r"\b" + re.escape(t) + r"\b", r["t"].lower())]
        assert r["m"] == expected, r["t"]


def test_long_vocabulary_uses_several_patterns(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "TERMS_PER_PATTERN", 2)
    terms = ["sql", "data", "sql for finance", "finance", "python"]
    df = spark.createDataFrame([("Python and sql for finance",)], "t string")
    assert df.select(skills.matched_skills(F.col("t"), terms).alias("m")).head()["m"] == [
        "sql", "sql for finance", "finance", "python"]


def test_vocabulary_files(spark, tmp_path):
    plain, table = tmp_path / "terms.txt", tmp_path / "terms.csv"
    plain.write_text("SQL\n\nData Mining\n")
    table.write_text("category,skill\nit,Python\nhr,Onboarding\n")
    assert vocabulary.load(spark, str(plain)) == ("sql", "data mining")
    assert vocabulary.load(spark, str(table), "skill") == ("python", "onboarding")
    assert [tuple(r) for r in vocabulary.as_table(spark, ("a", "b")).collect()] == [(1, "a"), (2, "b")]


def test_nested_patterns_accept_the_same_texts():
    for pattern in (fixed.EDUCATION_CONTEXT, fixed.PROJECT_CONTEXT, fixed.WORK_CONTEXT, fixed.COMPANY_TOKEN):
        again = re.compile(nested(alternatives(pattern)))
        plain = re.compile(pattern)
        for text in ("adobe name", "since", "mini project", "b.tech", "worked at", "12th grade", "pvt. ltd", "inc",
                     "nothing here", "m.e", "full-time", "team lead", "course  work", ""):
            assert bool(again.search(text)) == bool(plain.search(text)), (pattern, text)


def test_contexts_are_unanchored(spark):
    df = spark.createDataFrame([("Adobe",), ("Name",), ("since",), ("zzz",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(sections.is_education(t), sections.is_project(t), sections.is_work(t)).collect()]
    assert got == [(True, False, False), (True, False, False), (False, False, True), (False, False, False)]


@pytest.mark.parametrize("section, headings", [
    ("work", ["Work Experience", "WORK HISTORY:", "positions held", "Internship & Experience", "internships", "work"]),
    ("education", ["Education", "Academic Qualifications", "degrees", "qualification :"]),
    ("projects", ["Project", "Capstone Projects", "mini project", "SideProjects"]),
    ("skills", ["Skill", "Core Competencies", "Area of expertise", "Tools and Technologies", "proficiency"]),
    ("certificates", ["Certification", "Licenses & Certifications", "training", "courses:"]),
    ("summary", ["Summary", "About me", "career objective", "profile"]),
])
def test_every_section_has_its_headings(spark, section, headings):
    df = spark.createDataFrame([(h,) for h in headings], "h string")
    assert {r[0] for r in df.select(sections.standalone_heading(F.col("h"))).collect()} == {section}


def test_vectors(spark):
    df = spark.createDataFrame([("b a b", "A c"), ("", "a"), ("x", "y")], "l string, r string")
    left, right = vectors.term_vector(F.col("l")), vectors.term_vector(F.col("r"))
    rows = df.select(left.alias("v"), vectors.cosine(left, right).alias("c")).collect()
    assert rows[0]["v"] == {"a": 1.0, "b": 2.0}
    assert rows[0]["c"] == pytest.approx(1 / (5 ** 0.5 * 2 ** 0.5))
    assert [r["c"] for r in rows[1:]] == [0.0, 0.0]
    dense = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    cos = [r[0] for r in dense.select(vectors.dense_cosine(F.col("a"), F.col("b"))).collect()]
    assert cos == [pytest.approx(0.5 ** 0.5), 0.0]


def test_relevance_scores(spark):
    df = spark.createDataFrame([([0.5, 0.31, 0.3],), ([0.1, 0.05],), ([0.9, 0.8, 0.7, 0.95],), ([],)], "c array<double>")
    c = F.col("c")
    rows = df.select(vectors.project_relevance(c).alias("p"), vectors.relevant_projects(c).alias("n"),
                     vectors.certificate_relevance(c, 0.1).alias("k")).collect()
    assert [r["n"] for r in rows] == [2, 0, 4, 0]
    assert [r["p"] for r in rows] == [pytest.approx(0.405 + 0.1), 0.0, pytest.approx(0.8375 + 0.15), 0.0]
    assert [r["k"] for r in rows] == [1.0, 0.0, 1.0, 0.0]


def test_chunks_keep_every_line(spark):
    rng = random.Random(2)
    texts = ["\n".join("w" * rng.randint(0, 250) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("lines", text_lines(F.col("t")))
    for r in df.select("t", projects.chunks(F.col("lines")).alias("c")).collect():
        lines = [line for line in r["t"].split("\n") if line]
        assert "\n".join(r["c"]) == "\n".join(lines)
        for chunk in r["c"][:-1]:
            sizes = [len(line) for line in chunk.split("\n")]
            assert sum(sizes) > 300 >= sum(sizes[:-1])


def test_places_inside_words_are_told_before_the_boundary():
    assert vocabulary.patterns(("sql", "c++"))[0].startswith("(?<![A-Za-z0-9_])")
    assert vocabulary.patterns((".net", "sql"))[0].startswith(r"\b")  # may begin behind a letter
