"""Random resumes through the operators and through the SQL twins."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow import config, fixed
from winnow.catalog.registry import with_parts
from winnow.operators import features as feats

LINES = [
    "", "", "  ", "\t", "Work Experience", "work:", "EMPLOYMENT", "Employment: Clerk at Acme", "Education", "Degrees:",
    "Qualification: MBA", "Projects", "Projects: Shop", "Mini Project", "Project: Parser", "Project Title - App",
    "project - x", "Skills", "Key Skills: sql", "Certifications", "Certificate: PMP gold", "Training", "Summary",
    "Profile: keen", "Objective", "Experience", "- bullet one here", "* b", "1. numbered item", "2) other item",
    "title: thing", "A Fine Title", "A fine Title of Two", "the and of", "lower case line of text", "x" * 120, "y" * 301,
    "2001-2004", "from 2010 to present", "2012 - 2010", "Tech Corp 2015-2018", "2003 - now and 2005 to 2007",
    "school 2009-2012", "hackathon 2011-2013", "5 years of experience", "3 years", "12+ years of work experience",
    "worked at a place", "AWS certified dev, licensed plumber", "certification in sql; certified", "Udemy", "gold award",
    "Gold Award", "20190-2020", "developing 2019-developing", "name: value: more", "working at home", "responsibilities",
]


@pytest.fixture(scope="module")
def fuzz(spark):
    rng = random.Random(7)
    rows = [(f"b{i % 3}", i, i, "f.docx", "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 30))))
            for i in range(600)]
    names = ["batch_id", "resume_id", "ordinal", "filename", "raw_text"]
    con = duckdb.connect()
    con.register("fuzz_rows", pd.DataFrame(rows, columns=names))
    df = spark.createDataFrame(rows, "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    df = df.repartition(8)
    parts = feats.section_texts(feats.with_segments(df), fixed.SECTIONS)
    return con, parts


def twin(con, sql: str) -> dict:
    text = with_parts(sql, {"resumes": "SELECT * FROM fuzz_rows"})
    return {r[0]: r[1:] for r in con.execute(text).fetchall()}


def mine(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_sections(fuzz):
    con, parts = fuzz
    columns = ["resume_id", "sections_found", *[f"{s}_text" for s in fixed.SECTIONS]]
    assert mine(parts.select(*columns)) == twin(con, f"SELECT {', '.join(columns)} FROM sectioned")


def test_experience(fuzz):
    con, parts = fuzz
    rows = feats.with_experience(parts, config.scoring(2026)).select("resume_id", "experience_years", "has_experience")
    got = mine(rows)
    assert got == twin(con, "SELECT resume_id, experience_years, has_experience FROM years")
    assert len(set(got.values())) > 10


def test_projects(fuzz):
    con, parts = fuzz
    rows = feats.with_projects(parts).select("resume_id", F.col("projects"))
    got = {k: (v[0] or [],) for k, v in mine(rows).items()}
    assert got == twin(con, "SELECT p.resume_id, coalesce(list(r.project ORDER BY r.n) FILTER (r.project IS NOT NULL), []) "
                            "FROM parsed p LEFT JOIN project_rows r USING (resume_id) GROUP BY p.resume_id")
    assert len({len(v[0]) for v in got.values()}) > 4


def test_certificates(fuzz):
    con, parts = fuzz
    rows = feats.with_certificates(parts).select("resume_id", "certificates")
    assert mine(rows) == twin(con, "SELECT r.resume_id, coalesce(list(c.mention ORDER BY c.n) FILTER (c.mention IS NOT NULL), "
                                   "[]) FROM resumes r LEFT JOIN certificate_rows c USING (resume_id) GROUP BY r.resume_id")
