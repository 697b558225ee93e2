"""Resumes and jobs derived from the ``customer`` table, row by row.

The text is built by one SQL expression that Spark and DuckDB both accept, so either engine can derive the same
rows from the same keys. ``k`` is the customer key. Batch 0 holds a third of all rows; other batches hold at most
67 customers each, so batches and jobs grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.catalog.registry import sql_text
from winnow.operators.features import boundary
from winnow.operators.slices import spread

K = "c_custkey"
AS_OF_YEAR = 2026

# Skill names the derived resumes list.
LISTED_SKILLS = [
    "Python", "Java", "C++", "JavaScript", "React", "Node.js", "AWS", "Docker", "Kubernetes", "SQL", "MongoDB",
    "PostgreSQL", "Machine Learning", "Data Science", "TensorFlow", "PyTorch", "DevOps", "CI/CD", "Git", "Agile",
    "Scrum", "UI/UX", "Figma", "HTML", "CSS", "TypeScript", "Angular", "Vue.js", "Spring Boot", "Django", "Flask",
    "FastAPI", "Ruby on Rails", "C#", ".NET",
]

JOBS = [
    "Python, SQL and Docker engineer with AWS and Kubernetes; computer science degree",
    "Full stack developer",
    "Mobile development lead",
    "Pastry chef wanted",
    "",
    "Data engineer for machine learning, physics background welcome",
    "DevOps backend engineer, Java, spring boot, C++11 and CI/CD",
    "Marketing lead: SEO, content marketing, Google Ads and A/B testing; onboarding of partners",
    "Accountant with excel, general ledger, GAAP and SAP",
    "Clinical research nurse, patient care, ICD-10 and GMP",
    "Mechanical engineer: AutoCAD, FEA, GD&T, six sigma and logistics",
    "HR operations partner, talent acquisition, onboarding, logistics and OKRs",
]

# Terms of the other fields that the derived resumes list.
FIELD_TERMS = {
    0: "SEO, SEM, Content Marketing, A/B Testing, Onboarding",
    1: "Excel, General Ledger, GAAP, SAP, Financial Modeling",
    2: "Clinical Trials, GMP, ICD-10, Patient Care, Nursing",
    3: "AutoCAD, FEA, GD&T, Six Sigma, Logistics, HVAC",
    4: "Talent Acquisition, Onboarding, Logistics, OKRs, Six Sigma Green Belt",
}


def _choose(by: str, options: dict[int, str], otherwise: str = "''") -> str:
    branches = " ".join(f"WHEN {value} THEN {text}" for value, text in options.items())
    return f"(CASE {by} {branches} ELSE {otherwise} END)"


def _when(condition: str, text: str) -> str:
    return f"(CASE WHEN {condition} THEN {text} ELSE '' END)"


def _text(*parts: str) -> str:
    """One line made of SQL expressions and, where they start with ``=``, literal text."""
    items = [sql_text(p[1:]) if p.startswith("=") else p for p in parts]
    return items[0] if len(items) == 1 else f"concat({', '.join(items)})"


def _lines(*lines: str) -> str:
    """Text lines, each ended by a line break; ``=`` marks literal text."""
    return "concat(" + ", ".join(f"{_text(line)}, chr(10)" for line in lines) + ")"


def _skill(j: int) -> str:
    names = ",".join(LISTED_SKILLS)
    return f"split_part('{names}', ',', CAST(({K} * 7 + {j * 11}) % 35 + 1 AS INT))"


def _skill_list() -> str:
    parts = [_skill(0)]
    for j in range(1, 10):
        text = f"concat(', ', {_skill(j)})"
        parts.append(text if j <= 2 else _when(f"{j - 2} <= {K} % 8", text))
    return f"concat({', '.join(parts)})"


KEY = f"CAST({K} AS VARCHAR(20))"
_START = f"CAST(2005 + {K} % 10 AS VARCHAR(4))"
_END = f"(CASE WHEN {K} % 4 = 0 THEN 'Present' ELSE CAST(2008 + {K} % 10 AS VARCHAR(4)) END)"
_CONTACT = _choose(f"{K} % 4", {
    0: _text("=user", KEY, "=@mail.example"),
    1: _text("=Phone +1 (555) 010-2345"),
    2: _text("=linkedin.com/in/user", KEY),
}, "'Somewhere'")
_STATED = _choose(f"{K} % 7", {
    0: _text(f"CAST({K} % 12 AS VARCHAR(4))", "=+ years of experience in delivery"),
    1: _text("=40 years of work experience"),
}, "'Builds data pipelines'")


def _work() -> str:
    heading = _choose(f"{K} % 4", {0: "'Work Experience'", 2: "'EMPLOYMENT HISTORY :'"}, "'Experience'")
    job = _text("=Engineer - Tech Corp (", _START, "=-", _END, "=)")
    second = _when(f"{K} % 2 = 0", _lines("=Analyst, Acme Ltd 2001 to 2003"))
    warranty = _when(f"{K} % 11 = 0", _lines("=3 years warranty desk"))
    return f"concat({_lines(heading, job)}, {second}, {warranty}, chr(10))"


def _certificates() -> str:
    return _choose(f"{K} % 4", {
        1: _lines("=Certifications", "=AWS Certified Developer", "=Google Cloud Engineer, 2020",
                  "=aws certified developer", "=PMP", "=Sql Expert Award", "=sql expert award"),
        2: _lines("=Certificates: Certified Scrum Master; Coursera machine learning"),
    })


def _education() -> str:
    heading = _choose(f"{K} % 2", {0: "'Education'"}, "'Academic Background:'")
    degree = _choose(f"{K} % 5", {
        0: "'Ph.D in Physics'", 1: "'M.Sc in Computer Science'", 2: "'B.S. in Computer Science'",
        3: "'Diploma in Design'"}, "'Self taught'")
    return _when(f"{K} % 13 <> 0", _lines(heading, degree, "=2010 - 2014 State University"))


def _projects() -> str:
    block = "=large migration of billing data to a new warehouse with python and sql jobs for nightly loads"
    kind = f"(CASE WHEN {K} % 12 = 10 THEN 10 ELSE {K} % 6 END)"
    return _choose(kind, {
        0: _lines("=Projects", "=- Web shop built with react and node.js for sales",
                  "=  with a full stack of html and css", "=- Chat service in python and docker", "=* tiny"),
        1: _lines("=Personal Projects", "=E-commerce Website", "=built with django and sql", "=",
                  "=AI Chatbot System", "=uses tensorflow for machine learning", "=notes 2019-2020 developing"),
        2: _lines("=Projects", block, block, block, "=", block, block),
        3: _lines("=Project Title: Parser", "=uses python and sql", "=Project - Mobile app", "=in typescript"),
        4: _lines("=Projects", "=- tiny one", "=- small two"),
        5: _lines("=Projects: Data lake with sql and python on aws"),
    })


def _resume() -> str:
    skills = _skill_list()
    fields = _choose(f"{K} % 7", {n: sql_text(terms) for n, terms in FIELD_TERMS.items()})
    section = _choose(f"{K} % 3", {
        0: _lines("=Skills", skills, fields),
        1: _lines(_text("=Technical Skills: ", skills), fields),
        2: _lines("=  CORE COMPETENCIES : ", skills, "=c++11, javascript"),
    })
    stuffing = _when(f"{K} % 20 = 7", f"repeat(concat({skills}, ' '), 100)")
    head = _lines(_text("=Candidate ", KEY), _CONTACT, "=Summary", _STATED)
    headed = (f"concat({head}, {section}, {_work()}, {_certificates()}, {_education()}, {_projects()}, {stuffing})")
    plain = _lines(
        _text("=Candidate ", KEY, "= ", _CONTACT), skills,
        _text("=Worked at Acme Solutions ", _START, "= - ", _END, "= as developer"), "=",
        "=Likes hiking", "=and chess", "=and tea", "=and books", "=Master thesis 2011-2013", _STATED)
    return f"(CASE WHEN {K} % 17 = 5 THEN {plain} ELSE {headed} END)"


def skill_list_sql() -> str:
    return _skill_list()


def raw_text_sql() -> str:
    return _resume()


def filename_sql() -> str:
    return _choose(f"{K} % 8", {
        0: _text("=resume.pdf"),
        1: _text("=jane-o'neil", KEY, "=.cv.docx"),
        2: _text("=CV_Resume_", KEY, "=.docx"),
        3: _text("=Cvetkov_", KEY, "=_resume.doc"),
        4: _text("=mary_ann-smith_", KEY, "=.docx"),
    }, _text("=candidate_", KEY, "=_resume.docx"))


def batch_sql() -> str:
    return f"(CASE WHEN {K} % 3 = 0 THEN 0 ELSE 1 + CAST(floor({K} / 100.0) AS BIGINT) END)"


def job_sql(batch: str = "batch_no") -> str:
    return _choose(f"{batch} % {len(JOBS)}", {i: f"'{text}'" for i, text in enumerate(JOBS)})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id, resume_id, ordinal, filename, raw_text`` and the batch number."""
    return boundary(spread(table(spark, folder, "customer").select(K)).select(
        F.expr(f"concat('b', CAST({batch_sql()} AS VARCHAR(20)))").alias("batch_id"),
        F.col(K).alias("resume_id"),
        F.col(K).alias("ordinal"),
        F.expr(filename_sql()).alias("filename"),
        F.expr(raw_text_sql()).alias("raw_text"),
    ))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id, job_description, batch_no``, one row per batch."""
    numbers = table(spark, folder, "customer").select(F.expr(batch_sql()).alias("batch_no")).distinct()
    return numbers.select(
        F.expr("concat('b', CAST(batch_no AS VARCHAR(20)))").alias("batch_id"),
        F.expr(job_sql()).alias("job_description"),
        "batch_no",
    )


RESUMES_SQL = f"""
SELECT concat('b', CAST({batch_sql()} AS VARCHAR(20))) AS batch_id, {K} AS resume_id, {K} AS ordinal,
       {filename_sql()} AS filename, {raw_text_sql()} AS raw_text
FROM customer"""

JOBS_SQL = f"""
SELECT concat('b', CAST(batch_no AS VARCHAR(20))) AS batch_id, {job_sql()} AS job_description, batch_no
FROM (SELECT DISTINCT {batch_sql()} AS batch_no FROM customer)"""
