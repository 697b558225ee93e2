"""Hand-written resumes with hand-derived features: one per behaviour that is easy to get wrong."""

from __future__ import annotations

import pytest

from winnow import config
from winnow.operators.features import features, section_texts, with_segments
from winnow.operators import scoring
from winnow.plans.screen import compared, keyword_scores

YEAR = 2026
SETTINGS = config.scoring(YEAR)

CASES = {
    # name: (filename, text, job)
    "golden": ("james_smith_1.docx", "\n".join([
        "James Smith - Resume", "Summary",
        "Experienced software engineer with a track record of building scalable web applications and data pipelines.",
        "Skills", "Python, SQL", "Experience",
        "Senior Software Engineer - Tech Corp (2018-Present)",
        "- Developed amazing features using modern web technologies.",
        "Software Engineer - Startup Inc (2015-2018)",
        "- Maintained critical infrastructure and improved performance.",
        "Education", "B.S. in Computer Science - University of Technology"]), "Python developer"),
    "symbols": ("a.docx", "knows c++, java", "c++11 and c#"),
    "symbols_word": ("a.docx", "knows c++11, java", ""),
    "split_term": ("a.docx", "machine\nlearning and  machine  learning", ""),
    "inside": ("a.docx", "google going javascript", ""),
    "role": ("a.docx", "React JavaScript TypeScript", "Mobile Development lead"),
    "phone_spaced": ("a.docx", "somewhere 2018 - 2020", ""),
    "phone_tight": ("a.docx", "somewhere 2018-2020", ""),
    "years_without_work": ("a.docx", "Barista 2010-2012", ""),
    "reversed_range": ("a.docx", "Barista 2015 - 2012, 2001 to 2003", ""),
    "open_range": ("a.docx", "Barista 2020 to now", ""),
    "sheet_style": ("a.docx", "Python 5 years experience", ""),
    "stated": ("a.docx", "I have 7+ years of work experience", ""),
    "stated_long": ("a.docx", "99999999999999999999999 years of experience", ""),
    "warranty": ("a.docx", "Work\n3 years warranty desk\n2001 - 2010", ""),
    "work_dates": ("a.docx", "Work Experience:\nClerk 2001-2003\nClerk 2002 - 2004\nEducation\n2010-2020 school", ""),
    "work_cap": ("a.docx", "Employment\nx 2000 - 2020\ny 2000 - 2020", ""),
    "work_across_lines": ("a.docx", "Employment\n2001 -\n2004", ""),
    "no_work_text": ("a.docx", "Skills\nsql\nWork\n\n", ""),
    "windows_lines": ("a.docx", "Skills\r\npython\r\nEducation\r\nMBA\r\n", ""),
    "nbsp_heading": ("a.docx", "x\n Skills \npython", ""),
    "inline": ("a.docx", "Skills: python: sql \nmore\nCertificates:   PMP Expert", ""),
    "bare_colon": ("a.docx", "Skills:\npython", ""),
    "not_heading": ("a.docx", "Experience\nMy skills are many\nSkills and tools", ""),
    "inline_projects": ("a.docx", "Projects: Web shop with django\nProject Title: Parser\nuses python", ""),
    "blocks": ("a.docx", "Project Title: Parser\nuses python\n\nProject - App\nin sql\nEducation\nnot this", ""),
    "bullets": ("a.docx", "Projects\n- Web shop with react\n  continued here\n* tiny\n2) Numbered project here", ""),
    "titles": ("a.docx", "Projects\nE-commerce Website\nbuilt with django\n\nchat bot system\nThe Big Rewrite\n\n"
                         "The Art of Data\nline of text", ""),
    "chunks": ("a.docx", "Projects\n" + "\n".join(["a" * 200, "b" * 150, "", "c" * 100]), ""),
    "whole": ("a.docx", "Projects\n- tiny one\n- small two", ""),
    "mentions": ("a.docx", "AWS Certified Developer, and certified scrum master. Licensed\nCertified", ""),
    "certificate_lines": ("a.docx", "Certified Python Expert\nCertifications\nCertified python expert\nSQL Diploma\n"
                                    "sql diploma\nPMP", ""),
    "degree_max": ("a.docx", "Education\nB.Tech 2010, M.Tech 2012, diploma", ""),
    "degree_text": ("a.docx", "Doctor of Philosophy", ""),
    "degree_none": ("a.docx", "Education\nself taught", "physics and computer science"),
    "bonus_two": ("a.docx", "Education\nB.Sc Computer Science", "computer science role"),
    "bonus_one": ("a.docx", "Education\nB.Sc Computer Science", "computer role"),
    "bonus_stop": ("a.docx", "Education\nB.Sc and the years", "and the years required"),
    "bonus_text": ("a.docx", "plain python developer text", "python developer"),
    "bonus_cap": ("a.docx", "Education\nPhD Computer Science", "computer science"),
    "name_apostrophe": ("shaun_o'neil-CV2.docx", "", ""),
    "name_inside": ("Cvetkov_resume.pdf", "", ""),
    "name_empty": ("resume_12.pdf", "", ""),
    "name_dots": ("john.smith.docx", "", ""),
    "empty": ("e.docx", "", ""),
}


@pytest.fixture(scope="module")
def rows(spark):
    names = list(CASES)
    resumes = spark.createDataFrame(
        [(f"b{i}", i, i, CASES[n][0], CASES[n][1]) for i, n in enumerate(names)],
        "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    jobs = spark.createDataFrame(
        [(f"b{i}", CASES[n][2]) for i, n in enumerate(names)], "batch_id string, job_description string")
    out = compared(resumes, jobs, SETTINGS).collect()
    return {names[r["resume_id"]]: r for r in out}


@pytest.fixture(scope="module")
def texts(spark):
    names = list(CASES)
    df = spark.createDataFrame([(n, CASES[n][1]) for n in names], "name string, raw_text string")
    parts = section_texts(with_segments(df), ["work", "education", "projects", "skills", "certificates", "other"])
    return {r["name"]: r for r in parts.collect()}


def test_golden_resume(rows, texts):
    r = rows["golden"]
    assert r["name"] == "James Smith"
    assert texts["golden"]["sections_found"] and texts["golden"]["work_text"] == ""
    assert r["experience_years"] == YEAR - 2018
    assert (r["has_experience"], r["has_contact"], r["degree_score"]) == (1, 0, 0.6)
    assert r["matched_skills"] == ["python", "sql"]


def test_skill_boundaries(rows):
    assert rows["symbols"]["matched_skills"] == ["java"]
    assert rows["symbols"]["job_skills"] == ["c++"]
    assert rows["symbols_word"]["matched_skills"] == ["java", "c++"]
    assert rows["split_term"]["matched_skills"] == []
    assert rows["inside"]["matched_skills"] == ["javascript"]


def test_role_phrases_may_name_unmatchable_skills(rows):
    r = rows["role"]
    assert r["job_skills"] == ["react", "javascript", "typescript", "flutter", "swift"]
    assert r["jd_matched_skills"] == ["javascript", "react", "typescript"]
    assert r["jd_overlap"] == 3 / 5


def test_contact(rows):
    assert rows["phone_spaced"]["has_contact"] == 1
    assert rows["phone_tight"]["has_contact"] == 0


@pytest.mark.parametrize("name, years, flag", [
    ("years_without_work", 2, 0),
    ("reversed_range", 2, 0),
    ("open_range", YEAR - 2020, 0),
    ("sheet_style", 0, 0),
    ("stated", 7, 1),
    ("stated_long", 25, 1),
    ("warranty", 3, 1),
    ("work_dates", 4, 1),
    ("work_cap", 25, 1),
    ("work_across_lines", 3, 1),
    ("no_work_text", 0, 0),
    ("empty", 0, 0),
])
def test_experience(rows, name, years, flag):
    assert (rows[name]["experience_years"], rows[name]["has_experience"]) == (years, flag)


def test_sections(texts):
    assert texts["windows_lines"]["skills_text"] == "python\r"
    assert texts["windows_lines"]["education_text"] == "MBA\r\n"
    assert texts["nbsp_heading"]["skills_text"] == "python"
    assert texts["inline"]["skills_text"] == "python: sql\nmore"
    assert texts["inline"]["certificates_text"] == "PMP Expert"
    assert texts["bare_colon"]["skills_text"] == "python"
    assert not texts["not_heading"]["sections_found"]
    assert texts["not_heading"]["other_text"] == CASES["not_heading"][1]
    assert texts["empty"]["other_text"] == ""


def test_projects(rows):
    assert rows["inline_projects"]["projects"] == ["Web shop with django\nProject Title: Parser\nuses python"]
    assert rows["blocks"]["projects"] == ["Project Title: Parser\nuses python\n", "Project - App\nin sql"]
    assert rows["bullets"]["projects"] == ["- Web shop with react\n  continued here", "2) Numbered project here"]
    assert rows["titles"]["projects"] == ["E-commerce Website\nbuilt with django", "chat bot system\nThe Big Rewrite",
                                          "The Art of Data\nline of text"]
    assert rows["chunks"]["projects"] == ["a" * 200 + "\n" + "b" * 150, "c" * 100]
    assert rows["whole"]["projects"] == ["- tiny one\n- small two"]
    assert rows["empty"]["projects"] == []


def test_certificates(rows):
    assert rows["mentions"]["certificates"] == [
        "aws certified developer", "certified scrum master", "licensed", "certified"]
    assert rows["certificate_lines"]["certificates"] == [
        "certified python expert", "certifications", "certified python expert", "sql diploma"]


@pytest.mark.parametrize("name, degree, quality", [
    ("degree_max", 0.8, 0.8),
    ("degree_text", 1.0, 1.0),
    ("degree_none", 0.0, 0.0),
    ("bonus_two", 0.6, 0.8),
    ("bonus_one", 0.6, 0.7),
    ("bonus_stop", 0.6, 0.6),
    ("bonus_text", 0.0, 0.2),
    ("bonus_cap", 1.0, 1.0),
])
def test_education(rows, name, degree, quality):
    assert rows[name]["degree_score"] == degree
    assert rows[name]["education_quality"] == pytest.approx(quality)


@pytest.mark.parametrize("name, expected", [
    ("name_apostrophe", "Shaun O'Neil"), ("name_inside", "Etkov"), ("name_empty", "resume_12.pdf"),
    ("name_dots", "John.Smith"),
])
def test_names(rows, name, expected):
    assert rows[name]["name"] == expected


def test_repeated_terms_count_twice(spark):
    settings = config.scoring(YEAR, vocabulary=("onboarding", "logistics", "sales", "onboarding"))
    df = spark.createDataFrame([("b", 1, 1, "a.docx", "Onboarding and sales")],
                               "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    jobs = spark.createDataFrame([("b", "onboarding, logistics")], "batch_id string, job_description string")
    r = scoring.with_overlap(scoring.with_job(features(df, settings), jobs, settings)).head()
    assert r["matched_skills"] == ["onboarding", "sales", "onboarding"]
    assert r["skills_count"] == 3
    assert r["jd_overlap"] == 0.5


def test_similarity_of_identical_texts(spark):
    df = spark.createDataFrame([("b", 1, 1, "a.docx", "python sql developer")],
                               "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    jobs = spark.createDataFrame([("b", "Developer; SQL python")], "batch_id string, job_description string")
    r = compared(df, jobs, SETTINGS).head()
    assert r["skills_match_score"] == 1.0
    missing = compared(df, jobs.filter("batch_id = 'other'"), SETTINGS).head()
    assert missing["jd_overlap"] == 0.0 and missing["skills_match_score"] > 0  # the default job names a developer


def test_default_vocabulary_is_whole(spark):
    terms = SETTINGS.vocabulary
    assert len(terms) == 302 and len(set(terms)) == 300
    assert [t for t in dict.fromkeys(terms) if terms.count(t) == 2] == ["onboarding", "logistics"]
    assert (terms[0], terms[51], terms[52], terms[301]) == ("python", "jira", "seo", "fleet management")
    df = spark.createDataFrame([("pay", 1, 1, "a.docx", "Payroll, Excel and GAAP; logistics"), ("any", 2, 1, "b.docx", "Excel")],
                               "batch_id string, resume_id bigint, ordinal bigint, filename string, raw_text string")
    jobs = spark.createDataFrame([("pay", "Payroll accountant, excel, gaap"), ("any", "Pastry chef")],
                                 "batch_id string, job_description string")
    pay, other = keyword_scores(df, jobs, SETTINGS).orderBy("resume_id").select("matched_skills", "score").collect()
    assert pay["matched_skills"] == ["excel", "payroll", "gaap", "logistics", "logistics"] and pay["score"] == 100.0
    assert other["score"] == 0.3  # 1 of 302
