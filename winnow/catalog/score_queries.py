"""Queries over skills, similarity, scores, ranks, flags and the dashboard."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed
from winnow.catalog import parts as P
from winnow.catalog.fixture import AS_OF_YEAR, jobs, resumes, table
from winnow.catalog.registry import query, sql_text
from winnow.catalog.text_queries import KEY, SETTINGS, big, documents, joined, r6
from winnow.config import scoring
from winnow.functions.common import let
from winnow.functions import extract, scores, skills, vectors
from winnow.operators import dashboard, embedded, scoring as score_ops, search_index
from winnow.operators.corpus import hashed_corpus, tfidf_cosine, term_rows, weighted_rows
from winnow.operators.features import features, with_skills
from winnow.operators.slices import materialize, scratch_folder
from winnow.operators.terms import match_terms
from winnow.plans import screen as plans

TERMS = SETTINGS.vocabulary


def ranked_rows(spark, folder: str) -> DataFrame:
    """The keyword screening of all batches."""
    return plans.screen(resumes(spark, folder), jobs(spark, folder), SETTINGS, keywords_only=True)


def compared(spark, folder: str) -> DataFrame:
    return plans.compared(resumes(spark, folder), jobs(spark, folder), SETTINGS)


def with_overlap(spark, folder: str) -> DataFrame:
    rows = features(resumes(spark, folder), SETTINGS)
    return score_ops.with_overlap(score_ops.with_job(rows, jobs(spark, folder), SETTINGS))


# --- skills -----------------------------------------------------------------------------------------------------------

@query("skl1_match", "SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY ord) - 1 AS BIGINT) "
       "AS pos, skill FROM matched")
def skl1(spark, folder):
    rows = with_skills(resumes(spark, folder), SETTINGS).select(KEY, F.posexplode("matched_skills"))
    return rows.select(KEY, big("pos").alias("pos"), F.col("col").alias("skill"))


# A vocabulary with terms inside and before each other, and one term listed twice.
NESTED_TERMS = ("sql", "sql jobs", "jobs", "data", "data pipelines", "git", "java", "javascript", "c++", "data")


@query("skl1_match_nested", """
SELECT resume_id, coalesce(string_agg(skill, '|' ORDER BY ord), '') AS matched, count(*) AS n FROM (
  SELECT r.resume_id, v.ord, v.skill FROM resumes r JOIN (VALUES """ + ", ".join(
    f"({i}, {sql_text(t)})" for i, t in enumerate(NESTED_TERMS)) + r""") AS v(ord, skill)
  ON regexp_matches(lower(r.raw_text), '\b' || regexp_escape(v.skill) || '\b'))
GROUP BY resume_id""")
def skl1_nested(spark, folder):
    rows = with_skills(resumes(spark, folder), scoring(AS_OF_YEAR, vocabulary=NESTED_TERMS))
    rows = rows.select(KEY, joined("matched_skills").alias("matched"), big("skills_count").alias("n"))
    return rows.filter(F.col("n") > 0)


# Runs of word characters and runs of others, as lists; a term is a row of whole runs between word boundaries.
RUNS_SQL = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')"


@query("skl1_table", f"""
WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
listed AS (SELECT skill, min(item_id) AS ord FROM (
    SELECT item_id, w[i] || ' ' || w[i + 1] AS skill
    FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM item)) GROUP BY skill),
text_runs AS (SELECT doc_id, {RUNS_SQL.format('lower(text)')} AS r FROM documents),
spans AS (SELECT DISTINCT doc_id, r[i] || r[i + 1] || r[i + 2] AS skill
    FROM (SELECT doc_id, r, unnest(range(1, len(r) - 1)) AS i FROM text_runs))
SELECT d.doc_id, count(l.skill) AS n, coalesce(string_agg(l.skill, '|' ORDER BY l.ord, l.skill), '') AS matched
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN listed l ON l.skill = s.skill GROUP BY d.doc_id""")
def skl1_table(spark, folder):
    """A vocabulary that is a table: all pairs of neighbouring words of the benchmark items."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = let(words, lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda word, at: F.concat(word, F.lit(" "), F.get(w, at + 1))))
    listed = table(spark, folder, "benchmark").select("item_id", F.explode(pairs).alias("skill")).groupBy("skill").agg(
        F.min("item_id").alias("ord"))
    found = match_terms(table(spark, folder, "documents"), listed, SETTINGS, ["doc_id"], "text")
    return found.select("doc_id", big("skills_count").alias("n"), joined("matched_skills").alias("matched"))


@query("skl2_count", "SELECT resume_id, skills_count FROM skill_stats")
def skl2(spark, folder):
    return with_skills(resumes(spark, folder), SETTINGS).select(KEY, big("skills_count").alias("skills_count"))


@query("skl3_job_skills", "SELECT j.batch_id, coalesce(string_agg(s.skill, '|' ORDER BY s.ord), '') AS job_skills "
       "FROM jobs j LEFT JOIN job_skill_rows s USING (batch_id) GROUP BY j.batch_id")
def skl3(spark, folder):
    found = skills.job_skills(F.col("job_description"), TERMS, SETTINGS.role_skills)
    return jobs(spark, folder).select("batch_id", joined(found).alias("job_skills"))


@query("skl4_overlap", "SELECT resume_id, round(jd_overlap, 6) AS jd_overlap FROM skill_stats")
def skl4(spark, folder):
    return with_overlap(spark, folder).select(KEY, r6("jd_overlap").alias("jd_overlap"))


@query("skl5_matched_for_job", "SELECT resume_id, jd_matched_skills FROM skill_stats")
def skl5(spark, folder):
    return with_overlap(spark, folder).select(KEY, joined("jd_matched_skills").alias("jd_matched_skills"))


@query("skl6_job_first", """
SELECT m.resume_id, string_agg(m.skill, '|' ORDER BY (CASE WHEN s.skill IS NULL THEN 1 ELSE 0 END), m.ord) AS skills
FROM matched m LEFT JOIN (SELECT DISTINCT batch_id, skill FROM job_skill_rows) s ON s.batch_id = m.batch_id AND s.skill = m.skill GROUP BY m.resume_id""")
def skl6(spark, folder):
    rows = with_overlap(spark, folder).filter(F.size("matched_skills") > 0)
    ordered = skills.job_first(F.col("matched_skills"), F.col("jd_matched_skills"))
    return rows.select(KEY, joined(ordered).alias("skills"))


# --- similarity ---------------------------------------------------------------------------------------------------------

@query("sim1_term_vectors", """
SELECT resume_id, term, CAST(count(*) AS DOUBLE) AS tf
FROM (SELECT resume_id, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM docs)
GROUP BY resume_id, term""")
def sim1(spark, folder):
    vector = vectors.term_vector(F.col("raw_text"))
    return documents(spark, folder).select(KEY, F.explode(vector).alias("term", "tf"))


TFIDF = """
WITH tf AS (
  SELECT resume_id, term, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT resume_id, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM {table})
  GROUP BY resume_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
total AS (SELECT count(*) AS n FROM {table}),
w AS (SELECT resume_id, term, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS weight
      FROM tf JOIN df USING (term) CROSS JOIN total)
"""


@query("sim1_tfidf", TFIDF.format(table="(SELECT doc_id AS resume_id, text AS raw_text FROM documents)")
       + "SELECT resume_id, term, round(weight, 6) AS weight FROM w")
def sim1_tfidf(spark, folder):
    docs = documents(spark, folder)
    rows = weighted_rows(materialize(term_rows(docs, "raw_text")), docs.count())
    return rows.select(F.col("id").alias("resume_id"), "term", r6("weight").alias("weight"))


CENTRE = "(SELECT embedding AS centre FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _embeddings(spark, folder) -> DataFrame:
    """Vectors with their cosine to the first one, which plays the job."""
    rows = table(spark, folder, "embeddings")
    centre = rows.agg(F.min_by("embedding", "vec_id")).head()[0]  # a single vector
    cosine = vectors.dense_cosine(F.col("embedding"), F.array(*[F.lit(v) for v in centre]))
    return rows.select("vec_id", "label", cosine.alias("cosine"))


@query("sim2_dense", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), "
       f"CAST(centre AS DOUBLE[])), 6) AS cosine FROM embeddings, {CENTRE}")
def sim2_dense(spark, folder):
    return _embeddings(spark, folder).select("vec_id", r6("cosine").alias("cosine"))


@query("sim2_terms", "SELECT resume_id, round(cosine, 6) AS cosine FROM resume_cosines")
def sim2_terms(spark, folder):
    rows = score_ops.with_job(features(resumes(spark, folder), SETTINGS), jobs(spark, folder), SETTINGS)
    cos = vectors.cosine(F.col("term_vector"), F.col("job_vector"), F.col("job_norm"))
    return rows.select(KEY, r6(cos).alias("cosine"))


_tfidf_jobs = """
, jt AS (SELECT batch_id, term, tf * (ln(((SELECT n FROM total) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS weight
         FROM job_terms LEFT JOIN df USING (term)),
jn AS (SELECT batch_id, sqrt(sum(weight * weight)) AS norm FROM jt GROUP BY batch_id),
rn AS (SELECT resume_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY resume_id),
dots AS (SELECT w.resume_id, sum(w.weight * jt.weight) AS dot FROM w JOIN resumes r USING (resume_id)
         JOIN jt ON jt.batch_id = r.batch_id AND jt.term = w.term GROUP BY w.resume_id)
SELECT r.resume_id, round(coalesce(dot / (rn.norm * jn.norm), 0), 6) AS cosine
FROM resumes r LEFT JOIN dots USING (resume_id) LEFT JOIN rn USING (resume_id) LEFT JOIN jn USING (batch_id)"""


@query("sim2_tfidf", TFIDF.format(table="resumes") + _tfidf_jobs)
def sim2_tfidf(spark, folder):
    rows = tfidf_cosine(resumes(spark, folder), jobs(spark, folder), SETTINGS)
    return rows.select("resume_id", r6("cosine").alias("cosine"))


@query("sim3_skills_match", f"""
SELECT vec_id, round({P.match_score('cosine')}, 6) AS skills_match_score FROM (
  SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centre AS DOUBLE[])) AS cosine
  FROM embeddings, {CENTRE})""")
def sim3(spark, folder):
    match = vectors.skills_match(F.col("cosine"))
    return _embeddings(spark, folder).select("vec_id", r6(match).alias("skills_match_score"))


@query("sim4_certificates", "SELECT resume_id, round(coalesce(certificate_relevance, 0), 6) AS certificate_relevance "
       "FROM resumes LEFT JOIN certificate_scores USING (resume_id)")
def sim4(spark, folder):
    return compared(spark, folder).select(KEY, r6("certificate_relevance").alias("certificate_relevance"))


@query("sim5_projects", "SELECT resume_id, round(coalesce(project_relevance, 0), 6) AS project_relevance, "
       "coalesce(relevant_projects_count, 0) AS relevant_projects_count "
       "FROM resumes LEFT JOIN project_scores USING (resume_id)")
def sim5(spark, folder):
    return compared(spark, folder).select(
        KEY, r6("project_relevance").alias("project_relevance"),
        big("relevant_projects_count").alias("relevant_projects_count"))


@query("sim5_embeddings", f"""
SELECT label, round({P.project_score('cosine')}, 6) AS project_relevance,
       count(*) FILTER (cosine > 0.3) AS relevant
FROM (SELECT CAST(label AS BIGINT) AS label,
             list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(centre AS DOUBLE[])) AS cosine
      FROM embeddings, {CENTRE}) GROUP BY label""")
def sim5_embeddings(spark, folder):
    """Vectors of a label as the projects of one resume, aggregated as rows."""
    scored = score_ops.project_scores(_embeddings(spark, folder), "label")
    return scored.select(big("label").alias("label"), r6("project_relevance").alias("project_relevance"),
                         F.col("relevant_projects_count").alias("relevant"))


@query("sim6_job_default", f"""
SELECT batch_id, (CASE WHEN {P.blank('job_description')} THEN '{fixed.DEFAULT_JOB}' ELSE job_description END) AS job
FROM jobs""")
def sim6(spark, folder):
    job = vectors.similarity_job(F.col("job_description"), fixed.DEFAULT_JOB)
    return jobs(spark, folder).select("batch_id", job.alias("job"))


# --- supplied vectors and corpus weights in the plan -------------------------------------------------------------------------

# Which vector of ``embeddings`` plays the embedding of a text: by kind, number and key.
_COUNT = "(SELECT count(*) FROM embeddings)"
TEXT_VECTOR, CERTIFICATE_VECTOR, PROJECT_VECTOR, JOB_VECTOR = "k % c", "(k * 5 + j) % c", "(k * 3 + j * 7) % c", "b * 7 % c"


def embedded_texts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Resumes and jobs with vectors bound to their texts, in place of an embedding model's."""
    vectors_of = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    c = F.lit(vectors_of.count())
    k, j, b = F.col("resume_id"), F.col("n"), F.col("batch_no")
    people, batches = resumes(spark, folder), jobs(spark, folder)
    which = F.when(F.col("kind") == embedded.TEXT, k % c).when(
        F.col("kind") == embedded.CERTIFICATE, (k * 5 + j) % c).otherwise((k * 3 + j * 7) % c)
    texts = embedded.texts_to_embed(people, SETTINGS).withColumn("vec_id", which).join(vectors_of, "vec_id")
    described = embedded.job_texts_to_embed(batches, SETTINGS).join(batches.select("batch_id", "batch_no"), "batch_id")
    wanted = described.withColumn("vec_id", b * 7 % c).join(vectors_of, "vec_id")
    return embedded.bind_vectors(people, texts), embedded.bind_job_vectors(batches, wanted)


def _given(kind: str, rows: str, vec: str) -> str:
    """Cosines of the vectors that stand for the texts of ``rows`` (``resume_id, n``) with the batch's."""
    return f"""
SELECT resume_id, n, coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 0) AS cosine
FROM (SELECT resume_id, n, {vec.replace('k', 'resume_id')} AS vec_id FROM (
        SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY n) - 1 AS j, {_COUNT} AS c FROM ({rows}))) x
JOIN embeddings e USING (vec_id) JOIN resumes r USING (resume_id) JOIN given_jobs w USING (batch_id)"""


GIVEN = {
    "given_jobs": f"SELECT batch_id, embedding FROM (SELECT batch_id, {JOB_VECTOR.replace('b', 'batch_no', 1)} AS vec_id "
                  f"FROM (SELECT *, {_COUNT} AS c FROM jobs)) JOIN embeddings USING (vec_id)",
    "resume_cosines": _given("text", "SELECT resume_id, 0 AS n FROM resumes", TEXT_VECTOR),
    "certificate_cosines": _given("certificate", "SELECT resume_id, n FROM certificate_rows", CERTIFICATE_VECTOR),
    "project_cosines": _given("project", "SELECT resume_id, n FROM project_rows", PROJECT_VECTOR),
}
_RELEVANCE = ("SELECT resume_id, round(skills_match_score, 6) AS skills_match_score, round(certificate_relevance, 6) AS "
              "certificate_relevance, round(project_relevance, 6) AS project_relevance, relevant_projects_count FROM feature_rows")


def relevance(rows: DataFrame) -> DataFrame:
    return rows.select(KEY, r6("skills_match_score").alias("skills_match_score"),
                       r6("certificate_relevance").alias("certificate_relevance"),
                       r6("project_relevance").alias("project_relevance"),
                       big("relevant_projects_count").alias("relevant_projects_count"))


@query("sim2_supplied", _RELEVANCE, GIVEN)
def sim2_supplied(spark, folder):
    people, batches = embedded_texts(spark, folder)
    return relevance(plans.compared(people, batches, SETTINGS, embedded.TextVectors()))


@query("sco4_supplied", "SELECT batch_id, resume_id, score, rank FROM blended_ranked", GIVEN)
def sco4_supplied(spark, folder):
    """The whole screening from supplied vectors."""
    people, batches = embedded_texts(spark, folder)
    rows = plans.screen(people, batches, SETTINGS, vectors=embedded.TextVectors())
    return rows.select("batch_id", KEY, "score", "rank")


def _cells(rows: str) -> str:
    """``resume_id, n, cell, tf`` of the texts of ``rows`` (``resume_id, n, txt``)."""
    return (f"SELECT resume_id, n, CAST('0x' || substr(md5(term), 1, 5) AS INTEGER) >> 2 AS cell, CAST(count(*) AS DOUBLE) AS tf "
            f"FROM (SELECT resume_id, n, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS term FROM ({rows})) GROUP BY ALL")


def _hashed(rows: str) -> str:
    return f"""
SELECT t.resume_id, t.n, coalesce(dot / (norm * job_norm), 0) AS cosine FROM ({rows}) t LEFT JOIN (
  SELECT x.resume_id, x.n, sqrt(sum(x.w * x.w)) AS norm, sum(x.w * j.w) AS dot, any_value(g.norm) AS job_norm
  FROM (SELECT resume_id, n, cell, tf * coalesce(idf, (SELECT idf FROM no_cell)) AS w FROM ({_cells(rows)}) LEFT JOIN cell_idf USING (cell)) x
  JOIN resumes r USING (resume_id) JOIN hashed_norms g USING (batch_id)
  LEFT JOIN hashed_jobs j ON j.batch_id = r.batch_id AND j.cell = x.cell GROUP BY x.resume_id, x.n) s USING (resume_id, n)"""


HASHED = {
    "no_cell": "SELECT ln(count(*) + 1.0) + 1.0 AS idf FROM resumes",
    "cell_idf": "SELECT cell, ln(((SELECT count(*) FROM resumes) + 1.0) / (count(DISTINCT resume_id) + 1.0)) + 1.0 AS idf FROM ("
                + _cells("SELECT resume_id, 0 AS n, raw_text AS txt FROM resumes") + ") GROUP BY cell",
    "hashed_jobs": "SELECT batch_id, cell, tf * coalesce(idf, (SELECT idf FROM no_cell)) AS w FROM ("
                   "SELECT batch_id, CAST('0x' || substr(md5(term), 1, 5) AS INTEGER) >> 2 AS cell, sum(tf) AS tf "
                   "FROM job_terms GROUP BY ALL) LEFT JOIN cell_idf USING (cell)",
    "hashed_norms": "SELECT batch_id, sqrt(sum(w * w)) AS norm FROM hashed_jobs GROUP BY batch_id",
    "resume_cosines": _hashed("SELECT resume_id, 0 AS n, raw_text AS txt FROM resumes"),
    "certificate_cosines": _hashed("SELECT resume_id, n, mention AS txt FROM certificate_rows"),
    "project_cosines": _hashed("SELECT resume_id, n, project AS txt FROM project_rows"),
}


@query("sim1_hashed", "SELECT CAST(cell AS BIGINT) AS cell, round(idf, 6) AS idf FROM cell_idf", HASHED)
def sim1_hashed(spark, folder):
    """The corpus's weights as rows; cells that no text has are left out."""
    people = resumes(spark, folder)
    corpus = hashed_corpus(people)
    rows = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(corpus.idf)), "idf": corpus.idf.round(6)}))
    return rows.filter(F.col("idf") < float((np.log(people.count() + 1.0) + 1.0).round(6)))


@query("sim2_hashed", _RELEVANCE, HASHED)
def sim2_hashed(spark, folder):
    people = resumes(spark, folder)
    return relevance(plans.compared(people, jobs(spark, folder), SETTINGS, corpus=hashed_corpus(people)))


# --- scores ----------------------------------------------------------------------------------------------------------------

@query("sco1_experience_norm", "SELECT resume_id, round(exp_norm, 6) AS exp_norm FROM quality_rows")
def sco1(spark, folder):
    norm = scores.experience_norm(F.col("experience_years"), F.col("skills_count"), F.col("project_relevance"),
                                  SETTINGS.experience_floor)
    return compared(spark, folder).select(KEY, r6(norm).alias("exp_norm"))


@query("sco2_quality", "SELECT resume_id, round(quality_score, 6) AS quality_score FROM quality_rows")
def sco2(spark, folder):
    rows = score_ops.with_quality(compared(spark, folder), SETTINGS)
    return rows.select(KEY, r6("quality_score").alias("quality_score"))


@query("sco3_blend", "SELECT resume_id, score FROM blended")
def sco3(spark, folder):
    rows = plans.blended_scores(resumes(spark, folder), jobs(spark, folder), SETTINGS)
    return rows.select(KEY, "score")


@query("sco4_keyword_score", "SELECT resume_id, score FROM keyword_rows")
def sco4(spark, folder):
    rows = plans.keyword_scores(resumes(spark, folder), jobs(spark, folder), SETTINGS)
    return rows.select(KEY, "score")


@query("sco4_screen", "SELECT batch_id, resume_id, rank, name, score, matched_skills, jd_matched_skills, "
       "experience_years, filename, is_anomaly FROM ranked")
def sco4_screen(spark, folder):
    """The flagship: score by vocabulary overlap, rank and flag every batch."""
    return ranked_rows(spark, folder).select(
        "batch_id", KEY, "rank", "name", "score", joined("matched_skills").alias("matched_skills"),
        joined("jd_matched_skills").alias("jd_matched_skills"), big("experience_years").alias("experience_years"),
        "filename", "is_anomaly")


@query("sco5_projection", f"""
SELECT resume_id, name, score, matched_skills, jd_matched_skills, experience_years,
       certificate_relevance > 0 AS has_relevant_cert,
       {P.python_round('project_relevance', 3)} AS project_relevance_score, relevant_projects_count,
       {P.python_round('education_quality', 2)} AS education_quality, filename FROM blended""")
def sco5(spark, folder):
    rows = plans.blended_scores(resumes(spark, folder), jobs(spark, folder), SETTINGS)
    return rows.select(
        KEY, "name", "score", joined("matched_skills").alias("matched_skills"),
        joined("jd_matched_skills").alias("jd_matched_skills"), big("experience_years").alias("experience_years"),
        "has_relevant_cert", "project_relevance_score",
        big("relevant_projects_count").alias("relevant_projects_count"), "education_quality", "filename")


# --- ranks and flags -------------------------------------------------------------------------------------------------------

@query("rnk1_rank", "SELECT batch_id, resume_id, score, rank FROM blended_ranked")
def rnk1(spark, folder):
    scored = materialize(plans.blended_scores(resumes(spark, folder), jobs(spark, folder), SETTINGS).select(
        "batch_id", KEY, "ordinal", "score"))
    return score_ops.rank(scored, SETTINGS).select("batch_id", KEY, "score", "rank")


_REASON = f"(CASE WHEN is_anomaly THEN {sql_text(fixed.ANOMALY_REASON)} ELSE '' END) AS anomaly_reason"


@query("ano1_documents", f"""
WITH d AS (SELECT source AS batch_id, doc_id AS resume_id, length(text) AS text_length FROM documents)
SELECT batch_id, resume_id, text_length, is_anomaly, {_REASON} FROM ({P.outliers('d')})""")
def ano1(spark, folder):
    rows = documents(spark, folder).select(
        "batch_id", KEY, "ordinal", extract.text_length(F.col("raw_text")).alias("text_length"))
    flagged = score_ops.flag_outliers(rows, SETTINGS)
    return flagged.select("batch_id", KEY, big("text_length").alias("text_length"), "is_anomaly", "anomaly_reason")


@query("ano1_limits", """
SELECT batch_id, n, round(s1 / CAST(n AS DOUBLE), 6) AS mean_length,
       round(sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)), 6) AS length_deviation
FROM (SELECT source AS batch_id, count(*) AS n, sum(CAST(length(text) AS HUGEINT)) AS s1,
             sum(CAST(length(text) AS HUGEINT) * length(text)) AS s2 FROM documents GROUP BY source)""")
def ano1_limits(spark, folder):
    rows = documents(spark, folder).withColumn("text_length", F.length("raw_text"))
    return score_ops.length_limits(rows).select(
        "batch_id", "n", r6("mean_length").alias("mean_length"), r6("length_deviation").alias("length_deviation"))


# --- dashboard ----------------------------------------------------------------------------------------------------------------

@query("dsh1_search", "SELECT batch_id, resume_id, rank, name FROM ranked WHERE contains(lower(name), 'smith') "
       "OR len(list_filter(string_split(matched_skills, '|'), lambda s: contains(s, 'smith'))) > 0")
def dsh1(spark, folder):
    return dashboard.search(ranked_rows(spark, folder), "Smith").select("batch_id", KEY, "rank", "name")


@query("dsh1_search_skill", "SELECT batch_id, resume_id, rank, name FROM ranked WHERE contains(lower(name), 'script') "
       "OR len(list_filter(string_split(matched_skills, '|'), lambda s: contains(s, 'script'))) > 0")
def dsh1_skill(spark, folder):
    return dashboard.search(ranked_rows(spark, folder), "SCRIPT").select("batch_id", KEY, "rank", "name")


# A skill's part, two names' parts, one across a blank, one below three letters, one that nobody has.
SEARCHED = ("SCRIPT", "smith", "date 1", "e c", "py", "qqq")


@query("dsh1_indexed", """
SELECT w.wanted, r.batch_id, r.resume_id, r.rank, r.name FROM ranked r, (VALUES """ + ", ".join(
    f"({sql_text(t)})" for t in SEARCHED) + """) AS w(wanted)
WHERE contains(lower(r.name), lower(w.wanted))
   OR len(list_filter(string_split(r.matched_skills, '|'), lambda s: contains(s, lower(w.wanted)))) > 0""")
def dsh1_indexed(spark, folder):
    """Several searches through one index."""
    rows, path = materialize(ranked_rows(spark, folder)), f"{scratch_folder(spark)}/winnow-{uuid.uuid4().hex}"
    search_index.write(rows, path)
    found = [search_index.search(rows, path, text).withColumn("wanted", F.lit(text)) for text in SEARCHED]
    return reduce(DataFrame.unionByName, found).select("wanted", "batch_id", KEY, "rank", "name")


@query("dsh2_flagged", "SELECT batch_id, resume_id, rank FROM ranked WHERE is_anomaly")
def dsh2(spark, folder):
    return dashboard.flagged(ranked_rows(spark, folder)).select("batch_id", KEY, "rank")


@query("dsh3_top", "SELECT batch_id, resume_id, rank, name, score FROM ranked "
       "WHERE len(list_filter(string_split(matched_skills, '|'), lambda s: contains(s, 'python'))) > 0 "
       "QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY rank) <= 20")
def dsh3(spark, folder):
    """Search, then the top 20 of every batch."""
    found = dashboard.search(ranked_rows(spark, folder), "python")
    return dashboard.top_per_batch(found, 20, SETTINGS).select("batch_id", KEY, "rank", "name", "score")


@query("dsh4_summary", """
SELECT batch_id, count(*) AS total, round(avg(score), 1) AS avg_score, min_by(name, rank) AS top_candidate,
       count(*) FILTER (is_anomaly) AS anomalies FROM ranked GROUP BY batch_id""")
def dsh4(spark, folder):
    return dashboard.summary(ranked_rows(spark, folder), "batch_id")


@query("dsh5_bands", f"""
SELECT (CASE WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium'
        ELSE 'low' END) AS band, count(*) AS n FROM blended GROUP BY 1""")
def dsh5(spark, folder):
    return dashboard.score_bands(plans.blended_scores(resumes(spark, folder), jobs(spark, folder), SETTINGS))


@query("dsh6_chart", "SELECT batch_id, rank, split_part(name, ' ', 1) AS name, score FROM ranked WHERE rank <= 10")
def dsh6(spark, folder):
    """The chart of every batch: unfiltered ranks have no gaps, so the first ten are those up to rank 10."""
    first = ranked_rows(spark, folder).filter(F.col("rank") <= 10)
    return dashboard.chart_bars(first).select("batch_id", "rank", "name", "score")


@query("dsh7_first_uploads", """
SELECT batch_id, resume_id, filename FROM resumes
QUALIFY row_number() OVER (PARTITION BY batch_id, filename ORDER BY ordinal) = 1""")
def dsh7(spark, folder):
    files = resumes(spark, folder).select("batch_id", KEY, "ordinal", "filename")
    return dashboard.first_uploads(files, ["batch_id", "filename"], ["ordinal"]).select("batch_id", KEY, "filename")
