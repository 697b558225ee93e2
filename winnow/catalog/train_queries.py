"""Queries over the training frame, labels, splits and the forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed
from winnow.catalog import files_fixture as ff
from winnow.catalog import parts as P
from winnow.catalog.fixture import AS_OF_YEAR, table
from winnow.catalog.registry import PARTS, part, query, sql_list
from winnow.catalog.store_queries import batches, new_folder
from winnow.catalog.text_queries import big, r6
from winnow.config import training as training_settings
from winnow.operators import training as t
from winnow.operators.slices import materialize
from winnow.plans import train as plans
from winnow.sources import store

SETTINGS = training_settings(AS_OF_YEAR)
part("stored_rows", ff.STORED_SQL)


# --- the twin of the training features: every row is a resume with a job of its own ---------------------------------------

_rows = """
SELECT row_id, raw_text, job_description, Skills, Experience_Years, TRUE AS from_sheet FROM synthesized
UNION ALL
SELECT row_id, raw_text, job_description, NULL, NULL, FALSE FROM stored_rows"""
part("training_rows", _rows)
_OWN = {
    "resumes": "SELECT CAST(row_id AS VARCHAR) AS batch_id, row_id AS resume_id, row_id AS ordinal, "
               "'x' AS filename, raw_text FROM training_rows",
    "jobs": "SELECT CAST(row_id AS VARCHAR) AS batch_id, job_description FROM training_rows",
    "job_terms": PARTS["job_terms"].replace(f"'{fixed.DEFAULT_JOB}'", f"'{fixed.DEFAULT_TRAINING_JOB}'"),
    "certificate_scores": PARTS["certificate_scores"].replace(
        f"> 0.1", f"> 0.3"),
}


_FEATURES = r"""
WITH own AS (
  SELECT w.row_id, w.from_sheet,
         (CASE WHEN w.from_sheet AND w.Skills IS NOT NULL THEN (SELECT count(*) FROM vocab v
               WHERE regexp_matches(lower(w.Skills), '\b' || regexp_escape(v.skill) || '\b'))
          ELSE s.skills_count END) AS skills_count,
         (CASE WHEN w.from_sheet AND TRY_CAST(w.Experience_Years AS DOUBLE) IS NOT NULL
               THEN least(CAST(trunc(TRY_CAST(w.Experience_Years AS DOUBLE)) AS BIGINT), 25)
          ELSE y.experience_years END) AS experience_years
  FROM training_rows w JOIN skill_stats s ON s.resume_id = w.row_id JOIN years y ON y.resume_id = w.row_id),
""" + f"""
f AS (SELECT o.row_id, r.skills_match_score, o.skills_count, r.has_experience, r.certificate_relevance, r.has_contact,
             o.experience_years, r.project_relevance, r.education_quality
      FROM feature_rows r JOIN own o ON o.row_id = r.resume_id),
q AS (SELECT *, {P.weighted([
    ("skills_match", "skills_match_score"),
    ("experience", f"least(experience_years / CAST(15 AS DOUBLE), CAST(1 AS DOUBLE))"),
    ("certificates", "certificate_relevance"), ("contact_info", "has_contact"),
    ("skills_count", "least(skills_count / CAST(15 AS DOUBLE), CAST(1 AS DOUBLE))"),
    ("project_relevance", "project_relevance"), ("education_quality", "education_quality")])} AS quality_score FROM f)
"""


def frame(spark, folder: str) -> DataFrame:
    return plans.training_frame(ff.sheet(spark, folder), ff.stored(spark, folder, SETTINGS.vocabulary))


def model_rows(spark, folder: str) -> DataFrame:
    return plans.training_features(frame(spark, folder), SETTINGS)


def labelled(spark, folder: str) -> DataFrame:
    return t.pseudo_labels(materialize(model_rows(spark, folder)))


# --- rows ------------------------------------------------------------------------------------------------------------------

@query("trn2_plan", f"""
SELECT 2 * {ff.K} + 1 AS row_id FROM customer
QUALIFY row_number() OVER (PARTITION BY {ff.K} % 97 ORDER BY {ff.batch_sql()}, {ff.K}) = 1""")
def trn2_plan(spark, folder):
    """The training frame of a store into which files were uploaded again under names it has."""
    stored = ff.stored(spark, folder, SETTINGS.vocabulary).withColumn(
        "filename", F.concat(F.col("ordinal") % 97, F.lit(".docx")))
    return plans.training_frame(ff.sheet(spark, folder), stored).filter(~F.col("from_sheet")).select("row_id")


@query("trn1_store_rows", f"""
SELECT batch_id, rank, filename, coalesce(job_description, '{fixed.DEFAULT_TRAINING_JOB}') AS job_description
FROM convs WHERE NOT {P.blank('raw_text')}""")
def trn1(spark, folder):
    rows = t.store_rows(store.flatten(batches(spark, folder), fixed.DEFAULT_TRAINING_JOB))
    return rows.select("batch_id", "rank", "filename", "job_description")


@query("trn2_first_by_filename", """
SELECT filename, batch_id, rank FROM convs
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY uploaded_at, batch_id, rank) = 1""")
def trn2(spark, folder):
    rows = store.flatten(batches(spark, folder))
    return t.first_by_filename(rows, ["uploaded_at", "batch_id", "rank"]).select("filename", "batch_id", "rank")


@query("trn3_union", "SELECT row_id, from_sheet, job_description, coalesce(Skills, '(null)') AS sheet_skills, "
       "coalesce(Experience_Years, '(null)') AS sheet_years FROM training_rows")
def trn3(spark, folder):
    return frame(spark, folder).select(
        "row_id", "from_sheet", "job_description",
        *[F.coalesce(c, F.lit("(null)")).alias(c) for c in ("sheet_skills", "sheet_years")])


@query("trn4_skills_count", _FEATURES + "SELECT row_id, skills_count FROM own", _OWN)
def trn4(spark, folder):
    return model_rows(spark, folder).select("row_id", big("skills_count").alias("skills_count"))


@query("trn5_years", _FEATURES + "SELECT row_id, experience_years FROM own", _OWN)
def trn5(spark, folder):
    return model_rows(spark, folder).select("row_id", big("experience_years").alias("experience_years"))


@query("trn6_quality", _FEATURES + "SELECT row_id, round(quality_score, 6) AS quality_score FROM q", _OWN)
def trn6(spark, folder):
    return model_rows(spark, folder).select("row_id", r6("quality_score").alias("quality_score"))


@query("trn7_labels", _FEATURES + f"""
, c AS (SELECT count(*) FILTER (quality_score >= 0.5) AS strong, count(*) AS n FROM q),
th AS (SELECT (CASE WHEN least(strong, n - strong) >= 5 THEN CAST(0.5 AS DOUBLE)
               ELSE (SELECT quantile_cont(quality_score, 0.75) FROM q) END) AS threshold FROM c)
SELECT row_id, round(threshold, 6) AS threshold, CAST(quality_score >= threshold AS BIGINT) AS shortlisted
FROM q, th""", _OWN)
def trn7(spark, folder):
    return labelled(spark, folder).select("row_id", r6("threshold").alias("threshold"),
                                          big("shortlisted").alias("shortlisted"))


@query("trn7_quartile", "SELECT round(quantile_cont(c_acctbal, 0.75), 6) AS quartile, "
       "round(quantile_cont(c_acctbal, 0.5), 6) AS median FROM customer")
def trn7_quartile(spark, folder):
    rows = table(spark, folder, "customer").select("c_acctbal")
    values = (t.exact_quantile(rows, "c_acctbal", 0.75), t.exact_quantile(rows, "c_acctbal", 0.5))
    return rows.agg(F.count(F.lit(1))).select(*[F.round(F.lit(v), 6).alias(n)
                                                for v, n in zip(values, ("quartile", "median"))])


_SPREAD = ["skills_match_score", "certificate_relevance", "project_relevance", "education_quality"]
_SUMMARY = ", ".join(
    [f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in _SPREAD]
    + [f"round(avg({c}), 6) AS mean_{c}" for c in ("skills_count", "experience_years")]
    + [f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in ("has_experience", "has_contact")]
    + [f"round({f}(quality_score), 6) AS {n}_quality" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))])


@query("trn8_summary", _FEATURES + f"SELECT {_SUMMARY}, count(*) AS n FROM q", _OWN)
def trn8(spark, folder):
    summary = t.feature_summary(model_rows(spark, folder))
    return summary.select(*[r6(c).alias(c) if d == "double" else c for c, d in summary.dtypes])


# --- splits ----------------------------------------------------------------------------------------------------------------

def _labels(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic")


_PLACED = """(SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place,
              count(*) OVER (PARTITION BY quality) AS size FROM labels)"""


@query("trn9_split", f"SELECT doc_id, CAST(quality AS BIGINT) AS quality, place <= ceil(size * 0.2) AS is_test FROM {_PLACED}")
def trn9(spark, folder):
    rows = t.stratified_split(_labels(spark, folder), "quality", "doc_id")
    return rows.select("doc_id", big("quality").alias("quality"), "is_test")


@query("trn10_weights", """
SELECT doc_id, round((SELECT count(*) FROM labels) / CAST(2 * count(*) OVER (PARTITION BY quality) AS DOUBLE), 6) AS weight
FROM labels""")
def trn10(spark, folder):
    return t.balance_weights(_labels(spark, folder), "quality").select("doc_id", r6("weight").alias("weight"))


@query("trn15_folds", f"SELECT doc_id, CAST((place - 1) % 5 AS BIGINT) AS fold FROM {_PLACED}")
def trn15(spark, folder):
    return t.stratified_folds(_labels(spark, folder), "quality", "doc_id").select("doc_id", big("fold").alias("fold"))


# --- evaluation --------------------------------------------------------------------------------------------------------------

_COUNTS = """
WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS c00, count(*) FILTER (quality = 0 AND toxic = 0) AS c01,
                  count(*) FILTER (quality = 1 AND toxic = 1) AS c10, count(*) FILTER (quality = 1 AND toxic = 0) AS c11
           FROM labels)"""


def _predicted(spark, folder) -> DataFrame:
    """A rule as the model: what is not toxic is predicted to be of quality."""
    return _labels(spark, folder).withColumn("predicted", 1 - F.col("toxic"))


@query("trn13_report", _COUNTS + """,
d AS (SELECT *, CAST(c00 + c01 AS DOUBLE) AS s0, CAST(c10 + c11 AS DOUBLE) AS s1,
        coalesce(c00 / nullif(CAST(c00 + c10 AS DOUBLE), 0), 0) AS p0, coalesce(c00 / nullif(CAST(c00 + c01 AS DOUBLE), 0), 0) AS r0,
        coalesce(c11 / nullif(CAST(c11 + c01 AS DOUBLE), 0), 0) AS p1, coalesce(c11 / nullif(CAST(c11 + c10 AS DOUBLE), 0), 0) AS r1
      FROM c),
e AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
             (c00 + c11) / (s0 + s1) AS acc FROM d),
u AS (SELECT 'Weak' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS s FROM e
UNION ALL SELECT 'Strong', p1, r1, f1, s1 FROM e
UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM e
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM e
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                 (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM e)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM u""")
def trn13(spark, folder):
    report = t.class_report(_predicted(spark, folder), "quality", "predicted")
    return report.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], big("support").alias("support"))


@query("trn14_confusion", _COUNTS + """
SELECT CAST(0 AS BIGINT) AS actual, CAST(0 AS BIGINT) AS predicted, c00 AS n FROM c
UNION ALL SELECT 0, 1, c01 FROM c UNION ALL SELECT 1, 0, c10 FROM c UNION ALL SELECT 1, 1, c11 FROM c""")
def trn14(spark, folder):
    cells = t.confusion(_predicted(spark, folder), "quality", "predicted")
    return cells.select(*[big(c).alias(c) for c in ("actual", "predicted", "n")])


# --- forest: what any good fit determines ----------------------------------------------------------------------------------

_LABELLED = _FEATURES + f"""
, c AS (SELECT count(*) FILTER (quality_score >= 0.5) AS strong, count(*) AS n FROM q),
th AS (SELECT (CASE WHEN least(strong, n - strong) >= 5 THEN CAST(0.5 AS DOUBLE)
               ELSE (SELECT quantile_cont(quality_score, 0.75) FROM q) END) AS threshold FROM c),
l AS (SELECT row_id, CAST(quality_score >= threshold AS BIGINT) AS shortlisted FROM q, th),
placed AS (SELECT *, row_number() OVER (PARTITION BY shortlisted ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS place,
                  count(*) OVER (PARTITION BY shortlisted) AS size FROM l)"""
ACCURACY = 0.9


@query("trn11_forest", _LABELLED + """,
held AS (SELECT shortlisted FROM placed WHERE place <= ceil(size * 0.2))
SELECT class, support, TRUE AS accurate FROM (
  SELECT 'Weak' AS class, count(*) FILTER (shortlisted = 0) AS support FROM held
  UNION ALL SELECT 'Strong', count(*) FILTER (shortlisted = 1) FROM held
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM held))""", _OWN)
def trn11(spark, folder):
    """Fit on the training part, report on the held-out part: rows per class, and whether the accuracy is high."""
    _, report, _ = plans.train(materialize(model_rows(spark, folder)))
    accurate = (F.col("class") != "accuracy") | (F.col("f1") >= ACCURACY)
    return report.select("class", big("support").alias("support"), accurate.alias("accurate"))


@query("trn12_probability", _LABELLED + "SELECT row_id, shortlisted, TRUE AS consistent FROM l", _OWN)
def trn12(spark, folder):
    """Every row with a probability from 0 to 1 that agrees with the predicted class."""
    rows = labelled(spark, folder)
    p = F.col("probability_strong")
    agrees = p.between(0, 1) & F.when(p > 0.5, F.col("predicted") == 1).when(p < 0.5, F.col("predicted") == 0).otherwise(F.lit(True))
    return t.predict(t.fit_forest(rows), rows).select(
        "row_id", big("shortlisted").alias("shortlisted"), agrees.alias("consistent"))


@query("trn15_cross_validation", _LABELLED + """
SELECT CAST((place - 1) % 5 AS BIGINT) AS fold, count(*) AS n, TRUE AS accurate FROM placed GROUP BY 1""", _OWN)
def trn15_cv(spark, folder):
    """Rows of each fold, and whether the model of the other folds is accurate on it."""
    folds = t.cross_validate(labelled(spark, folder), "shortlisted", "row_id")
    return folds.select(big("fold").alias("fold"), "n", (F.col("accuracy") >= ACCURACY).alias("accurate"))


@query("trn16_importances", f"""
SELECT unnest({sql_list(fixed.MODEL_FEATURES).replace("(", "[").replace(")", "]")}) AS feature, TRUE AS a_share, CAST(1 AS DOUBLE) AS total""")
def trn16(spark, folder):
    """Every feature with a share from 0 to 1; the shares sum to 1."""
    shares = t.importances(t.fit_forest(labelled(spark, folder)), spark)
    total = shares.agg(r6(F.sum("importance")).alias("total"))
    return shares.join(F.broadcast(total)).select(  # one row
        "feature", F.col("importance").between(0, 1).alias("a_share"), "total")


@query("trn17_saved_model", _LABELLED + "SELECT row_id, TRUE AS same FROM l", _OWN)
def trn17(spark, folder):
    """Rows that score the same under a model and under that model saved and reloaded."""
    rows = labelled(spark, folder)
    model, path = t.fit_forest(rows), new_folder(spark)
    t.save_model(model, path)
    before = t.predict(model, rows).select("row_id", F.col("probability_strong").alias("before"))
    after = t.predict(t.load_model(spark, path), rows).select("row_id", F.col("probability_strong").alias("after"))
    return before.join(after, "row_id").select("row_id", (F.col("before") == F.col("after")).alias("same"))
