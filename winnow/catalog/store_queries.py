"""Queries over files, sheets and the candidate store, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed
from winnow.catalog import files_fixture as ff
from winnow.catalog import parts as P
from winnow.catalog.fixture import K, jobs, resumes
from winnow.catalog.registry import part, query, sql_list
from winnow.catalog.score_queries import ranked_rows
from winnow.catalog.text_queries import KEY, SETTINGS, big, joined, r6
from winnow.operators.slices import scratch_folder
from winnow.sources import files, sheet, store
from winnow.streaming import incremental

part("paths", f"SELECT {K} AS k, {ff.PATH} AS path, regexp_replace({ff.PATH}, '^.*/', '') AS filename FROM customer")
_types = " ".join(f"WHEN lower(regexp_extract(filename, '^\\.*[^.].*(\\.[^.]*)$', 1)) IN {sql_list(exts)} THEN '{group}'"
                  for group, exts in fixed.FILE_TYPES.items())
part("typed_paths", f"""
SELECT * FROM (SELECT *, (CASE {_types} END) AS file_type FROM paths)
WHERE file_type IS NOT NULL AND NOT starts_with(filename, '.') AND NOT starts_with(filename, '__')""")
part("docx_rows", f"""
SELECT p.k, p.path, p.filename, p.file_type, {ff.BROKEN_DOCX.replace(K, 'p.k')} AS broken, x.txt
FROM typed_paths p JOIN (
  SELECT resume_id, concat(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT {P.blank('line')}), chr(10), 'Key | ',
                           CAST(resume_id AS VARCHAR)) AS txt
  FROM all_lines GROUP BY resume_id) x ON x.resume_id = p.k""")
part("sheet", ff.SHEET_SQL)
part("convs", ff.CONVERSATION_SQL)
part("conv_batches", """
SELECT batch_id, any_value(uploaded_at) AS uploaded_at, any_value(job_description) AS job_description,
       count(*) AS candidate_count FROM convs GROUP BY batch_id""")


def new_folder(spark) -> str:
    return f"{scratch_folder(spark)}/winnow-{uuid.uuid4().hex}"


# --- files ----------------------------------------------------------------------------------------------------------------

@query("src1_supported_files", "SELECT path, filename, file_type FROM typed_paths")
def src1(spark, folder):
    return files.supported_files(ff.paths(spark, folder)).select("path", "filename", "file_type")


@query("src1_folder", f"""
SELECT path, regexp_extract(path, '[^/]*$') AS filename, file_type, text FROM (
  SELECT {ff.WRITTEN} AS path, {ff.WRITTEN_TEXT} AS text,
         (CASE {K} % 8 WHEN 3 THEN 'pdf' WHEN 4 THEN 'doc' WHEN 6 THEN 'image' ELSE 'docx' END) AS file_type
  FROM customer WHERE {K} % 8 NOT IN (0, 1, 5))""")
def src1_folder(spark, folder):
    target = new_folder(spark)
    ff.written_folder(spark, folder, target)
    found = files.supported_files(files.scan_folder(spark, target))
    inside = F.substring_index("path", target.rstrip("/").rsplit("/", 1)[1] + "/", -1)
    return found.select(inside.alias("path"), "filename", "file_type", F.col("content").cast("string").alias("text"))


@query("src2_zip_members", f"""
SELECT concat('/in/', CAST({K} AS VARCHAR), '.zip') AS bundle, m AS path, '' AS error
FROM (SELECT {K}, unnest([concat('cv/', CAST({K} AS VARCHAR), '.docx'), '__MACOSX/._x.docx', 'readme.txt']) AS m
      FROM customer WHERE NOT ({ff.BROKEN_ZIP}))
UNION ALL
SELECT concat('/in/', CAST({K} AS VARCHAR), '.zip'), '', 'BadZipFile' FROM customer WHERE {ff.BROKEN_ZIP}""")
def src2(spark, folder):
    members = files.expand_zips(ff.bundles(spark, folder))
    return members.select("bundle", *[F.coalesce(c, F.lit("")).alias(c) for c in ("path", "error")])


@query("src3_docx_text", "SELECT path, (CASE WHEN broken THEN '' ELSE txt END) AS raw_text, "
       "broken AS failed FROM docx_rows WHERE file_type = 'docx'")
def src3(spark, folder):
    docx = files.supported_files(ff.docx_files(spark, folder)).filter(F.col("file_type") == "docx")
    return files.read_docx(docx).select("path", "raw_text", F.col("error").isNotNull().alias("failed"))


@query("src4_parse", "SELECT path, filename, (CASE WHEN file_type = 'docx' THEN (CASE WHEN broken THEN '' ELSE txt END) "
       "WHEN file_type = 'pdf' THEN concat('text of ', path) ELSE '' END) AS raw_text FROM docx_rows")
def src4(spark, folder):
    extracted = files.supported_files(ff.paths(spark, folder)).filter(F.col("file_type") == "pdf").select(
        "path", F.concat(F.lit("text of "), "path").alias("raw_text"))
    return files.parse_files(ff.docx_files(spark, folder), extracted).select("path", "filename", "raw_text")


# --- sheet ----------------------------------------------------------------------------------------------------------------

@query("src5_sheet", "SELECT row_id, " + ", ".join(f"coalesce({c}, '(null)') AS {c}" for c in ff.SHEET) + " FROM sheet")
def src5(spark, folder):
    rows = sheet.parse_sheet_lines(ff.sheet_lines(spark, folder))
    return rows.select("row_id", *[F.coalesce(c, F.lit("(null)")).alias(c) for c in ff.SHEET])


@query("src5_line_breaks", "SELECT " + ", ".join(f"coalesce({text}, '(null)') AS {n}" for n, text in ff.BROKEN_LINES.items())
       + " FROM customer")
def src5_line_breaks(spark, folder):
    """A sheet written as CSV files and read back."""
    path = new_folder(spark)
    ff.broken_sheet(spark, folder, path)
    return sheet.read_sheet(spark, path).select(*[F.coalesce(n, F.lit("(null)")).alias(n) for n in ff.BROKEN_LINES])


part("synthesized", f"""
SELECT row_id, concat(coalesce(Skills, ''), ' ', coalesce(Certifications, ''), ' ', coalesce(Experience_Years, 'nan'),
       ' years experience ', coalesce(Email, ''), ' ', coalesce(Phone, 'nan'), ' ', coalesce(Education, '')) AS raw_text,
       coalesce(JobRole, '{fixed.DEFAULT_TRAINING_JOB}') AS job_description, Skills, Experience_Years FROM sheet""")


@query("src6_synthesized", "SELECT row_id, raw_text, job_description FROM synthesized")
def src6(spark, folder):
    return sheet.synthesize(ff.sheet(spark, folder)).select("row_id", "raw_text", "job_description")


# --- store -----------------------------------------------------------------------------------------------------------------

def batches(spark, folder: str) -> DataFrame:
    return store.nest(store.with_defaults(ff.conversations(spark, folder)))


def stored(spark, folder: str) -> DataFrame:
    return store.flatten(batches(spark, folder))


@query("src7_store_parse", """
SELECT batch_id, candidate_count, FALSE AS corrupt FROM conv_batches
WHERE CAST(batch_id[2:] AS BIGINT) % 7 <> 3
UNION ALL
SELECT '', 0, TRUE FROM conv_batches WHERE CAST(batch_id[2:] AS BIGINT) % 7 = 3""")
def src7(spark, folder):
    text = F.to_json(F.struct("batch_id", "uploaded_at", "job_description", "candidate_count", "candidates"))
    cut = F.substring("batch_id", 2, 20).cast("bigint") % 7 == 3
    lines = batches(spark, folder).select(F.when(cut, F.concat(F.lit("!"), text)).otherwise(text).alias("line"))
    return store.parse_batches(lines).select(
        F.coalesce("batch_id", F.lit("")).alias("batch_id"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.col("_corrupt").isNotNull().alias("corrupt"))


@query("snk1_append", """
SELECT r.batch_id, r.rank, r.name, r.score, r.is_anomaly, r.filename, length(x.raw_text) AS text_length,
       '2024-01-01T00:00:00' AS uploaded_at
FROM ranked r JOIN resumes x USING (resume_id)""")
def snk1(spark, folder):
    """Two appends: the hot batch, then the others. The second leaves the first untouched."""
    ranked = store.with_text(ranked_rows(spark, folder), resumes(spark, folder))
    rows = ranked.withColumn("uploaded_at", F.lit("2024-01-01T00:00:00")).drop("text_length")
    path = new_folder(spark)
    store.append(rows.filter(F.col("batch_id") == "b0"), path)
    store.append(rows.filter(F.col("batch_id") != "b0"), path)
    return store.read_store(spark, path).select(
        "batch_id", "rank", "name", "score", "is_anomaly", "filename",
        big(F.length("raw_text")).alias("text_length"), "uploaded_at")


_WRITTEN = ("batch_id, uploaded_at, coalesce(job_description, '(null)') AS job_description, rank, name, score, "
            "CAST(experience_years AS BIGINT) AS experience_years, filename, is_anomaly, raw_text, concat(name, '|talk') AS "
            "matched_skills, FALSE AS corrupt")


def _read_back(documents: DataFrame) -> DataFrame:
    rows = store.flatten(documents.filter("_corrupt is null"), "(null)")
    return rows.select("batch_id", "uploaded_at", "job_description", "rank", "name", "score",
                       big("experience_years").alias("experience_years"), "filename", "is_anomaly", "raw_text",
                       joined("matched_skills").alias("matched_skills"), F.lit(False).alias("corrupt"))


@query("snk1_documents", f"SELECT {_WRITTEN} FROM convs")
def snk1_documents(spark, folder):
    """The store as JSON documents, a chunk of a batch each, written and read back."""
    path = new_folder(spark)
    store.write_documents(batches(spark, folder), path)
    return _read_back(store.read_document(spark, path, lines=True))


def filled_store(spark, folder: str) -> str:
    """A store of the conversations, written in three appends, then one batch in seven replaced by itself."""
    path, rows = new_folder(spark), ff.conversations(spark, folder)
    number = F.substring("batch_id", 2, 20).cast("bigint")
    for k in range(3):
        store.append(rows.filter(F.pmod(number, F.lit(3)) == k), path)
    store.replace_batches(rows.filter(F.pmod(number, F.lit(7)) == 0), path)
    return path


@query("snk2_manifest", """
SELECT max(uploaded_at) AS last_updated, count(*) AS total_batches, CAST(sum(candidate_count) AS BIGINT) AS total_resumes
FROM conv_batches""")
def snk2_manifest(spark, folder):
    return store.store_totals(spark, filled_store(spark, folder))


@query("sto2_newest", """
SELECT batch_id, rank, name, score, coalesce(job_description, '') AS job_description FROM convs
WHERE batch_id = (SELECT batch_id FROM convs ORDER BY uploaded_at DESC, batch_id DESC LIMIT 1)""")
def sto2_newest(spark, folder):
    """The newest batch by way of the manifest, opening its own epochs only."""
    rows = store.newest_batch(spark, filled_store(spark, folder))
    return rows.select("batch_id", "rank", "name", "score", F.coalesce("job_description", F.lit("")).alias("job_description"))


@query("snk2_totals", """
SELECT max(uploaded_at) AS last_updated, count(*) AS total_batches, CAST(sum(candidate_count) AS BIGINT) AS total_resumes
FROM conv_batches""")
def snk2(spark, folder):
    return store.totals(batches(spark, folder))


@query("snk3_csv_rows", """
SELECT rank AS "Rank", name AS "Name", score AS "Score", experience_years AS "Experience (Yrs)", 'No' AS "Relevant Cert",
       CAST(0 AS BIGINT) AS "Relevant Projects", replace(matched_skills, '|', ', ') AS "Matched Skills",
       replace(jd_matched_skills, '|', ', ') AS "JD Matched Skills",
       (CASE WHEN is_anomaly THEN 'Flagged' ELSE 'Clean' END) AS "Anomaly Status", filename AS "Filename" FROM ranked""")
def snk3(spark, folder):
    rows = store.csv_rows(ranked_rows(spark, folder))
    return rows.withColumns({c: big(F.col(f"`{c}`")) for c in ("Experience (Yrs)", "Relevant Projects")})


@query("snk3_csv_written", """
SELECT CAST(rank AS BIGINT) AS "Rank", name AS "Name", CAST(score AS DOUBLE) AS "Score",
       experience_years AS "Experience (Yrs)", 'No' AS "Relevant Cert", CAST(0 AS BIGINT) AS "Relevant Projects",
       replace(matched_skills, '|', ', ') AS "Matched Skills", replace(jd_matched_skills, '|', ', ') AS "JD Matched Skills",
       (CASE WHEN is_anomaly THEN 'Flagged' ELSE 'Clean' END) AS "Anomaly Status", filename AS "Filename" FROM ranked""")
def snk3_written(spark, folder):
    path = new_folder(spark)
    store.write_csv(ranked_rows(spark, folder), path)
    back = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    texts = ("Matched Skills", "JD Matched Skills")  # an empty text reads back as null
    return back.withColumns({
        **{c: big(F.col(f"`{c}`")) for c in ("Rank", "Experience (Yrs)", "Relevant Projects")},
        "Score": F.col("Score").cast("double"), **{c: F.coalesce(f"`{c}`", F.lit("")) for c in texts}})


@query("sto1_flatten", "SELECT batch_id, uploaded_at, coalesce(job_description, '') AS job_description, rank, name, "
       "score, CAST(experience_years AS BIGINT) AS experience_years, filename, is_anomaly, raw_text, "
       "concat(name, '|talk') AS matched_skills FROM convs")
def sto1(spark, folder):
    return stored(spark, folder).select(
        "batch_id", "uploaded_at", "job_description", "rank", "name", "score",
        big("experience_years").alias("experience_years"), "filename", "is_anomaly", "raw_text",
        joined("matched_skills").alias("matched_skills"))


@query("sto2_latest", """
SELECT batch_id, rank, name, score, coalesce(job_description, '') AS job_description FROM convs
WHERE batch_id = (SELECT batch_id FROM convs ORDER BY uploaded_at DESC, batch_id DESC LIMIT 1)""")
def sto2(spark, folder):
    return store.latest_batch(stored(spark, folder)).select("batch_id", "rank", "name", "score", "job_description")


@query("sto3_batches", "SELECT batch_id, uploaded_at, coalesce(job_description, '(null)') AS job_description, "
       "candidate_count FROM conv_batches")
def sto3(spark, folder):
    return store.headers(batches(spark, folder)).select(
        "batch_id", "uploaded_at", F.coalesce("job_description", F.lit("(null)")).alias("job_description"),
        "candidate_count")


@query("sto3_large_batch", f"""
SELECT 'all' AS batch_id, CAST(count(*) AS BIGINT) AS candidate_count, CAST(1 AS BIGINT) AS total_batches,
       CAST(count(*) AS BIGINT) AS total_resumes FROM customer""")
def sto3_large(spark, folder):
    """All candidates in one batch, which has several chunks beyond ``CHUNK_ROWS``: still one batch of full size."""
    rows = resumes(spark, folder).select(
        F.lit("all").alias("batch_id"), F.lit("2024-01-01T00:00:00").alias("uploaded_at"),
        F.lit("sql").alias("job_description"), "ordinal", "filename")
    nested = store.nest(rows)
    totals = store.totals(nested).select("total_batches", "total_resumes")
    return store.headers(nested).select("batch_id", "candidate_count").join(F.broadcast(totals))  # one row


# --- stream -----------------------------------------------------------------------------------------------------------------

@query("str1_incremental", "SELECT batch_id, rank, name, score, is_anomaly, filename FROM ranked")
def str1(spark, folder):
    """Resumes arrive in several files, batches spread over them; the result equals screening all at once."""
    arrived, out = new_folder(spark), new_folder(spark)
    resumes(spark, folder).repartition(3, KEY).write.parquet(arrived)
    arrivals = incremental.read_arrivals(spark, arrived, files_per_trigger=1)
    incremental.screen_arrivals(arrivals, jobs(spark, folder), out, SETTINGS, keywords_only=True)
    return incremental.candidates(spark, out, SETTINGS).select(
        "batch_id", "rank", "name", "score", "is_anomaly", "filename")


def _in_two_arrivals(spark, folder: str) -> str:
    """The resumes in two arrivals with a compaction after each but the last."""
    arrived, out = new_folder(spark), new_folder(spark)
    for half in (0, 1):
        resumes(spark, folder).filter(F.col(KEY) % 2 == half).write.mode("append").parquet(arrived)
        arrivals = incremental.read_arrivals(spark, arrived)
        incremental.screen_arrivals(arrivals, jobs(spark, folder), out, SETTINGS, keywords_only=True)
        if half == 0:
            incremental.compact(spark, out)
    return out


@query("str1_compacted_first", "SELECT batch_id, rank, name, score, is_anomaly, filename FROM ranked WHERE rank <= 10")
def str1_first(spark, folder):
    """The first ten of every batch, from a compacted folder and what came later."""
    found = incremental.candidates(spark, _in_two_arrivals(spark, folder), SETTINGS, first=10)
    return found.select("batch_id", "rank", "name", "score", "is_anomaly", "filename")


@query("str1_limits", """
SELECT batch_id, n, round(s1 / CAST(n AS DOUBLE), 6) AS mean_length,
       round(CASE WHEN n > 1 THEN sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) ELSE 0 END, 6)
           AS length_deviation
FROM (SELECT batch_id, count(*) AS n, sum(CAST(length(raw_text) AS HUGEINT)) AS s1,
             sum(CAST(length(raw_text) AS HUGEINT) * length(raw_text)) AS s2 FROM resumes GROUP BY batch_id)""")
def str1_limits(spark, folder):
    """Length limits of the batches so far, without reading scores."""
    return incremental.limits(spark, _in_two_arrivals(spark, folder)).select(
        "batch_id", "n", r6("mean_length").alias("mean_length"), r6("length_deviation").alias("length_deviation"))
