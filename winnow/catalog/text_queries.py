"""Queries over resume text: lines, sections, scalar features, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import fixed
from winnow.catalog import parts as P
from winnow.catalog.fixture import AS_OF_YEAR, jobs, resumes, table
from winnow.catalog.registry import query
from winnow.config import scoring
from winnow.functions import extract, projects, sections
from winnow.functions.common import found, is_blank, numbered, text_lines
from winnow.operators import features as feats
from winnow.operators.scoring import with_job
from winnow.operators.slices import spread

SETTINGS = scoring(AS_OF_YEAR)
KEY = "resume_id"
SECTION_TEXTS = ["work", "education", "projects", "certificates"]


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def joined(col: Column | str, by: str = "|") -> Column:
    return F.array_join(col, by)


def documents(spark, folder: str) -> DataFrame:
    """Documents as resumes: the source is the batch."""
    return spread(table(spark, folder, "documents").select("source", "doc_id", "text")).select(
        F.col("source").alias("batch_id"), F.col("doc_id").alias("resume_id"), F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".docx")).alias("filename"), F.col("text").alias("raw_text"))


def sectioned(spark, folder: str) -> DataFrame:
    return feats.section_texts(feats.with_segments(resumes(spark, folder)), SECTION_TEXTS)


def line_rows(spark, folder: str) -> DataFrame:
    return feats.explode_lines(resumes(spark, folder).select(KEY, "raw_text"))


# --- lines and sections ---------------------------------------------------------------------------------------------

@query("sec1_lines", "SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS line "
       "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def sec1(spark, folder):
    lines = feats.explode_lines(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return lines.select("doc_id", big("pos").alias("pos"), "line")


@query("sec2_standalone", "SELECT resume_id, CAST(pos AS BIGINT) AS pos, line, alone AS section FROM marked "
       "WHERE alone IS NOT NULL")
def sec2(spark, folder):
    rows = line_rows(spark, folder).withColumn("section", sections.standalone_heading(F.col("line")))
    return rows.filter(F.col("section").isNotNull()).select(KEY, big("pos").alias("pos"), "line", "section")


@query("sec3_inline", "SELECT resume_id, CAST(pos AS BIGINT) AS pos, inlined AS section, content FROM filled "
       "WHERE inlined IS NOT NULL")
def sec3(spark, folder):
    line = F.col("line")
    rows = line_rows(spark, folder).filter(sections.standalone_heading(line).isNull())
    return rows.select(KEY, big("pos").alias("pos"), sections.inline_heading(line).alias("section"),
                       sections.inline_content(line).alias("content")).filter(F.col("section").isNotNull())


@query("sec4_fill", "SELECT resume_id, section, content AS line FROM filled WHERE content IS NOT NULL")
def sec4(spark, folder):
    segs = feats.with_segments(resumes(spark, folder)).select(KEY, F.explode("segments").alias("s"))
    return segs.select(KEY, F.col("s.section").alias("section"), F.explode("s.body").alias("line"))


@query("sec5_section_texts", "SELECT resume_id, sections_found, " + ", ".join(f"{s}_text" for s in fixed.SECTIONS)
       + " FROM sectioned")
def sec5(spark, folder):
    rows = feats.section_texts(feats.with_segments(resumes(spark, folder)), fixed.SECTIONS)
    return rows.select(KEY, "sections_found", *[f"{s}_text" for s in fixed.SECTIONS])


@query("sec6_contexts", "SELECT resume_id, CAST(pos AS BIGINT) AS pos, "
       f"{P.found('lower(line)', fixed.EDUCATION_CONTEXT)} AS education, "
       f"{P.found('lower(line)', fixed.PROJECT_CONTEXT)} AS project, "
       f"{P.found('lower(line)', fixed.WORK_CONTEXT)} AS work FROM all_lines")
def sec6(spark, folder):
    line = F.col("line")
    return line_rows(spark, folder).select(
        KEY, big("pos").alias("pos"), sections.is_education(line).alias("education"),
        sections.is_project(line).alias("project"), sections.is_work(line).alias("work"))


@query("sec7_windows", "SELECT resume_id, CAST(pos AS BIGINT) AS pos, context FROM windows "
       f"WHERE {P.found('line', fixed.YEAR_RANGE)}")
def sec7(spark, folder):
    rows = resumes(spark, folder).select(KEY, text_lines(F.lower("raw_text")).alias("lines"))
    dated = numbered(F.col("lines"), lambda line: found(line, fixed.YEAR_RANGE))
    spread = rows.select(KEY, F.transform(dated, lambda d: F.struct(
        d["at"].alias("pos"), sections.context_window(F.col("lines"), d["at"]).alias("context"))).alias("w"))
    return spread.select(KEY, F.inline("w")).select(KEY, big("pos").alias("pos"), "context")


# --- scalar features -------------------------------------------------------------------------------------------------

@query("ext1_contact", f"SELECT resume_id, CAST({P.found('lower(raw_text)', fixed.EMAIL)} "
       f"OR {P.found('lower(raw_text)', fixed.PHONE)} OR contains(lower(raw_text), '{fixed.LINKEDIN}') AS BIGINT) "
       "AS has_contact FROM docs")
def ext1(spark, folder):
    return documents(spark, folder).select(KEY, big(extract.has_contact(F.col("raw_text"))).alias("has_contact"))


@query("ext1_contact_resumes", "SELECT resume_id, has_contact FROM contacts")
def ext1_resumes(spark, folder):
    return resumes(spark, folder).select(KEY, big(extract.has_contact(F.col("raw_text"))).alias("has_contact"))


@query("ext2_stated_in_work", "SELECT resume_id, stated_work IS NOT NULL AS stated, coalesce(stated_work, 0) AS years "
       "FROM experience")
def ext2(spark, folder):
    years = extract.stated_years_in_work(F.col("work_text"))
    return sectioned(spark, folder).select(
        KEY, years.isNotNull().alias("stated"), big(F.coalesce(years, F.lit(0))).alias("years"))


@query("ext3_stated_anywhere", "SELECT resume_id, stated_free IS NOT NULL AS stated, "
       "coalesce(stated_free, 0) AS years FROM experience")
def ext3(spark, folder):
    years = extract.stated_years_anywhere(F.col("raw_text"))
    return resumes(spark, folder).select(
        KEY, years.isNotNull().alias("stated"), big(F.coalesce(years, F.lit(0))).alias("years"))


@query("ext4_ranges_in_work", "SELECT resume_id, ranges_work AS years FROM experience")
def ext4(spark, folder):
    years = extract.capped(extract.range_years(F.lower("work_text"), AS_OF_YEAR))
    return sectioned(spark, folder).select(KEY, big(years).alias("years"))


@query("ext5_ranges_in_context", "SELECT resume_id, ranges_free AS years FROM experience")
def ext5(spark, folder):
    rows = resumes(spark, folder).select(KEY, text_lines(F.lower("raw_text")).alias("lines"))
    dated = rows.select(KEY, extract.dated_lines(F.col("lines")).alias("dated"))
    years = extract.capped(extract.range_years_in_context(F.col("dated"), AS_OF_YEAR))
    return dated.select(KEY, big(years).alias("years"))


@query("ext6_years", "SELECT resume_id, experience_years FROM years")
def ext6(spark, folder):
    rows = feats.with_experience(sectioned(spark, folder), SETTINGS)
    return rows.select(KEY, big("experience_years").alias("experience_years"))


@query("ext7_has_experience", "SELECT resume_id, has_experience FROM years")
def ext7(spark, folder):
    rows = feats.with_experience(sectioned(spark, folder), SETTINGS)
    return rows.select(KEY, big("has_experience").alias("has_experience"))


@query("ext8_mentions", f"""
SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY n) - 1 AS n, mention FROM (
  SELECT resume_id, unnest(range(len(m))) AS n, {P.strip('unnest(m)')} AS mention
  FROM (SELECT resume_id, regexp_extract_all(lower(raw_text), {P.CERTIFICATE_SQL}) AS m FROM docs))
WHERE length(mention) > {fixed.MIN_CERTIFICATE_CHARS}""")
def ext8(spark, folder):
    rows = documents(spark, folder).select(KEY, F.posexplode(extract.certificate_mentions(F.col("raw_text"))))
    return rows.select(KEY, big("pos").alias("n"), F.col("col").alias("mention"))


@query("ext9_certificates", "SELECT resume_id, coalesce(string_agg(mention, '|' ORDER BY n), '') AS certificates, "
       "count(*) AS n FROM certificate_rows GROUP BY resume_id")
def ext9(spark, folder):
    rows = feats.boundary(feats.with_certificates(sectioned(spark, folder))).filter(F.size("certificates") > 0)
    return rows.select(KEY, joined("certificates").alias("certificates"), big(F.size("certificates")).alias("n"))


@query("ext10_degree", "SELECT resume_id, degree_score FROM education")
def ext10(spark, folder):
    return feats.with_education(sectioned(spark, folder)).select(KEY, "degree_score")


def _education(spark, folder) -> DataFrame:
    rows = feats.features(resumes(spark, folder), SETTINGS)
    bonus = extract.field_bonus(F.col("education_words"), F.col("job_words"))
    return with_job(rows, jobs(spark, folder), SETTINGS).withColumn("field_bonus", bonus)


@query("ext11_field_bonus", "SELECT resume_id, field_bonus FROM education_scores")
def ext11(spark, folder):
    return _education(spark, folder).select(KEY, "field_bonus")


@query("ext12_education_quality", "SELECT resume_id, education_quality FROM education_scores")
def ext12(spark, folder):
    quality = extract.education_quality(F.col("degree_score"), F.col("field_bonus"))
    return _education(spark, folder).select(KEY, quality.alias("education_quality"))


@query("ext13_name", "SELECT resume_id, filename, name FROM names")
def ext13(spark, folder):
    return resumes(spark, folder).select(
        KEY, "filename", extract.name_from_filename(F.col("filename")).alias("name"))


@query("ext14_length", "SELECT resume_id, length(raw_text) AS text_length FROM docs")
def ext14(spark, folder):
    return documents(spark, folder).select(KEY, big(extract.text_length(F.col("raw_text"))).alias("text_length"))


# --- projects ---------------------------------------------------------------------------------------------------------

def _project_lines(spark, folder, *keep) -> DataFrame:
    rows = feats.boundary(sectioned(spark, folder))
    rows = rows.filter(F.col("sections_found") & (F.col("projects_text") != ""))
    return rows.select(KEY, "projects_text", text_lines(F.col("projects_text")).alias("lines"), *keep)


@query("prj1_starts", "SELECT resume_id, CAST(n - 1 AS BIGINT) AS pos, line, starts FROM project_flags "
       "JOIN parsed USING (resume_id) WHERE projects_text <> ''")
def prj1(spark, folder):
    lines = F.col("lines")
    flags = F.transform(lines, lambda line, at: F.struct(
        at.alias("pos"), line.alias("line"),
        (~is_blank(line) & projects.starts_project(lines, at)).alias("starts")))
    rows = _project_lines(spark, folder).select(KEY, F.inline(flags))
    return rows.select(KEY, big("pos").alias("pos"), "line", "starts")


@query("prj2_segments", "SELECT resume_id, project FROM project_split JOIN parsed USING (resume_id) "
       "WHERE projects_text <> ''")
def prj2(spark, folder):
    rows = _project_lines(spark, folder).withColumn("openings", projects.opening_lines(F.col("lines")))
    return rows.select(KEY, F.explode(projects.split_projects(F.col("lines"), F.col("openings"))).alias("project"))


@query("prj3_chunks", """
SELECT resume_id, CAST(chunk AS BIGINT) AS chunk, project FROM project_chunks JOIN parsed USING (resume_id) WHERE projects_text <> ''""")
def prj3(spark, folder):
    rows = _project_lines(spark, folder).select(KEY, F.posexplode(projects.chunks(F.col("lines"))))
    return rows.filter(F.col("col") != "").select(KEY, big(F.col("pos") + 1).alias("chunk"), F.col("col").alias("project"))


@query("prj3_chunks_documents", f"""
WITH RECURSIVE ls AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
    SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE NOT regexp_matches(line, '^\\s*$')),
walk AS (
  SELECT doc_id, n, line, length(line) AS run, 1 AS chunk FROM ls WHERE n = 1
  UNION ALL
  SELECT f.doc_id, f.n, f.line, (CASE WHEN w.run > 300 THEN 0 ELSE w.run END) + length(f.line),
         w.chunk + (CASE WHEN w.run > 300 THEN 1 ELSE 0 END)
  FROM walk w JOIN ls f ON f.doc_id = w.doc_id AND f.n = w.n + 1)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, string_agg(line, chr(10) ORDER BY n) AS project
FROM walk GROUP BY doc_id, chunk""")
def prj3_documents(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", text_lines(F.col("text")).alias("lines"))
    cut = rows.select("doc_id", F.posexplode(projects.chunks(F.col("lines"))))
    return cut.filter(F.col("col") != "").select(
        "doc_id", big(F.col("pos") + 1).alias("chunk"), F.col("col").alias("project"))


@query("prj4_whole", "SELECT resume_id, projects_text AS project FROM project_branch WHERE branch = 'whole'")
def prj4(spark, folder):
    rows = feats.with_projects(_project_lines(spark, folder, "sections_found"))
    rows = rows.withColumn("openings", projects.opening_lines(F.col("lines")))
    split = projects.split_projects(F.col("lines"), F.col("openings"))
    rows = feats.boundary(rows.select(KEY, "projects_text", "projects", F.size(split).alias("split")))
    whole = rows.filter((F.col("split") == 0) & (F.col("projects") == F.array("projects_text")))
    return whole.select(KEY, F.col("projects")[0].alias("project"))


@query("prj5_blocks", "SELECT resume_id, CAST(block AS BIGINT) AS block, project FROM project_blocks")
def prj5(spark, folder):
    rows = feats.with_lines(resumes(spark, folder)).select(KEY, "lines")
    rows = rows.withColumn("events", projects.block_events(F.col("lines")))
    blocks = rows.select(KEY, F.posexplode(projects.block_projects(F.col("lines"), F.col("events"))))
    return blocks.select(KEY, big(F.col("pos") + 1).alias("block"), F.col("col").alias("project"))


@query("prj6_projects", "SELECT p.resume_id, count(r.project) AS n, "
       "coalesce(string_agg(r.project, '|' ORDER BY r.n), '') AS projects "
       "FROM parsed p LEFT JOIN project_rows r USING (resume_id) GROUP BY p.resume_id")
def prj6(spark, folder):
    rows = feats.with_projects(sectioned(spark, folder))
    return rows.select(KEY, big(F.size("projects")).alias("n"), joined("projects").alias("projects"))
