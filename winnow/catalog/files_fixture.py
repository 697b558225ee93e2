"""Files, sheets and store rows derived from the given tables."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.catalog.fixture import K, batch_sql, job_sql, raw_text_sql, resumes, skill_list_sql, table
from winnow.functions.skills import matched_skills
from winnow.operators.features import boundary
from winnow.operators.slices import spread
from winnow.sources.files import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_docx(text: str, cells: list[str]) -> bytes:
    """A minimal DOCX: one paragraph per line, then a table with one row."""
    def paragraph(line: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'

    body = "".join(paragraph(line) for line in text.split("\n"))
    row = "".join(f"<w:tc>{paragraph(cell)}</w:tc>" for cell in cells)
    document = f'<w:document xmlns:w="{_SPACE}"><w:body>{body}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>'
    return _zip({"word/document.xml": document.encode()})


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, content in members.items():
            bundle.writestr(name, content)
    return out.getvalue()


PATH = f"""(CASE {K} % 9
  WHEN 0 THEN concat('/in/a/.hidden_', CAST({K} AS VARCHAR(20)), '.docx')
  WHEN 1 THEN concat('/in/a/__meta_', CAST({K} AS VARCHAR(20)), '.docx')
  WHEN 2 THEN concat('/in/a/photo.', CAST({K} AS VARCHAR(20)), '.JPG')
  WHEN 3 THEN concat('/in/b.docx/notes_', CAST({K} AS VARCHAR(20)), '.txt')
  WHEN 4 THEN concat('/in/b/c/scan_', CAST({K} AS VARCHAR(20)), '.PDF')
  WHEN 5 THEN concat('/in/b/noextension', CAST({K} AS VARCHAR(20)))
  ELSE concat('/in/b/c/resume_', CAST({K} AS VARCHAR(20)), '.docx') END)"""
BROKEN_DOCX, BROKEN_ZIP = f"{K} % 50 = 13", f"{K} % 50 = 17"


def paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.expr(PATH).alias("path"))


# Places of written files, some of which other scans pass over.
WRITTEN = f"""(CASE {K} % 8
  WHEN 0 THEN concat('a/.hidden_', CAST({K} AS VARCHAR(20)), '.docx')
  WHEN 1 THEN concat('a/__meta_', CAST({K} AS VARCHAR(20)), '.docx')
  WHEN 2 THEN concat('a/_own_', CAST({K} AS VARCHAR(20)), '.docx')
  WHEN 3 THEN concat('_folder/deep/cv_', CAST({K} AS VARCHAR(20)), '.PDF')
  WHEN 4 THEN concat('.folder/part=1/cv_', CAST({K} AS VARCHAR(20)), '.doc')
  WHEN 5 THEN concat('b.docx/notes_', CAST({K} AS VARCHAR(20)), '.txt')
  WHEN 6 THEN concat('b.docx/photo_', CAST({K} AS VARCHAR(20)), '=[1].JPG')
  ELSE concat('resume_', CAST({K} AS VARCHAR(20)), '.docx') END)"""
WRITTEN_TEXT = f"concat('text of ', CAST({K} AS VARCHAR(20)))"


def written_folder(spark: SparkSession, folder: str, target: str) -> int:
    """Write a small file per customer below ``target``, on executors. Returns their number."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(text.encode())
            yield batch[["path"]]

    root = target if "://" in target else "file:///" + target.removeprefix("file:").lstrip("/")
    rows = spread(table(spark, folder, "customer").select(K)).select(
        F.expr(WRITTEN).alias("path"), F.expr(WRITTEN_TEXT).alias("text"))
    return rows.mapInPandas(write, "path string").count()


def _docx_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for row in batch.itertuples():
            content = make_docx(row.raw_text, [" Key ", str(row.resume_id), "  "])
            contents.append(content[:40] if row.broken else content)
        yield pd.DataFrame({"path": batch["path"], "content": contents})


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content``: every derived resume as a DOCX file, one in fifty cut off."""
    rows = resumes(spark, folder).withColumn(K, F.col("resume_id"))
    rows = rows.select("resume_id", "raw_text", F.expr(PATH).alias("path"), F.expr(BROKEN_DOCX).alias("broken"))
    return small_batches(rows).mapInPandas(_docx_files, "path string, content binary")


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for row in batch.itertuples():
            content = _zip({"cv/": b"", f"cv/{row.k}.docx": b"x", "__MACOSX/._x.docx": b"", "readme.txt": b"hello"})
            contents.append(content[:30] if row.broken else content)
        yield pd.DataFrame({"path": [f"/in/{k}.zip" for k in batch["k"]], "content": contents})


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col(K).alias("k"), F.expr(BROKEN_ZIP).alias("broken"))
    return rows.mapInPandas(_bundles, "path string, content binary")


# --- training sheet ---------------------------------------------------------------------------------------------------

SHEET = {
    "Skills": f"(CASE WHEN {K} % 10 = 9 THEN NULL ELSE {skill_list_sql()} END)",
    "Certifications": f"(CASE {K} % 3 WHEN 0 THEN 'AWS Certified Developer with python and sql' END)",
    "Experience_Years": f"(CASE {K} % 9 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN '7.5' "
                        f"ELSE CAST({K} % 40 AS VARCHAR(20)) END)",
    "Email": f"(CASE WHEN {K} % 2 = 0 THEN concat('u', CAST({K} AS VARCHAR(20)), '@mail.example') END)",
    "Phone": f"(CASE WHEN {K} % 3 = 1 THEN '+1 555 010 2345' END)",
    "Education": f"(CASE {K} % 5 WHEN 0 THEN 'Ph.D in Physics' WHEN 1 THEN 'M.Sc in Computer Science' "
                 f"WHEN 2 THEN 'B.S. in Computer Science' WHEN 3 THEN 'Diploma in Design' END)",
    "JobRole": f"(CASE {K} % 4 WHEN 1 THEN 'python sql docker engineer with computer science background' "
               f"WHEN 2 THEN 'data engineer' WHEN 3 THEN 'physics teacher with python' END)",
}
SHEET_SQL = "SELECT 2 * {k} AS row_id, ".replace("{k}", K) + ", ".join(
    f"{text} AS {name}" for name, text in SHEET.items()) + " FROM customer"


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "customer").select(K)).select(
        (2 * F.col(K)).alias("row_id"), *[F.expr(text).alias(name) for name, text in SHEET.items()])


def sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet's rows as CSV lines, text in quotes, nulls as nothing."""
    rows = sheet(spark, folder)
    quoted = [F.coalesce(F.concat(F.lit('"'), F.col(n), F.lit('"')), F.lit("")) for n in SHEET]
    return rows.select("row_id", F.concat_ws(",", *quoted).alias("line"))


# Notes of a sheet with line breaks, doubled quotes and blank lines inside cells.
BROKEN_LINES = {
    "Skills": f"concat('key ', CAST({K} AS VARCHAR(20)), CASE WHEN {K} % 3 = 0 THEN concat(chr(10), 'python, sql', chr(10), chr(10), 'git') ELSE '' END)",
    "Education": f"(CASE {K} % 4 WHEN 1 THEN concat('said \"B.S.\"', chr(10), 'in, 2010') WHEN 2 THEN 'M.Sc' WHEN 3 THEN chr(10) END)",
    "JobRole": f"concat('role ', CAST({K} % 7 AS VARCHAR(20)))",
}


def broken_sheet(spark: SparkSession, folder: str, path: str) -> None:
    """Writes the sheet of ``BROKEN_LINES`` as CSV files with a header."""
    rows = table(spark, folder, "customer").select(*[F.expr(text).alias(n) for n, text in BROKEN_LINES.items()])
    rows.repartition(2).write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false",
                                      ignoreTrailingWhiteSpace="false").csv(path)


STORED_SQL = f"""
SELECT 2 * {K} + 1 AS row_id, {raw_text_sql()} AS raw_text, {job_sql(batch_sql())} AS job_description
FROM customer"""


def stored(spark: SparkSession, folder: str, terms) -> DataFrame:
    """The derived resumes as stored candidates with their matched skills."""
    rows = spread(table(spark, folder, "customer").select(K)).select(
        (2 * F.col(K) + 1).alias("row_id"), F.expr(raw_text_sql()).alias("raw_text"),
        F.expr(job_sql(batch_sql())).alias("job_description"), F.expr(batch_sql()).alias("batch_id"),
        F.col(K).alias("ordinal"), F.lit("2024-01-01T00:00:00").alias("uploaded_at"),
        F.concat(F.lit("candidate_"), K, F.lit("_resume.docx")).alias("filename"))
    return boundary(rows).withColumn("matched_skills", matched_skills(F.col("raw_text"), terms))


# --- conversations as a store --------------------------------------------------------------------------------------

CONVERSATION = {
    "batch_id": "concat('c', CAST(conv_id AS VARCHAR(20)))",
    "uploaded_at": "concat('2024-01-', lpad(CAST(conv_id % 28 + 1 AS VARCHAR(20)), 2, '0'), 'T', "
                   "lpad(CAST(conv_id % 24 AS VARCHAR(20)), 2, '0'), ':00:00')",
    "job_description": "(CASE conv_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'data engineer' END)",
    "ordinal": "turn",
    "rank": "turn + 1",
    "name": "role",
    "score": "CAST(length(text) % 1000 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "experience_years": "CAST(turn % 5 AS INT)",
    "filename": "concat(role, '_', CAST(conv_id % 50 AS VARCHAR(20)), '.txt')",
    "is_anomaly": "length(text) > 1000",
    "raw_text": "(CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END)",
}
CONVERSATION_SQL = "SELECT " + ", ".join(f"{text} AS {name}" for name, text in CONVERSATION.items()) + \
    ", conv_id FROM conversations"


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        *[F.expr(text).alias(name) for name, text in CONVERSATION.items()])
    return rows.withColumn("matched_skills", F.array("name", F.lit("talk")))
