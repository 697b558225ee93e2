"""The training sheet: CSV columns to resume text and job description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow import fixed
from winnow.operators.slices import materialize

# Years stay text: they become part of the resume text as written, and may be unusable as a number.
SCHEMA = ("Skills string, Certifications string, Experience_Years string, Email string, Phone string, "
          "Education string, JobRole string")
MISSING = "nan"
# A quote inside a quoted cell is doubled.
QUOTES = {"quote": '"', "escape": '"'}


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV records of all files at ``path``: ``file, record, is_header``. A quoted cell may hold line breaks.

    A line is inside a cell if an odd number of quotes stands before it in its file. Quotes are counted per split of a
    file, a running sum over the splits tells each how it begins, and only lines of records that have several are brought
    together; so one large file is read by many tasks. Line breaks of any kind become ``\\n``, blank lines between records
    are left out. Quotes stand in pairs, as the format asks; one in the middle of a cell without quotes is not seen as
    text.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.regexp_count("value", F.lit('"')) % 2).alias("odd"))
    lines = materialize(read)  # read twice: the ids must stay
    split = Window.partitionBy("file", "block")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy("file", "block").agg(F.sum("odd").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_open"))
    before = F.coalesce(F.sum("odd").over(split.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(opened, ["file", "block"]).withColumn("inside", (F.col("_open") + before) % 2 == 1)
    start = F.when(~F.col("inside"), F.struct("block", "at"))
    first = F.min(F.when(~F.col("inside") & (F.trim("value") != ""), F.col("at"))).over(split)
    marked = marked.filter(F.col("inside") | (F.trim("value") != "")).select(
        "file", "block", "at", "value", "odd", "inside",
        F.last(start, True).over(split.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("start"),
        (~F.col("inside") & (F.col("block") == 0) & (F.col("at") == first)).alias("is_header"))
    single = ~F.col("inside") & (F.col("odd") == 0)
    several = marked.filter(~single)
    # The last record that a split begins may go on in the next ones.
    last = several.groupBy("file", "block").agg(F.max("start").alias("s")).select(
        "file", "block", F.last("s", True).over(earlier).alias("_before"))
    whole = several.join(last, ["file", "block"]).groupBy("file", F.coalesce("start", "_before").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"), F.max("is_header").alias("is_header"))
    joined = whole.select("file", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("record"), "is_header")
    return marked.filter(single).select("file", F.col("value").alias("record"), "is_header").unionByName(joined)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet's known columns that the file has, by name and in any order, all as text. Several files have the same
    columns in the same order."""
    known = [declared.split(" ")[0] for declared in SCHEMA.split(", ")]
    names = spark.read.options(header="true", multiLine="true", **QUOTES).csv(path).columns  # opens the first file only
    records = sheet_records(spark, path).filter(~F.col("is_header"))
    parsed = F.from_csv("record", ", ".join(f"_{i} string" for i in range(len(names))), QUOTES)
    return records.select(parsed.alias("_row")).select(
        *[F.col(f"_row._{names.index(c)}").alias(c) for c in known if c in names])


def parse_sheet_lines(lines: DataFrame, line: str = "line", schema: str = SCHEMA) -> DataFrame:
    """Sheet columns from CSV lines held in a column."""
    return lines.withColumn("_row", F.from_csv(F.col(line), schema, QUOTES)).select(
        *[c for c in lines.columns if c != line], "_row.*")


def synthesize(sheet: DataFrame) -> DataFrame:
    """Adds ``raw_text`` and ``job_description`` made from the sheet's columns; some columns are optional."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in sheet.columns else F.lit("")

    def written(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(MISSING)) if name in sheet.columns else F.lit("")

    parts = [text("Skills"), text("Certifications"), F.concat(written("Experience_Years"), F.lit(" years experience")),
             text("Email"), written("Phone")]
    if "Education" in sheet.columns:
        parts.append(text("Education"))
    return sheet.select(
        "*",
        F.concat_ws(" ", *parts).alias("raw_text"),
        F.coalesce("JobRole", F.lit(fixed.DEFAULT_TRAINING_JOB)).alias("job_description"),
    )
