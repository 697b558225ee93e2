"""The candidate store.

A store is a folder of ``rows`` and a ``manifest``. Every write is one epoch: a folder of candidate rows clustered by
batch, in as many files as its size asks for however many batches it has, and then one manifest row per batch of it
(upload time, job, number of candidates). The manifest row is the commit: rows whose batch and epoch it does not name do
not count. Totals and the newest batch come from the manifest alone, and a batch is read from its own epochs, where its
files are found by their statistics.

The nested document form (batches holding candidates) is read and written in chunks of bounded size.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CANDIDATE = (
    "rank bigint, name string, score double, matched_skills array<string>, jd_matched_skills array<string>, "
    "experience_years int, has_relevant_cert boolean, project_relevance_score double, relevant_projects_count int, "
    "education_quality double, filename string, is_anomaly boolean, anomaly_reason string, raw_text string"
)
# What a candidate field holds when the writer left it out.
DEFAULTS = {
    "rank": 0, "name": "Unknown", "score": 0.0, "matched_skills": [], "jd_matched_skills": [],
    "experience_years": 0, "has_relevant_cert": False, "project_relevance_score": 0.0,
    "relevant_projects_count": 0, "education_quality": 0.0, "filename": "", "is_anomaly": False,
    "anomaly_reason": "", "raw_text": "",
}
FIELDS = list(DEFAULTS)
CHUNK_ROWS = 1000


def _types() -> dict[str, str]:
    return dict(part.strip().split(" ") for part in CANDIDATE.split(","))


def _batch_schema() -> str:
    fields = ", ".join(f"{name}: {kind}" for name, kind in _types().items())
    return ("batch_id string, uploaded_at string, job_description string, candidate_count bigint, "
            f"candidates array<struct<{fields}>>")


def document_schema() -> str:
    batch = ", ".join(_colon(p) for p in (
        "batch_id string", "uploaded_at string", "job_description string", "candidate_count bigint"))
    fields = ", ".join(f"{name}: {kind}" for name, kind in _types().items())
    return ("last_updated string, total_batches int, total_resumes int, "
            f"batches array<struct<{batch}, candidates: array<struct<{fields}>>>>")


def _colon(declaration: str) -> str:
    return declaration.replace(" ", ": ", 1)


# --- reading --------------------------------------------------------------------------------------------------------

MANIFEST = ("batch_id string, uploaded_at string, job_description string, candidate_count bigint, epoch string, "
            "number bigint, replaces boolean")


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, None where there is none yet. Partition values are text even where they look like
    numbers or dates."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as failure:
        if failure.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    typed = StructType([StructField(f.name, StringType()) if f.name in ("batch_id", "epoch") else f for f in found])
    return spark.read.schema(typed).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch and epoch that counts: a batch written by ``replace_batches`` loses what it had before."""
    found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if read_rows(spark, f"{path}/manifest") is not None \
        else spark.createDataFrame([], MANIFEST)
    since = F.max(F.when(F.col("replaces"), F.col("number"))).over(Window.partitionBy("batch_id"))
    return found.withColumn("_since", F.coalesce(since, F.lit(0))).filter("number >= _since").drop("_since")


def batch_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch from the manifest: ``batch_id, uploaded_at, job_description, candidate_count``."""
    return manifest(spark, path).groupBy("batch_id").agg(
        F.max("uploaded_at").alias("uploaded_at"), F.max_by("job_description", "number").alias("job_description"),
        F.sum("candidate_count").alias("candidate_count"))


def store_totals(spark: SparkSession, path: str) -> DataFrame:
    """Header of the store from the manifest: last update, number of batches, number of resumes."""
    return batch_headers(spark, path).agg(
        F.max("uploaded_at").alias("last_updated"), F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("total_resumes"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All candidates that count, with their ``batch_id``; empty where there is no store yet."""
    rows = read_rows(spark, f"{path}/rows")
    if rows is None:
        return spark.createDataFrame([], f"{CANDIDATE}, batch_id string")
    return rows.join(manifest(spark, path).select("epoch", "batch_id"), ["epoch", "batch_id"], "left_semi").drop("epoch")


def read_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """Candidates of one batch. Only its epochs are opened, and in them only row groups that may hold the batch."""
    epochs = [r["epoch"] for r in manifest(spark, path).filter(F.col("batch_id") == batch_id).select("epoch").collect()]
    rows = read_rows(spark, f"{path}/rows")
    if rows is None:
        return read_store(spark, path)
    return rows.filter(F.col("epoch").isin(epochs) & (F.col("batch_id") == batch_id)).drop("epoch")


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of the batch uploaded last, found in the manifest; an empty store gives none."""
    newest = batch_headers(spark, path).agg(F.max(F.struct("uploaded_at", "batch_id"))["batch_id"]).head()[0]
    return read_batch(spark, path, newest) if newest is not None else read_store(spark, path).limit(0)


def read_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Batches of store documents (one JSON document per file, or per line). A corrupt one yields a row with
    ``_corrupt``."""
    documents = (
        spark.read.schema(document_schema() + ", _corrupt string")
        .option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return documents.select(F.explode_outer("batches").alias("b"), "_corrupt").select("b.*", "_corrupt")


def parse_batches(lines: DataFrame, line: str = "line") -> DataFrame:
    """Batches from JSON texts, one batch each. Unreadable text is kept in ``_corrupt``, not dropped."""
    schema = _batch_schema() + ", _corrupt string"
    parsed = F.from_json(F.col(line), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("b")).select("b.*")


def flatten(batches: DataFrame, default_job: str = "") -> DataFrame:
    """One row per candidate with its batch's id, job and upload time."""
    return batches.select(
        "batch_id",
        F.coalesce("job_description", F.lit(default_job)).alias("job_description"),
        F.coalesce("uploaded_at", F.lit("")).alias("uploaded_at"),
        F.explode("candidates").alias("c"),
    ).select("batch_id", "job_description", "uploaded_at", "c.*")


# --- writing --------------------------------------------------------------------------------------------------------

def with_defaults(candidates: DataFrame) -> DataFrame:
    """The store's candidate fields, absent columns and nulls filled; other columns are kept."""
    types = _types()
    filled = []
    for name, default in DEFAULTS.items():
        value = F.array().cast("array<string>") if default == [] else F.lit(default).cast(types[name])
        filled.append((F.coalesce(F.col(name).cast(types[name]), value) if name in candidates.columns
                       else value).alias(name))
    others = [c for c in candidates.columns if c not in DEFAULTS]
    return candidates.select(*others, *filled)


def with_text(candidates: DataFrame, resumes: DataFrame) -> DataFrame:
    """Attach the resume text, which scoring leaves behind. The key is unique, so its groups hold one row."""
    texts = resumes.select("batch_id", "resume_id", "raw_text")
    return candidates.join(texts, ["batch_id", "resume_id"], "left")


def append(candidates: DataFrame, path: str) -> None:
    """Add candidates; a batch may grow over several appends."""
    _commit(candidates, path, replaces=False)


def replace_batches(candidates: DataFrame, path: str) -> None:
    """Write batches in place of those of the same id, leaving all others untouched."""
    _commit(candidates, path, replaces=True)


def compact(spark: SparkSession, path: str) -> None:
    """Write all candidates that count as one epoch, after many small appends. Earlier epochs no longer count."""
    _commit(read_store(spark, path), path, replaces=True)


def _commit(candidates: DataFrame, path: str, replaces: bool) -> None:
    """One epoch. Rows are sorted by ranges of batch and rank, so a hot batch has many files and small ones share them.
    Writers of one store take turns; a write that fails leaves rows that no manifest row names."""
    spark = candidates.sparkSession
    rows = with_defaults(candidates)
    rows = rows.withColumn("batch_id", F.coalesce("batch_id", F.lit("")))
    known = read_rows(spark, f"{path}/manifest")
    number = 1 + ((known.agg(F.max("number")).head()[0] or 0) if known is not None else 0)
    epoch = f"{number:08d}-{uuid.uuid4().hex}"
    folder = f"{path}/rows/epoch={epoch}"
    rows.repartitionByRange("batch_id", "rank").sortWithinPartitions("batch_id", "rank").write.parquet(folder)
    header = {c: F.max(c) if c in rows.columns else F.lit("") for c in ("uploaded_at", "job_description")}
    spark.read.schema(rows.schema).parquet(folder).groupBy("batch_id").agg(
        *[v.alias(c) for c, v in header.items()], F.count(F.lit(1)).alias("candidate_count")).select(
        "*", F.lit(epoch).alias("epoch"), F.lit(number).cast("bigint").alias("number"), F.lit(replaces).alias("replaces")
    ).write.mode("append").parquet(f"{path}/manifest")


def store_documents(batches: DataFrame) -> DataFrame:
    """Store documents of ``nest``ed batches, one per chunk: each is whole by itself, with the store's totals and one
    batch of at most ``CHUNK_ROWS`` candidates; the batch's count is that of its chunk."""
    head = totals(batches)
    batch = F.struct("batch_id", "uploaded_at", "job_description", "candidate_count", "candidates")
    return batches.select(F.array(batch).alias("batches")).join(F.broadcast(head)).select(  # one row
        "last_updated", F.col("total_batches").cast("int").alias("total_batches"),
        F.col("total_resumes").cast("int").alias("total_resumes"), "batches")


def write_documents(batches: DataFrame, path: str) -> None:
    """Write ``nest``ed batches as JSON text, one store document a line, fields without a value included."""
    store_documents(batches).write.option("ignoreNullFields", "false").json(path)


def write_document(batches: DataFrame, path: str, most: int = 100_000) -> None:
    """Write ``nest``ed batches as one JSON document with all batches in order of upload, for readers that take no other.
    A store of more than ``most`` candidates is refused: one document is one row, use ``write_documents``."""
    head = totals(batches).head()
    if (head["total_resumes"] or 0) > most:
        raise ValueError(f"{head['total_resumes']} candidates do not go into one document, at most {most} do")
    whole = batches.groupBy("batch_id", "uploaded_at", "job_description").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "candidates"))), lambda c: c["candidates"])).alias("candidates"))
    entry = F.struct("uploaded_at", "batch_id", "job_description", F.size("candidates").cast("bigint").alias("candidate_count"), "candidates")
    one = whole.agg(F.array_sort(F.collect_list(entry)).alias("b"))
    ordered = F.transform("b", lambda b: F.struct(*[b[n].alias(n) for n in (
        "batch_id", "uploaded_at", "job_description", "candidate_count", "candidates")]))
    one.select(F.lit(head["last_updated"]).alias("last_updated"), F.size("b").alias("total_batches"),
               F.lit(head["total_resumes"] or 0).cast("int").alias("total_resumes"), ordered.alias("batches")).coalesce(1).write.option(
        "ignoreNullFields", "false").json(path)


def nest(candidates: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Candidate rows as nested batches of at most ``CHUNK_ROWS`` candidates: a large batch has several chunks.

    ``ordinal`` numbers the candidates of a batch. The row's ``candidate_count`` counts its own ``chunk``; ``headers``
    gives the batches' totals.
    """
    context = ["batch_id", "uploaded_at", "job_description"]
    chunk = F.floor(F.col(ordinal) / CHUNK_ROWS).alias("chunk")
    fields = [c for c in candidates.columns if c not in (*context, ordinal)]
    entries = candidates.select(*context, chunk, F.struct(ordinal, *fields).alias("entry"))
    grouped = entries.groupBy(*context, "chunk").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return grouped.select(
        *context, "chunk", F.size("entries").cast("bigint").alias("candidate_count"),
        F.transform("entries", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("candidates"))


# --- store queries ---------------------------------------------------------------------------------------------------

def headers(batches: DataFrame) -> DataFrame:
    """One row per batch whatever its size: ``batch_id, uploaded_at, job_description, candidate_count``."""
    return batches.groupBy("batch_id", "uploaded_at", "job_description").agg(
        F.sum("candidate_count").alias("candidate_count"))


def totals(batches: DataFrame) -> DataFrame:
    """Header of the store: last update, number of batches, number of resumes."""
    return batches.agg(
        F.max("uploaded_at").alias("last_updated"),
        F.count_distinct("batch_id").alias("total_batches"),
        F.sum("candidate_count").alias("total_resumes"),
    )


def latest_batch(candidates: DataFrame) -> DataFrame:
    """Candidates of the batch uploaded last; an empty store gives none."""
    newest = candidates.agg(F.max(F.struct("uploaded_at", "batch_id"))["batch_id"].alias("batch_id"))
    return candidates.join(F.broadcast(newest), "batch_id", "left_semi")  # one row, whatever the store's size


def csv_rows(candidates: DataFrame) -> DataFrame:
    """The ten export columns."""
    return candidates.select(
        F.col("rank").alias("Rank"),
        F.col("name").alias("Name"),
        F.col("score").alias("Score"),
        F.coalesce("experience_years", F.lit(0)).alias("Experience (Yrs)"),
        F.when(F.col("has_relevant_cert"), "Yes").otherwise("No").alias("Relevant Cert"),
        F.coalesce("relevant_projects_count", F.lit(0)).alias("Relevant Projects"),
        F.array_join("matched_skills", ", ").alias("Matched Skills"),
        F.array_join(F.coalesce("jd_matched_skills", F.array().cast("array<string>")), ", ")
        .alias("JD Matched Skills"),
        F.when(F.col("is_anomaly"), "Flagged").otherwise("Clean").alias("Anomaly Status"),
        F.col("filename").alias("Filename"),
    )


def write_csv(candidates: DataFrame, path: str) -> None:
    """Export as CSV files with a header, in rank order, quotes doubled."""
    rows = csv_rows(candidates).orderBy("Rank")
    rows.write.mode("errorifexists").option("header", "true").option("quote", '"').option("escape", '"').csv(path)
