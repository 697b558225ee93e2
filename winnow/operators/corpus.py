"""Corpus-weighted text vectors: TF-IDF rows and their cosine with the batch's job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions import vectors
from winnow.operators.slices import SLICE, materialize

# Hash slices of a term or a batch: the rows of one go to this many groups.
TERM_SLICES = 1024


def hash_slice(id_: Column) -> Column:
    """The slice of a row by its id's hash: even whatever the ids look like, at most ``TERM_SLICES`` of them."""
    return F.pmod(F.xxhash64(id_), F.lit(TERM_SLICES))


def term_rows(docs: DataFrame, text: str, id_: str = "resume_id", keep=()) -> DataFrame:
    """``id, slice, term, tf``. Terms are counted inside the row, so each leaves it once."""
    return docs.select(
        *keep, F.col(id_).alias("id"), hash_slice(F.col(id_)).alias(SLICE),
        F.explode(vectors.term_vector(F.col(text))).alias("term", "tf"))


def _idf(documents: int, df: Column) -> Column:
    return F.log((F.lit(documents) + 1.0) / (df + 1.0)) + 1.0


def weighted_rows(rows: DataFrame, documents: int) -> DataFrame:
    """Adds ``weight`` = tf * (ln((1 + N) / (1 + df)) + 1) to term rows.

    A common term is on most documents. Document counts are therefore taken per (term, slice), combined on the map
    side, summed over the at most ``TERM_SLICES`` slices of a term, and joined back on the same key. Pass materialized
    ``rows``: they are read twice.
    """
    per_slice = rows.groupBy("term", SLICE).agg(F.count(F.lit(1)).alias("n"))
    counted = per_slice.select("term", SLICE, F.sum("n").over(Window.partitionBy("term")).alias("df"))
    return rows.join(counted, ["term", SLICE]).withColumn(
        "weight", F.col("tf") * _idf(documents, F.col("df"))).drop("df")


def tfidf_cosine(resumes: DataFrame, jobs: DataFrame, settings: Settings) -> DataFrame:
    """Cosine of each resume with its batch's job under corpus weights: ``resume_id, cosine``.

    Every text is read once, into term rows that are written down. They are weighted once, meet the job's terms in one
    left join, and one aggregation per resume gives length and product. The job side is repeated per existing slice of
    its batch, so the join key (batch, slice, term) has small groups.
    """
    ids = resumes.select(F.col("resume_id").alias("id"), "batch_id")
    rows = materialize(term_rows(resumes, "raw_text", keep=["batch_id"]))
    documents = ids.count()
    job_terms = jobs.select("batch_id", F.explode(vectors.term_vector(
        vectors.similarity_job(F.col("job_description"), settings.default_job))).alias("term", "job_tf"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    job_weighted = job_terms.join(df, "term", "left").select(
        "batch_id", "term", (F.col("job_tf") * _idf(documents, F.coalesce("df", F.lit(0)))).alias("job_weight"))
    job_norms = job_weighted.groupBy("batch_id").agg(
        F.sqrt(F.sum(F.col("job_weight") * F.col("job_weight"))).alias("job_norm"))
    spread = ids.select("batch_id", hash_slice(F.col("id")).alias(SLICE)).distinct()
    job_side = job_weighted.join(job_norms, "batch_id").join(spread, "batch_id")

    weight, job_weight = F.col("weight"), F.col("job_weight")
    sums = weighted_rows(rows, documents).join(job_side, ["batch_id", SLICE, "term"], "left").groupBy("id").agg(
        F.sqrt(F.sum(weight * weight)).alias("norm"), F.sum(weight * job_weight).alias("dot"),
        F.max("job_norm").alias("job_norm"))
    return ids.join(sums, "id", "left").select(
        F.col("id").alias("resume_id"),
        F.coalesce(F.col("dot") / (F.col("norm") * F.col("job_norm")), F.lit(0.0)).alias("cosine"))


# --- hashed terms ----------------------------------------------------------------------------------------------------

CELL_BITS = 18


def cell_of(term: Column, bits: int = CELL_BITS) -> Column:
    """The cell of a term: the leading bits of its MD5."""
    digits = -(-bits // 4)
    return F.shiftright(F.conv(F.substring(F.md5(term), 1, digits), 16, 10).cast("int"), 4 * digits - bits)


def cell_counts(text: Column, bits: int = CELL_BITS) -> Column:
    """ARRAY of ``(cell, tf)`` of a text; terms of one cell are apart and add up where they are used."""
    return F.transform(F.map_entries(vectors.term_vector(text)), lambda e: F.struct(
        cell_of(e["key"], bits).alias("cell"), e["value"].alias("tf")))


@dataclass(frozen=True)
class HashedCorpus:
    """Inverse document frequencies of hashed terms, an array of ``2 ** bits`` numbers whatever the corpus's size."""

    idf: np.ndarray
    bits: int

    def cosines(self, settings: Settings) -> Callable[[DataFrame], DataFrame]:
        """``term_cosines`` with these weights: map-only, the array is broadcast (2 MB at 18 bits). Texts go no further
        than this step, which passes cells to Python in Arrow batches."""
        def compared(df: DataFrame) -> DataFrame:
            job = cell_counts(vectors.similarity_job(F.col("job_description"), settings.default_job), self.bits)
            texts = F.concat(F.array("raw_text"), "certificates", "projects")
            staged = [c for c in df.columns if c != "raw_text"]
            rows = df.select(*staged, F.transform(texts, lambda t: cell_counts(t, self.bits)).alias("_texts"), job.alias("_job"))
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
            step = _comparison(df.sparkSession.sparkContext.broadcast(self.idf))
            n, m = F.size("certificates"), F.size("projects")
            return rows.mapInArrow(step, f"{fields}, _all array<double>").select(
                *staged, F.get("_all", F.lit(0)).alias("_cosine"), F.slice("_all", F.lit(2), n).alias("_certificates"),
                F.slice("_all", n + 2, m).alias("_projects"))
        return compared


def _comparison(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that replaces the last two columns, texts and job, by the texts' cosines under the weights ``shared``."""

    def weighted(entries: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells and their weights."""
        cells = entries.field("cell").to_numpy(zero_copy_only=False)
        distinct, where = np.unique(cells, return_inverse=True)
        return distinct, np.bincount(where, entries.field("tf").to_numpy(zero_copy_only=False), len(distinct)) * shared.value[distinct]

    def cosine(text: pa.StructArray, wanted: np.ndarray, job: np.ndarray) -> float:
        cells, values = weighted(text)
        size = np.sqrt((values ** 2).sum() * (job ** 2).sum())
        if not size > 0:
            return 0.0
        at = np.minimum(np.searchsorted(wanted, cells), len(wanted) - 1)
        same = wanted[at] == cells
        return float((values[same] * job[at[same]]).sum() / size)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, job in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                job = weighted(job.values)
                out.append([cosine(text.values, *job) for text in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.list_(pa.float64()))],
                                             [*batch.schema.names[:-2], "_all"])

    return step


def hashed_corpus(resumes: DataFrame, bits: int = CELL_BITS) -> HashedCorpus:
    """Weights ``ln((1 + N) / (1 + df)) + 1`` of hashed terms, ``df`` the texts of ``resumes`` that have the cell.

    One pass over the texts. Cells are counted in each task before they leave it, so at most ``2 ** bits`` rows a task
    are shuffled and as many collected; no term does.
    """
    cells = F.array_distinct(F.transform(F.map_keys(vectors.term_vector(F.coalesce("raw_text", F.lit("")))),
                                         lambda t: cell_of(t, bits)))
    counted = resumes.select(F.explode(F.concat(cells, F.array(F.lit(-1)))).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).toPandas()
    df = np.zeros((1 << bits) + 1)
    df[counted["cell"].to_numpy()] = counted["n"].to_numpy()  # cell -1, the last, is on every text
    return HashedCorpus(np.log((df[-1] + 1.0) / (df[:-1] + 1.0)) + 1.0, bits)
