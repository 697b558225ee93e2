"""Toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of a category sees hashed letter groups of the text and
the probabilities of all earlier categories. While training, those come from models that have not seen the row: each
earlier category is fitted once per fold and predicts the fold left out. A last fit on all rows of the sample serves
prediction. Models are fitted on a bounded sample of labelled rows; every document is scored over its whole text.

Nulls: a null text is empty; rows with a null label of any category, or a null id, are not learned from. A category
with one class only in the sample gets that class's share as a constant. Repeated rows count as often as they occur.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import text_bytes, written

GRAM = 5
FEATURE_BITS = 17
SAMPLE_ROWS = 12_000
FOLDS = 3
LEAST_Z, FULL_Z = 3.0, 5.0
CHUNK = 1 << 20  # bytes of a text looked at at once; neighbours overlap


@dataclass(frozen=True)
class Link:
    """The model of one category: weights of the text's features, of the earlier categories, and the constant."""

    category: str
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


def features(text: bytes, bits: int = FEATURE_BITS) -> np.ndarray:
    """Distinct hashed groups of five bytes of the lower-cased text, words kept apart by one space."""
    text = b" " + b" ".join(text.lower().split()) + b"    "
    seen = np.zeros(1 << bits, bool)
    for at in range(0, len(text) - 8 + 1, CHUNK):
        part = np.frombuffer(text[at:at + CHUNK + 7], np.uint8)
        eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        group = (eight & np.uint64((1 << 8 * GRAM) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        seen[(group >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS,
           bits: int = FEATURE_BITS) -> DataFrame:
    """``doc_id, fold, places`` and a 0/1 column per category, of at most ``rows`` labelled ids, chosen by hash."""
    usable = labels.select("doc_id", *categories).dropna()
    share = max(1, usable.count() // (2 * rows))
    picked = (usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
              .orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [features(text.as_py(), bits) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places, pa.list_(pa.int32()))],
                                             [*batch.schema.names[:-1], "places"])

    named = [F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]
    rows_of = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).join(
        F.broadcast(written(picked.select("doc_id", *named))), "doc_id")  # at most ``rows`` rows
    schema = "doc_id bigint, " + ", ".join(f"y{k} double" for k in range(len(categories))) + ", places array<int>"
    made = rows_of.select("doc_id", *[f"y{k}" for k in range(len(categories))], "text").mapInArrow(each, schema)
    return made.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)))


def telling(rows: DataFrame, label: str, bits: int) -> np.ndarray:
    """How many standard deviations each feature's count among the rows with ``label`` is from what chance gives, in
    units of ``FULL_Z`` and at most a few; 0 below ``LEAST_Z``. Features scaled by it are regularized the more, the
    less they tell, so chance letter groups of clean or wrongly labelled texts do not add up. At most one row per
    feature reaches the driver."""
    counts = rows.select(label, F.explode("places").alias("place")).groupBy("place").agg(
        F.sum(label).alias("with_it"), F.count(F.lit(1)).alias("n")).collect()
    sizes = rows.agg(F.sum(label).alias("with_it"), F.count(F.lit(1)).alias("n")).head()
    share, z = sizes["with_it"] / sizes["n"], np.zeros(1 << bits)
    for r in counts:
        expected = r["n"] * share
        z[r["place"]] = abs(r["with_it"] - expected) / math.sqrt(expected * (1 - share) + 1)
    return np.where(z >= LEAST_Z, np.minimum(z, 4 * FULL_Z) / FULL_Z, 0.0)


def _vectors(rows: DataFrame, earlier: int, scale: np.ndarray) -> DataFrame:
    size, scale = len(scale), scale.astype(np.float32)

    @F.udf(VectorUDT())
    def vector(places, given):  # bounded by the sample
        places = [p for p in places if scale[p]]
        return SparseVector(size + earlier, [*places, *range(size, size + earlier)],
                            [*(float(scale[p]) for p in places), *given])

    given = F.array(*[f"p{k}" for k in range(earlier)]) if earlier else F.array().cast("array<double>")
    return rows.withColumn("features", vector("places", given))


def _fit(rows: DataFrame, label: str, category: str, earlier: int, bits: int, regularization: float):
    """The category's link and, for predicting left-out rows, the scale and the fitted model (None: a constant)."""
    classes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(classes.values())
    if len(classes) < 2:
        p = min(max(classes.get(1.0, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Link(category, np.zeros(1 << bits, np.float32), np.zeros(earlier), math.log(p / (1 - p))), None, None
    scale = telling(rows, label, bits)
    ready = written(_vectors(rows, earlier, scale).select(label, "features"))
    model = LogisticRegression(labelCol=label, maxIter=30, regParam=regularization, standardization=False).fit(ready)
    weights = model.coefficients.toArray()
    scaled = (weights[:1 << bits] * scale.astype(np.float32)).astype(np.float32)
    return Link(category, scaled, weights[1 << bits:], float(model.intercept)), scale, model


def learn_chain(rows: DataFrame, categories: list[str], bits: int = FEATURE_BITS,
                regularization: float = 1e-3) -> list[Link]:
    """The chain fitted on ``rows`` of ``sample`` (written)."""
    chain = []
    for k, category in enumerate(categories):
        label, keep = f"y{k}", rows.columns
        link, _, _ = _fit(rows, label, category, k, bits, regularization)
        chain.append(link)
        if k + 1 == len(categories):
            break
        parts = []
        for fold in range(FOLDS):
            other, scale, model = _fit(rows.filter(F.col("fold") != fold), label, category, k, bits, regularization)
            out = rows.filter(F.col("fold") == fold)
            if model is None:
                guessed = out.withColumn(f"p{k}", F.lit(1 / (1 + math.exp(-other.constant))))
            else:
                guessed = model.transform(_vectors(out, k, scale)).withColumn(f"p{k}", vector_to_array("probability")[1])
            parts.append(guessed.select(*keep, f"p{k}"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = written(rows)
    return chain


def score(docs: DataFrame, chain: list[Link], threshold: float = 0.5, bits: int = FEATURE_BITS) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` per category, and ``toxic``: the last one reaches the threshold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.empty((batch.num_rows, len(chain)))
            for row, text in zip(made, batch.column(1)):
                places = features(text.as_py(), bits)
                for k, link in enumerate(chain):
                    z = link.weights[places].sum(dtype=np.float64) + link.earlier @ row[:k] + link.constant
                    row[k] = 1 / (1 + math.exp(-min(max(z, -500), 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T),
                                              pa.array(made[:, -1] >= threshold)], names)

    names = ["doc_id", *(f"p_{link.category}" for link in chain), "toxic"]
    schema = "doc_id bigint, " + ", ".join(f"`{n}` double" for n in names[1:-1]) + ", toxic boolean"
    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = 0.5) -> DataFrame:
    """Learn a chain from the labelled documents and score all. The last of ``categories`` decides."""
    return score(docs, learn_chain(written(sample(docs, labels, categories)), categories), threshold)
