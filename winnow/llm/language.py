"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram binds its three letter vectors, the first permuted
twice and the second once; a text bundles (sums) its trigrams, and a language's prototype bundles all texts it is
learned from. A text gets the language whose prototype has the largest cosine with it. Learning sums trigram counts
per language over the whole corpus; only prototypes, languages times dimensions, reach the driver.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is any text where nothing was learned. Rows
with a null language are not learned from. A null ``doc_id`` is not held out. Ties go to the language that sorts
first. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lean, text_bytes

SYMBOLS = 128  # a gap, a to z, and hashed places for all other letters
DIMENSIONS = 1024
SEED = 20260101
PASS_CHARS = 1 << 16  # of a text that are bundled at once
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbol_of_code() -> np.ndarray:
    """Symbol of each code point: 0 for what is not a letter."""
    codes = np.arange(0x110000)
    table = np.array([chr(c).isalpha() for c in codes.tolist()])
    symbols = np.where(table, 27 + codes * 40503 % 65537 % (SYMBOLS - 27), 0).astype(np.uint8)
    symbols[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return symbols


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of all symbols, permuted twice, once and not at all."""
    plain = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts. Runs of other characters are one gap; gaps frame the text."""
    symbols = symbol_of_code()[np.frombuffer(text.decode().lower().encode("utf-32-le"), "<u4")]
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    if len(symbols) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.unique((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of the trigrams' vectors. Whole numbers, so any order of adding gives the same."""
    first, second, third = letter_vectors(dimensions)
    total = np.zeros(dimensions)
    for at in range(0, len(codes), 2048):
        c = codes[at:at + 2048]
        bound = first[c // (SYMBOLS * SYMBOLS)] * second[c // SYMBOLS % SYMBOLS] * third[c % SYMBOLS]
        total += counts[at:at + 2048].astype(np.float64) @ bound.astype(np.float64)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``docs`` (``text, lang``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, []).append(trigrams(text.as_py()))
            for lang, parts in found.items():
                codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(sums)],
                    ["lang", "code", "n"])

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            codes, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs.tolist()):
                here = langs == lang
                sums[lang] = sums.get(lang, 0) + bundle(codes[here], n[here], dimensions)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)],
                ["lang", "dim", "v"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = (known.select("lang", text_bytes(F.col("text")).alias("text"))
              .mapInArrow(lean(count), "lang string, code int, n bigint")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    rows = (counts.mapInArrow(lean(bind), "lang string, dim int, v double")
            .groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect())
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["lang"], np.zeros(dimensions))[r["dim"]] = r["v"]
    return {k: found[k] for k in sorted(found) if found[k].any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS,
            carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred, score`` after the columns ``carry``. Only the text is looked at."""
    langs = list(prototypes)
    unit = np.array([v / np.linalg.norm(v) for v in prototypes.values()])

    def guess(text: bytes) -> tuple[str, float]:
        codes, counts = trigrams(text)
        vector = bundle(codes, counts, dimensions) if len(codes) and langs else np.zeros(1)
        norm = np.linalg.norm(vector)
        if not norm:
            return UNKNOWN, 0.0
        cosines = unit @ vector / norm
        best = int(np.argmax(cosines))
        return langs[best], float(min(max(cosines[best], 0.0), 1.0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [guess(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    picked = docs.select(*carry, text_bytes(F.col("text")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(lean(each), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from what is not held out, predict for every document."""
    out = held_out(F.col("doc_id"))
    prototypes = learn(docs.filter(~out))
    return predict(docs.withColumn("held_out", out), prototypes, carry=(*carry, "held_out"))
