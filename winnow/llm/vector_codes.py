"""Vector code compression: product codes found by an equal-average search.

Vectors of whole numbers are cut into equal consecutive parts. Each part position has a codebook, refined by rounds of
assignment and averaging; a vector's code names the nearest entry of every part. A position's entries are sorted by the
sum of their components. A part starts at its own sum and looks outward, nearer sums first; as the squared gap of two
sums, divided by the dimension, never exceeds their squared distance, a part is done once its next gap squared is more
than the dimension times its best distance. Ties go to the lower index, so an equal gap is still looked at.

A pass over the vectors is map-only. A round sends one partial row per position and entry from each task, added up by
Spark, and the new codebooks (positions x entries x width numbers, whatever the input's size) are collected.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as padded with zeros to
the longest, and that to a multiple of the parts; empty vectors are all zeros. Components beyond a limit that keeps all
sums within 64 bits (2^27, or 2^29 over the part width if that is less) count as the limit. The first entries are the
rows of smallest ids, null ids last, equal ids by their stored bytes; with fewer rows there are fewer entries. Rows with
null or repeated ids or repeated vectors are rows of their own. Null labels are one label. An empty table gives no rows.
A label's sum beyond 64 bits is null. Other columns are kept where ``carry`` names them and else ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Labels whose sums may be broadcast; more are joined by label and salt.
BROADCAST_LABELS, SALTS = 100_000, 64
FAR = np.iinfo(np.int64).max


def whole_components(vector: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each component within the limit for a part ``width``."""
    most = min(1 << 27, (1 << 29) // width)
    return np.floor(np.clip(scale * vector.astype(np.float64), -most, most)).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest of ``entries`` for each row of ``parts``, and the distances computed."""
    width = parts.shape[1]
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    entries, sums = entries[order], sums[order]
    own = parts.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    found = np.full(len(parts), len(entries), np.int64)
    best = np.full(len(parts), FAR)
    alive, computed = np.arange(len(parts)), 0
    padded = np.concatenate([sums, [0]])  # places -1 and len(entries) are never taken
    while len(alive):
        down, up, at = left[alive], right[alive], own[alive]
        below = np.where(down >= 0, at - padded[down], FAR)
        above = np.where(up < len(entries), padded[up] - at, FAR)
        gap = np.minimum(below, above)
        limit = best[alive]
        more = (gap != FAR) & ((limit == FAR) | (np.where(gap == FAR, 0, gap) ** 2 <= width * np.where(limit == FAR, 0, limit)))
        if not more.all():
            alive, down, up, below, above = (x[more] for x in (alive, down, up, below, above))
            if not len(alive):
                break
        take_down = below <= above
        place = np.where(take_down, down, up)
        away = parts[alive] - entries[place]
        distance = np.einsum("ij,ij->i", away, away)
        computed += len(alive)
        index = order[place]
        better = (distance < best[alive]) | ((distance == best[alive]) & (index < found[alive]))
        changed = alive[better]
        best[changed], found[changed] = distance[better], index[better]
        left[alive] -= take_down
        right[alive] += ~take_down
    return found, best, computed


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("data")
    out = np.zeros((len(column), dims), np.int64)
    for row, value in zip(out, column.to_pylist()):
        row[:len(value) // 8] = np.frombuffer(value, "<i8")
    return out


def whole_vectors(rows: DataFrame, parts: int, scale: int, carry: tuple[str, ...]) -> tuple[DataFrame, int]:
    """Written rows ``vec_id, data`` and ``carry`` of all vectors that take part, and the padded dimension."""
    kept = F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.filter(kept)
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).head()["n"] or 0
    width = max(1, -(-longest // parts))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            data = [whole_components(v.values.to_numpy(zero_copy_only=False), scale, width).astype("<i8").tobytes()
                    for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())],
                                             [*batch.schema.names[:-1], "data"])

    chosen = kept.select("vec_id", *carry, "embedding")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return written(chosen.mapInArrow(scaled, f"{fields}, data binary")), width * parts


def first_codebooks(vectors: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """``(parts, entries, width)`` of the rows with the smallest ids."""
    width = dims // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "data").select("data").limit(entries).collect()
    table = np.zeros((len(first), dims), np.int64)
    for row, r in zip(table, first):
        row[:len(r["data"]) // 8] = np.frombuffer(r["data"], "<i8")
    return np.ascontiguousarray(table.reshape(len(first), parts, width).transpose(1, 0, 2))


def refine(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries that parts were assigned to become floor(sum / count) of them."""
    parts, entries, width = codebooks.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            matrix = _matrix(batch, parts * width).reshape(-1, parts, width)
            for p in range(parts):
                found, _, _ = nearest(matrix[:, p], codebooks[p])
                counts[p] += np.bincount(found, minlength=entries)
                np.add.at(sums[p], found, matrix[:, p])
        part, entry = np.nonzero(counts)
        flat = sums[part, entry].reshape(-1)
        each = np.repeat(np.arange(len(part)), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[each]), pa.array(entry[each]), pa.array(np.tile(np.arange(width), len(part))),
             pa.array(counts[part, entry][each]), pa.array(flat)], ["part", "entry", "at", "n", "total"])

    partial = vectors.select("data").mapInArrow(added, "part bigint, entry bigint, at bigint, n bigint, total bigint")
    result = codebooks.copy()
    for r in partial.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        result[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return result


def encode(vectors: DataFrame, codebooks: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """``vec_id``, ``carry``, ``code`` (two hex digits a part) and ``error`` of every vector."""
    parts, entries, width = codebooks.shape
    digits = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch, parts * width).reshape(-1, parts, width)
            codes, errors = np.empty((len(matrix), parts), np.int64), np.zeros(len(matrix), np.int64)
            for p in range(parts):
                codes[:, p], distance, _ = nearest(matrix[:, p], codebooks[p])
                errors += distance
            texts = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(errors)],
                                             [*batch.schema.names[:-1], "code", "error"])

    chosen = vectors.select("vec_id", *carry, "data")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(coded, f"{fields}, code string, error bigint")


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def decode(codes: list[str], codebooks: np.ndarray) -> np.ndarray:
    """The vectors that ``codes`` stand for."""
    parts = codebooks.shape[0]
    index = np.array([[int(c[2 * p:2 * p + 2], 16) for p in range(parts)] for c in codes]).reshape(-1, parts)
    return codebooks[np.arange(parts), index].reshape(len(codes), -1)


def with_label_error(coded: DataFrame, label: str, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` (a written table) with ``label_error``, the sum of ``error`` over rows of its label."""
    sums = written(coded.groupBy(F.col(label).alias("_label")).agg(F.expr("try_sum(error)").alias("label_error")))
    if sums.count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), coded[label].eqNullSafe(sums["_label"])).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, (salted["_salt"] == spread["_salt"]) & salted[label].eqNullSafe(spread["_label"])).drop(
        "_label", "_salt")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of all vectors, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits name at most 256 entries")
    vectors, dims = whole_vectors(rows, parts, scale, ("label",))
    codebooks = first_codebooks(vectors, dims, parts, entries)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = refine(vectors, codebooks)
    coded = with_label_error(written(encode(vectors, codebooks, ("label",))), "label")
    return coded.withColumn("codebooks_sha256", F.lit(codebook_digest(codebooks))), codebooks
