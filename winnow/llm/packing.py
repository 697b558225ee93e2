"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. Only how many pieces have each length matters for the
plan, and there are at most ``capacity`` lengths, so the plan is made from that histogram, whatever the size of the
corpus. A bin is opened for the longest length left; a bitset subset-sum over the lengths left finds the fullest
combination that goes with it, which is then removed, as often as the counts allow. Pieces of a length take the
planned places in the order of an exact distributed rank.

Nulls: a null text is an empty document, one piece holding the end token. A null ``doc_id`` is kept. Repeated rows are
documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import lean, text_bytes, written
from winnow.llm.tokens import word_ids

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids followed by ``end_id``. Only documents longer than ``capacity`` are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        ids_of = words.of
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(ids_of(text.as_py()) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.clear()  # the worker lives on; what it remembers would stand beside later steps

    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(lean(cut), PIECES)


def fullest_with(first: int, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How often each length goes into the fullest bin that holds ``first``: subset sums as bits of one number.

    Lengths come in falling order; of equally full combinations the one found first, with the longest lengths, is
    taken. Copies of a length join in powers of two, so a length costs a logarithm of its count.
    """
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        if length > room:
            continue
        count = min(count - (length == first), room // length)
        times = 1
        while count > 0:
            times = min(times, count)
            count -= times
            grown = reach | (reach << (length * times)) & full
            if grown != reach:
                steps.append((reach, length, times))
                reach = grown
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {first: 1}
    for before, length, times in reversed(steps):
        if not before >> total & 1:  # not reachable without this step
            total -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, ranks, first bin, offset)``: rank ``first + i`` of a length goes to ``bin + i``."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    runs, bins = [], 0
    while left:
        lengths = np.array(sorted(left, reverse=True))
        counts = np.array([left[k] for k in lengths.tolist()])
        chosen = fullest_with(int(lengths[0]), lengths, counts, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in chosen.items():
            for _ in range(n):
                runs.append((length, used[length], times, bins, offset))
                used[length] += times
                offset += length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return runs


def in_parts(pieces: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Numbered ``pieces`` with ``part``, below ``parts`` of their length. Equal rows go to different parts too."""
    per_length = pieces.sparkSession.createDataFrame(list(parts.items()), "length bigint, parts int")
    split = F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int")
    return pieces.join(F.broadcast(per_length), "length").withColumn("part", split)


def numbered(pieces: DataFrame) -> DataFrame:
    """Written ``pieces`` with a number ``_row`` of each row that stays the same when they are read again."""
    return written(pieces.withColumn("_row", F.monotonically_increasing_id()))


def pack(pieces: DataFrame, capacity: int, slice_rows: int = 200_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Pass ``numbered`` pieces, others are numbered here."""
    if "_row" not in pieces.columns:
        pieces = numbered(pieces)
    sized = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in sized}
    runs: dict[int, list] = {}
    for length, *run in plan(histogram, capacity):
        runs.setdefault(length, []).append(run)
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in runs.items()}

    # Equal lengths may be a third of all rows: a rank is the rows of earlier parts plus the place in the part.
    parts = {k: -(-n // slice_rows) for k, n in histogram.items()}
    keyed = in_parts(pieces, parts)
    sizes = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    order = Window.partitionBy("length", "part").orderBy("_row")
    ranked = (keyed.withColumn("place", F.row_number().over(order)).join(bases, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("base") + F.col("place") - 1).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length).tolist():
                here = length == value
                first, _, bins, offsets = tables[value]
                run = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = bins[run] + rank[here] - first[run]
                offset[here] = offsets[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), PLACES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens."""
    return pack(numbered(token_pieces(docs, tokenizer, capacity, end_id)), capacity)
