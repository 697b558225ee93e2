"""Consistent-hash ring with virtual nodes and bounded loads.

A row's key is hashed to a place on a ring; the next virtual node clockwise names its shard. A shard holds at most its
capacity: what overflows continues clockwise to the next shard with room. Capacities are the whole shares of the row
count, so shard sizes differ by one at most and only the overflow ever leaves its ring position.

The ring is cut into segments whose number depends on parameters only. Rows are dealt by ranges of (segment, place, hash
of the row's columns) into parts of bounded size and sorted there, so their order depends on the rows alone and not on
how the input lies in files; a row number decides among rows that are wholly equal. Rows are counted per arc; from these
counts the driver plans which ranks of which arc go to which shard (at most a few runs per virtual node). A row's rank is
its place in its part after the sizes of the parts before, however many rows share a key.

Nulls: a null ``doc_id`` is a key like any other; a null text has no bytes and checksum zero. Repeated rows are rows of
their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import written

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
CELL_BITS = 12
PART_BITS = 33  # monotonically_increasing_id keeps the partition above these


def ring_nodes(spark: SparkSession, shards: int, nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """``(place, shard)`` of all virtual nodes, in ring order."""
    ids = spark.range(shards * nodes, numPartitions=1)
    place = F.xxhash64(F.concat_ws("/", F.lit(seed), F.pmod("id", F.lit(shards)), F.floor(F.col("id") / shards)))
    rows = ids.select(place.alias("place"), F.pmod("id", F.lit(shards)).alias("shard")).collect()
    return sorted({r["place"]: r["shard"] for r in sorted(rows, key=lambda r: -r["shard"])}.items())


def ring_segments(ring: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """``(segment, arc, cell, lo, hi)`` in clockwise order within each arc; an arc ends at its node."""
    places, width = [p for p, _ in ring], 1 << (64 - CELL_BITS)
    cuts = sorted({*places, *(LOWEST + k * width - 1 for k in range(1, 1 << CELL_BITS)), HIGHEST})
    found, lo = [], LOWEST
    for hi in cuts:
        arc = bisect_left(places, hi)
        wraps = arc == len(places)
        found.append((0 if wraps else arc, not wraps, lo, hi))
        lo = hi + 1
    found.sort()
    return [(k, arc, lo >> (64 - CELL_BITS), lo, hi) for k, (arc, _, lo, hi) in enumerate(found)]


def spill_plan(loads: list[int], shards: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """``(arc, first rank, end rank, shard)``: lower ranks stay, the rest goes clockwise to shards with room."""
    room, runs, spilled = list(capacity), [], []
    for arc, load in enumerate(loads):
        kept = min(load, room[shards[arc]])
        room[shards[arc]] -= kept
        if kept:
            runs.append((arc, 0, kept, shards[arc]))
        if load > kept:
            spilled.append((arc, kept, load))
    onward = list(range(1, len(loads) + 1))  # next node that may have room; nodes found full are passed over for good

    def next_with_room(node: int) -> int:
        walked = []
        while room[shards[node]] == 0:
            walked.append(node)
            node = onward[node] % len(loads)
        for w in walked:
            onward[w] = node
        return node

    for arc, first, end in spilled:
        while first < end:
            node = next_with_room(arc)
            taken = min(end - first, room[shards[node]])
            room[shards[node]] -= taken
            runs.append((arc, first, first + taken, shards[node]))
            first += taken
    return runs


def shard_rows(rows: DataFrame, key: str, shards: int, nodes: int = 128, slice_rows: int = 200_000,
               seed: int = 0) -> DataFrame:
    """Narrow ``rows`` with ``shard`` and ``slot`` (from 0, gapless per shard). All columns of ``rows`` are kept."""
    spark = rows.sparkSession
    ring = ring_nodes(spark, shards, nodes, seed)
    segments = spark.createDataFrame(ring_segments(ring), "_segment int, _arc int, _cell bigint, _lo bigint, _hi bigint")
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = (
        rows.withColumn("_place", place).withColumn("_tie", F.xxhash64(*rows.columns))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_cell", F.shiftright("_place", 64 - CELL_BITS))
        .join(F.broadcast(segments), "_cell").filter(F.col("_place").between(F.col("_lo"), F.col("_hi")))
        .drop("_cell", "_lo", "_hi"))
    order = ["_segment", "_place", "_tie", "_row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slice_rows))
    ordered = written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()).drop("_place", "_tie", "_row"))

    part = F.shiftright("_id", PART_BITS)
    loads = ordered.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the ring
    arcs = [0] * len(ring)
    for r in loads:
        arcs[r["_arc"]] = r["n"]
    total = sum(arcs)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    runs = spill_plan(arcs, [s for _, s in ring], capacity)
    bases = [0, *accumulate(arcs)]  # arcs follow each other in the order of rows
    ends = dict.fromkeys(range(shards), 0)
    planned = []
    for arc, first, end, shard in runs:
        planned.append((arc, bases[arc] + first, bases[arc] + end, shard, ends[shard] - bases[arc] - first))
        ends[shard] += end - first

    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))  # one row per slice_rows rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    plan = spark.createDataFrame(planned, "_arc int, _first bigint, _end bigint, shard int, _shift bigint")
    rank = F.col("_before") + F.col("_id").bitwiseAND((1 << PART_BITS) - 1)
    return (
        ordered.withColumn("_part", part).join(starts, "_part").withColumn("_rank", rank)
        .join(F.broadcast(plan), "_arc")
        .filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
        .withColumn("slot", F.col("_rank") + F.col("_shift"))
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, nodes: int = 128) -> DataFrame:
    """Every document's size, text checksum, shard and slot, under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_rows(narrow, "doc_id", shards, nodes).withColumn("grown_shard", F.lit(None).cast("int"))
