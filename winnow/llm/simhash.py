"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

Equal fingerprints are one entry. Entries that may link share the value of at least one of four runs of bits, so each
run's masked pattern is an upper node of the index; a node that holds too many entries is divided again by runs of its
remaining bits, which keeps the same guarantee. Inside a node entries are sorted by Gray rank, so neighbours differ
little: eight at a time they form a node with the mask of the bits all share and their pattern, and so on up. A search
walks down, adds the differences in the bits that each node newly fixes, and leaves a group as soon as they exceed the
limit. Links within a node are reduced to a spanning forest before they leave the task.

Nulls: a null text has no words and fingerprint zero, which links like any other. A null ``doc_id`` links too; a
component's id is its smallest ``doc_id``, null only where no member has one. Repeated rows keep their places. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lean, text_bytes, written
from winnow.llm.components import star_components

BITS, RUNS, FANOUT = 64, 4, 8
NODE_ROWS = 2_048  # entries of a node before its remaining bits divide it
DEPTH = 4  # 64, 48, 36, 27 bits left: nodes cannot grow with the corpus below that
SEARCH_PAIRS = 4_000_000
SEARCH_ROWS = 50_000
SEED = 42


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the shingles' XXH64, as a signed number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and the contract's white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    width = min(width, len(words))
    ones, total = np.zeros(BITS, np.int64), len(words) - width + 1
    for at in range(0, total, 1 << 15):
        stop = min(at + (1 << 15), total)
        hashes = [xxh64_intdigest(joined[a:b], SEED)
                  for a, b in zip(starts[at:stop], ends[at + width - 1:stop + width - 1])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(text.as_py(), width) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())],
                                             [*batch.schema.names[:-1], "print"])

    picked = docs.select(*carry, text_bytes(F.col("text")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(lean(each), f"{schema}, print bigint")


def signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def child_masks(mask: int) -> list[int]:
    """The mask with one of the runs of its remaining bits added, for each run."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(rest) * k // RUNS for k in range(RUNS + 1)]
    return [mask | sum(1 << b for b in rest[a:z]) for a, z in zip(cuts, cuts[1:])]


def upper_nodes(prints: DataFrame, node_rows: int = NODE_ROWS, depth: int = DEPTH) -> DataFrame:
    """``mask, pattern, print``: nodes with at least two entries, divided until they are small or the depth is used."""
    spark = prints.sparkSession
    open_rows = prints.select(F.lit(0).cast("bigint").alias("mask"), F.lit(0).cast("bigint").alias("pattern"), "print")
    masks, done = [0], None
    for level in range(depth):
        children = {m: child_masks(m) for m in masks}
        table = spark.createDataFrame([(signed(m), signed(c)) for m, cs in children.items() for c in cs],
                                      "mask bigint, child bigint")
        masks = [c for cs in children.values() for c in cs]
        grown = written(open_rows.join(F.broadcast(table), "mask").select(
            F.col("child").alias("mask"), F.col("print").bitwiseAND(F.col("child")).alias("pattern"), "print"))
        sizes = written(grown.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        sized = grown.join(sizes, ["mask", "pattern"])
        last = level == depth - 1
        ready = (sized if last else sized.filter(F.col("n") <= node_rows)).drop("n")
        done = ready if done is None else done.unionByName(ready)
        if last or sizes.filter(F.col("n") > node_rows).isEmpty():
            return done
        open_rows = sized.filter(F.col("n") > node_rows).drop("n")
    return done


def gray_rank(print_: Column) -> Column:
    """Place of a fingerprint in the Gray sequence, ordered as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        print_ = print_.bitwiseXOR(F.shiftrightunsigned(print_, shift))
    return print_.bitwiseXOR(F.lit(-(1 << 63)))


class Forest:
    """A hierarchical index over several nodes' entries: ``levels[0]`` are the entries, the last level the nodes."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray):
        self.levels = [(entries, np.full(len(entries), ~np.uint64(0)), None)]
        both_or, both_and, of = entries, entries, groups
        while True:
            first = np.concatenate([[True], of[1:] != of[:-1]])
            begin = np.flatnonzero(first)
            if len(begin) == len(of):
                break
            place = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
            begin = np.flatnonzero(place % FANOUT == 0)
            both_or, both_and = np.bitwise_or.reduceat(both_or, begin), np.bitwise_and.reduceat(both_and, begin)
            mask = ~(both_or ^ both_and)
            self.levels.append((both_and & mask, mask, np.append(begin, len(of))))
            of = of[begin]
        self.root_of = np.searchsorted(of, groups)

    def near(self, asking: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``asking``, entry) at most ``limit`` apart, among entries of the same node."""
        entries = self.levels[0][0]
        prints = entries[asking]
        pattern, mask, _ = self.levels[-1]
        who, node = np.arange(len(asking)), self.root_of[asking]
        apart = np.bitwise_count((prints ^ pattern[node]) & mask[node]).astype(np.int16)
        for level in range(len(self.levels) - 1, 0, -1):
            _, above, begin = self.levels[level]
            pattern, mask, _ = self.levels[level - 1]
            number = begin[node + 1] - begin[node]
            child = np.repeat(begin[node], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            who, fixed, apart = np.repeat(who, number), np.repeat(above[node], number), np.repeat(apart, number)
            apart = apart + np.bitwise_count((prints[who] ^ pattern[child]) & mask[child] & ~fixed)
            kept = apart <= limit
            who, node, apart = who[kept], child[kept], apart[kept]
        return who, node


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places."""
    label = np.arange(n)
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def node_links(entries: np.ndarray, groups: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (entry, entry) that connect what is near within each node. Entries come by node and Gray rank."""
    forest, size = Forest(entries, groups), np.bincount(groups)[groups]
    forest_pairs, at = [], 0
    load = np.cumsum(size)
    while at < len(entries):
        stop = max(at + 1, int(np.searchsorted(load, load[at] + SEARCH_PAIRS)))
        asking = np.arange(at, min(stop, len(entries)))
        who, node = forest.near(asking, limit)
        further = node > asking[who]
        who, node = asking[who][further], node[further]
        if len(who) > 8 * len(entries):  # many links: keep only what connects
            root = spanning([(who, node)], len(entries))
            who = np.flatnonzero(root != np.arange(len(entries)))
            node = root[who]
        forest_pairs.append((who, node))
        at = stop
    root = spanning(forest_pairs, len(entries))
    moved = np.flatnonzero(root != np.arange(len(entries)))
    return entries[moved], entries[root[moved]]


def links(prints: DataFrame, limit: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """``u, v``: links that connect all distinct ``prints`` at most ``limit`` (below the number of runs) bits apart."""
    if limit >= RUNS:
        raise ValueError(f"limit must be below {RUNS}")
    nodes = upper_nodes(prints, node_rows)
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (nodes.repartition(tasks, "mask", "pattern")
               .sortWithinPartitions("mask", "pattern", gray_rank(F.col("print"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(3)]))
            waiting += batch.num_rows
            if waiting < SEARCH_ROWS:
                continue
            rows = np.hstack(held)
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0  # the last node may go on in the next batch
            held, waiting = [rows[:, cut:]], rows.shape[1] - cut if cut else 0
            if cut:
                yield found(rows[:, :cut])
        if held and sum(r.shape[1] for r in held):
            yield found(np.hstack(held))

    def found(rows: np.ndarray) -> pa.RecordBatch:
        changed = np.concatenate([[False], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        a, b = node_links(rows[2].astype(np.int64).view(np.uint64), np.cumsum(changed), limit)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    return ordered.mapInArrow(lean(search), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``fingerprint`` (hexadecimal), ``component_id`` and ``component_print`` (the same for
    all rows of a component and for no other) of every row."""
    prints = written(fingerprints(docs, width, carry))
    entries = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = written(star_components(links(entries.select("print"), limit)))
    rooted = entries.join(roots, entries["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(rooted.join(least, "root").select("print", "component_id", F.col("root").alias("component_print")))
    return prints.join(named, "print").select(
        *carry, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id",
        "component_print")
