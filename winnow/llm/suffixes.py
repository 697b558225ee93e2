"""Removal of repeated passages by the common-prefix intervals of suffix arrays.

Every string of ``MATCH`` bytes holds a byte group whose hash is the smallest of its neighbourhood (an anchor), at a
place that depends on the string alone. So repeats can only be found between suffixes that start at equal anchors, and
anchors that occur in one text only are dropped before any text moves. The suffixes at one anchor, with what stands to
the left of it, are sorted into an enhanced suffix array. A stack scan of its common-prefix lengths gives the tree of
intervals; the members of an interval share a prefix, and those that also share enough to the left, while the next
byte to the left differs, form a maximal repeat with all its occurrences. Each occurrence in a document whose id is not
the group's smallest is removed.

Texts are compared as UTF-8 bytes; matches never cross documents. Copies of a whole text are decided by its digest and
do not enter the search. Nulls: a null text is empty; a null ``doc_id`` counts as larger than any other, and rows with
equal ids are no earlier document for each other. Texts below ``MATCH`` bytes stay as they are. Repeated rows get equal
results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lean, release, text_bytes, written

MATCH, GRAM = 50, 24
LEFT = MATCH - GRAM  # how far before its anchor a match may begin
NEAR = LEFT + 1  # groups among which an anchor has the smallest hash
CHUNK = 1 << 19  # bytes hashed at once
SETTLE_BYTES = 4 << 20  # of texts whose anchors a task settles together
RANGE_ROWS = 1 << 17  # anchors of a part settled together
SETTLED_ROWS = 1 << 19  # settled anchors a task holds before it sends them on
SEARCH_ROWS = 40_000  # suffixes sorted together, whole anchors
CHECK = 4  # bytes of a second hash that stand for a group's bytes where suffixes travel
HIDDEN = GRAM - CHECK
WIDTH = LEFT + CHECK + MATCH - GRAM
HASH = (1 << 48) - 1  # of a group's hash, what travels
SETTLED = ["part", "marks", "sizes", "hashes", "times"]
ROWS = 1 << 16  # suffixes whose surroundings are taken at once
CROWD = 100_000  # suffixes of one anchor that one task may sort, those within a text included
LAST_ID = (1 << 63) - 1


# --- anchors ---------------------------------------------------------------------------------------------------------

def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the byte groups of ``text`` that are smallest among the groups of some match."""
    places, hashes = [], []
    for at in range(0, max(len(text) - MATCH + 1, 0), CHUNK):
        part = text[at:at + CHUNK + MATCH - 1]
        eight = np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part), strides=(1,))
        groups = len(part) - GRAM + 1
        h = eight[:groups] * np.uint64(0x9E3779B97F4A7C15)
        h ^= (eight[8:groups + 8] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7)
        h += eight[16:groups + 16] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = _slide(h, NEAR, np.minimum)
        room = np.zeros(len(least) + 2 * LEFT, np.uint64)
        room[LEFT:LEFT + len(least)] = least
        found = np.flatnonzero(_slide(room, NEAR, np.maximum) == h)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    if len(text) > CHUNK:
        places, first = np.unique(places, return_index=True)
        hashes = hashes[first]
    return places, hashes


def text_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``which text, place, hash`` of the anchors of several texts, hashed together."""
    which, places, hashes, at = [], [], [], 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < CHUNK):
            size += len(texts[stop])
            stop += 1
        begin = np.cumsum([0] + [len(t) for t in texts[at:stop]])
        p, h = anchors(np.frombuffer(b"".join(texts[at:stop]), np.uint8))
        of = np.searchsorted(begin, p, "right") - 1
        inside = p + GRAM <= begin[of + 1]
        which.append(of[inside] + at)
        places.append((p - begin[of])[inside])
        hashes.append(h[inside])
        at = stop
    if not which:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(which), np.concatenate(places), np.concatenate(hashes)


def shared_anchors(texts: DataFrame) -> DataFrame:
    """``mark, hashes, times``: anchors (little-endian, eight bytes each) that another text has too, per text ``mark``.
    Rows with ``times`` have no mark: they tell how often anchors, shared or not, come again within texts.

    A task settles what repeats among its own texts and sends one text on for each anchor, so an anchor that a third
    of all texts have arrives once per batch. What is settled travels in one row per receiving task and is put together
    there, so a text is one row however many tasks settled its anchors.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        size = 0
        for batch in batches:
            for mark, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if mark not in held:
                    held[mark] = body.as_py()
                    size += len(held[mark])
                if size >= SETTLE_BYTES:
                    yield settled_here(held)
                    held, size = {}, 0
        if held:
            yield settled_here(held)

    def settled_here(held: dict[int, bytes]) -> pa.RecordBatch:
        marks = np.array(list(held), np.int64)
        which, _, h = text_anchors(list(held.values()))
        part = ((h >> np.uint64(48)) * np.uint64(tasks) >> np.uint64(16)).astype(np.int32)
        h &= np.uint64(HASH)
        order = np.lexsort((which, h, part))
        part, h, which = part[order], h[order], which[order]
        fresh = np.ones(len(h), bool)
        same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
        fresh[1:] = ~(same & (which[1:] == which[:-1]))  # an anchor counts once in a text
        times = np.diff(np.append(np.flatnonzero(fresh), len(h)))
        part, h, which = part[fresh], h[fresh], which[fresh]
        lead = np.ones(len(h), bool)
        lead[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        many = np.zeros(len(h), bool)
        many[:-1] |= ~lead[1:]
        many |= ~lead
        rows = {"part": [], "settled": [], "marks": [], "which": [], "low": [], "high": [], "times": []}

        def add(where, number, settled, again=False):
            used, index = np.unique(which[where], return_inverse=True)
            rows["part"].append(number)
            rows["settled"].append(settled)
            rows["marks"].append(marks[used].astype("<i8").tobytes())
            rows["which"].append(index.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes())
            rows["low"].append((h[where] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            rows["high"].append((h[where] >> np.uint64(32)).astype("<u2").tobytes())
            rows["times"].append((times[where] - 1).astype("<u4").tobytes() if again else None)

        settled = np.flatnonzero(many)
        if len(settled):  # of no use to others; spread by text
            spread = (marks[which[settled]] % tasks).astype(np.int64)
            for number in np.unique(spread).tolist():
                add(settled[spread == number], int(number), True)
        leads = np.flatnonzero(lead)
        cuts = np.searchsorted(part[leads], np.arange(tasks + 1))
        for number in range(tasks):
            if cuts[number] < cuts[number + 1]:
                add(leads[cuts[number]:cuts[number + 1]], number, False)
        repeated = np.flatnonzero(times > 1)
        for number in np.unique(part[repeated]).tolist():
            add(repeated[part[repeated] == number], number, False, True)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["part"], pa.int32()), pa.array(rows["settled"], pa.bool_()),
             *(pa.array(rows[c], pa.binary()) for c in ("marks", "which", "low", "high", "times"))], list(rows))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure, open_, again, held = [], {}, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                part, settled, marks, which, low, high, times = (c[row].as_py() for c in batch.columns)
                marks = np.frombuffer(marks, "<i8")
                index = np.frombuffer(which, "<u2" if len(marks) <= 1 << 16 else "<u4")
                packed = marks, index, np.frombuffer(low, "<u4"), np.frombuffer(high, "<u2")
                if times is not None:
                    again.append((*unpacked(*packed), np.frombuffer(times, "<u4")))
                elif settled:
                    sure.append(unpacked(*packed))
                    held += len(index)
                else:
                    open_.setdefault(part, []).append(packed)  # as sent: unpacked, a part takes many times as much
                if held >= SETTLED_ROWS:
                    yield from by_receiver(sure)
                    sure, held = [], 0
        if again:
            mark, h, times = (np.concatenate(x) for x in zip(*again))
            again.clear()
            order = np.lexsort((mark, h))
            mark, h, times = mark[order], h[order], times[order].astype("<i8")
            times[1:][(mark[1:] == mark[:-1]) & (h[1:] == h[:-1])] = 0  # copies of a text are searched once
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                    None, None, h[begin].astype("<u8").tobytes(), np.add.reduceat(times, begin).tobytes()))], SETTLED)
        for rows in open_.values():
            for mark, h in ranges(rows):
                order = np.lexsort((mark, h))
                mark, h = mark[order], h[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff(np.append(begin, len(h)))
                several = np.repeat(mark[begin] != mark[begin + size - 1], size)
                sure.append((mark[several], h[several]))
                held += len(sure[-1][0])
                if held >= SETTLED_ROWS:
                    yield from by_receiver(sure)
                    sure, held = [], 0
        yield from by_receiver(sure)

    def unpacked(marks, index, low, high) -> tuple[np.ndarray, np.ndarray]:
        return marks[index], low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)

    def ranges(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``mark, hash`` of a part's rows, about ``RANGE_ROWS`` at a time, equal hashes together. Every row is sorted."""
        pieces = -(-sum(len(r[1]) for r in rows) // RANGE_ROWS)
        edges = np.array([HASH // pieces * k for k in range(1, pieces)], np.uint64)
        cuts = [[0, *np.searchsorted(unpacked(*r)[1], edges).tolist(), len(r[1])] for r in rows]
        for k in range(pieces):
            some = [unpacked(marks, *(x[c[k]:c[k + 1]] for x in packed)) for (marks, *packed), c in zip(rows, cuts)]
            mark, h = (np.concatenate(x) for x in zip(*some))
            if len(h):
                yield mark, h

    def by_receiver(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Settled anchors, one row per task that puts texts together: the texts, how many each has, the anchors."""
        if not found:
            return
        mark, h = (np.concatenate(x) for x in zip(*found))
        to = (mark % tasks).astype(np.int32)
        order = np.lexsort((mark, to))
        mark, h, to = mark[order], h[order].astype("<u8"), to[order]
        begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.empty(0, int)
        size = np.diff(np.append(begin, len(mark))).astype("<u4")
        cuts = np.searchsorted(to, np.arange(tasks + 1))
        texts_at = np.searchsorted(begin, cuts)
        used = np.flatnonzero(np.diff(cuts)).tolist()
        kinds = (mark[begin].astype("<i8"), texts_at), (size, texts_at), (h, cuts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()),
             *(pa.array([x[at[k]:at[k + 1]].tobytes() for k in used], pa.binary()) for x, at in kinds),
             pa.nulls(len(used), pa.binary())], SETTLED)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["mark", "hashes", "times"], []
        for batch in batches:
            for marks, sizes, hashes, times in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if times is None:
                    held.append((np.frombuffer(marks, "<i8"), np.frombuffer(sizes, "<u4"), np.frombuffer(hashes, "<u8")))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None], pa.int64()), *(pa.array([x], pa.binary()) for x in (hashes, times))], names)
        if not held:
            return
        marks, sizes, h = (np.concatenate(x) for x in zip(*held))
        held.clear()
        mark = np.repeat(marks, sizes)
        order = np.argsort(mark, kind="stable")
        mark, h = mark[order], h[order]
        begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.empty(0, int)
        for at in range(0, len(begin), 5000):
            some = begin[at:at + 5000]
            ends = np.append(begin[at + 1:at + 5001], len(mark))[:len(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark[some]), pa.array([h[a:z].tobytes() for a, z in zip(some, ends)], pa.binary()),
                 pa.nulls(len(some), pa.binary())], names)

    sent = texts.select("mark", "body").mapInArrow(
        lean(send), "part int, settled boolean, marks binary, which binary, low binary, high binary, "
        "times binary")
    settled = sent.repartitionById(tasks, F.col("part")).mapInArrow(
        lean(settle), "part int, marks binary, sizes binary, hashes binary, times binary")
    return settled.repartitionById(tasks, F.col("part")).mapInArrow(
        lean(together), "mark bigint, hashes binary, times binary")


# --- enhanced suffix arrays ------------------------------------------------------------------------------------------

def common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it, within both lengths; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))]).astype(np.int16)


def sort_bytes(groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by group, then bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    keys = wide.view(">u8")
    return np.lexsort((*keys.T[::-1], groups))


def interval_tree(lcp: np.ndarray, least: int) -> np.ndarray:
    """``(length, first, end)`` of the common-prefix intervals of at least ``least`` bytes, by a stack scan.

    ``lcp[i]`` is what suffix ``i`` shares with the one before it. An interval's members share ``length`` bytes and no
    neighbour does.
    """
    found, stack = [], []
    places = np.flatnonzero(lcp >= least)
    last = -2
    for i, shared in zip(places.tolist(), lcp[places].tolist()):
        if i != last + 1:  # nothing goes on across a gap
            while stack:
                length, begin = stack.pop()
                found.append((length, begin, last + 1))
        last, begin = i, i - 1
        while stack and stack[-1][0] > shared:
            length, begin = stack.pop()
            found.append((length, begin, i))
        if not stack or stack[-1][0] < shared:
            stack.append((shared, begin))
    while stack:
        length, begin = stack.pop()
        found.append((length, begin, last + 1))
    return np.array(found, np.int64).reshape(-1, 3)


def repeat_groups(groups: np.ndarray, before: np.ndarray, before_len: np.ndarray, after: np.ndarray,
                  after_len: np.ndarray, shared: int = GRAM,
                  hidden: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats among suffixes of equal ``groups``: ``repeat, member, left, length`` of every occurrence.

    ``after`` are the bytes from the anchor on, ``before`` those to its left, nearest first. A repeat reaches ``left``
    bytes before the anchor and is ``length`` long; within ``MATCH`` bytes it grows neither way without losing members.
    An anchor shares at least ``shared`` bytes of ``after``, which leaves out ``hidden`` equal ones.
    """
    order = sort_bytes(groups, after)
    lcp = common(after[order], after_len[order])
    lcp[1:][groups[order][1:] != groups[order][:-1]] = 0
    tree = interval_tree(lcp, shared)
    tree[:, 0] += hidden
    size = tree[:, 2] - tree[:, 1]
    node = np.repeat(np.arange(len(tree)), size)
    member = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - tree[:, 1], size)]
    inner = sort_bytes(node, before[member])
    node, member = node[inner], member[inner]
    left = common(before[member], before_len[member]) if len(member) else np.empty(0, np.int16)
    left[1:][node[1:] != node[:-1]] = -1
    left[:1] = -1
    least = np.maximum(MATCH - tree[:, 0], 0)[node]
    out, number = [], 0
    for reach in range(LEFT + 1):
        # members of a node that share ``reach`` bytes to the left stand together
        begin = np.flatnonzero(left < reach)
        if not len(begin):
            break
        count = np.diff(np.append(begin, len(left)))
        wider = np.add.reduceat((left < reach + 1).astype(np.int64), begin)  # parts if one byte more must agree
        diverse = (wider > 1) | (reach == LEFT)
        some = (count > 1) & diverse & (least[begin] <= reach)
        if some.any():
            places = np.flatnonzero(np.repeat(some, count))
            out.append((np.repeat(np.cumsum(some)[some] - 1 + number, count[some]), member[places],
                        np.full(len(places), reach), tree[node[places], 0] + reach))
            number += int(some.sum())
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- removal ---------------------------------------------------------------------------------------------------------

SUFFIXES = "part bigint, id bigint, mark bigint, spot bigint, reach bigint, around binary"
SPANS = "id bigint, mark bigint, start bigint, stop bigint"


def suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes at the shared anchors of ``id, mark, body, hashes`` (an array of packed hashes).

    Suffixes of a text with equal surroundings, each at most ``MATCH`` bytes after the one before, share their matches,
    and these leave no gap. They are one row, whose last place is ``reach`` bytes after the first.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from some(batch.slice(at, 256))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bodies, wanted = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        which, place, h = text_anchors(bodies)
        h &= np.uint64(HASH)
        cut = np.searchsorted(which, np.arange(len(bodies) + 1))
        kept = np.zeros(len(h), bool)
        for k, packed in enumerate(wanted):
            kept[cut[k]:cut[k + 1]] = np.isin(h[cut[k]:cut[k + 1]], np.frombuffer(b"".join(packed), "<u8"))
        which, place, h = which[kept], place[kept], h[kept]
        order = np.lexsort((place, h, which))
        which, place, h = which[order], place[order], h[order]
        sizes = np.array([len(b) for b in bodies])
        begin = np.cumsum(sizes + MATCH + LEFT) - sizes - MATCH
        room = np.frombuffer(b"".join(bytes(LEFT) + b + bytes(MATCH) for b in bodies), np.uint8)
        for a in range(0, len(h), ROWS):
            z = a + ROWS
            yield surrounded(ids, marks, which[a:z], place[a:z], h[a:z], sizes, begin, room)

    def surrounded(ids, marks, which, place, h, sizes, begin, room) -> pa.RecordBatch:
        at = (begin[which] + place)[:, None]
        inner = np.ascontiguousarray(room[at + np.arange(GRAM)]).view("<u8") * np.array(
            [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
        inner ^= inner >> np.uint64(31)
        check = (inner.sum(axis=1, dtype=np.uint64) * np.uint64(0x589965CC75374CC3)) >> np.uint64(32)
        around = np.hstack([room[at + np.arange(-LEFT, 0)], check.astype("<u4")[:, None].view(np.uint8),
                            room[at + np.arange(GRAM, MATCH)]])
        ends = np.minimum(place, LEFT) << 8 | np.minimum(sizes[which] - place, MATCH)
        goes_on = np.zeros(len(h), bool)
        goes_on[1:] = ((which[1:] == which[:-1]) & (h[1:] == h[:-1]) & (ends[1:] == ends[:-1])
                       & (place[1:] - place[:-1] <= MATCH))
        near = np.flatnonzero(goes_on)
        goes_on[near] = (around[near] == around[near - 1]).all(axis=1)
        lead = np.flatnonzero(~goes_on)
        reach = place[np.append(lead[1:], len(h)) - 1] - place[lead]
        which, spot = which[lead], (place << 16 | ends)[lead]
        return pa.RecordBatch.from_arrays(
            [pa.array(h[lead].astype(np.int64)), pa.array(ids[which]), pa.array(marks[which]),
             pa.array(spot.astype(np.int64)), pa.array(reach.astype(np.int64)),
             pa.array([a.tobytes() for a in around[lead]], pa.binary())],
            ["part", "id", "mark", "spot", "reach", "around"])

    return texts.select("id", "mark", "body", "hashes").mapInArrow(lean(each), SUFFIXES)


def _spans(rows: np.ndarray, groups: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
    """Spans of the occurrences that are not a repeat's first; ``rows``: id, mark, spot, reach."""
    ids, marks, spot, reach = rows
    place, before_len, after_len = spot >> 16, spot >> 8 & 0xFF, spot & 0xFF
    # equal surroundings share all their matches: only the first document's compete, the others go whole
    key = sort_bytes(groups, around)
    same = np.concatenate([[False], (around[key][1:] == around[key][:-1]).all(axis=1)
                           & (groups[key][1:] == groups[key][:-1]) & (before_len[key][1:] == before_len[key][:-1])
                           & (after_len[key][1:] == after_len[key][:-1])])
    begin = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(ids[key], begin), np.diff(np.append(begin, len(key))))
    whole = np.zeros(len(ids), bool)
    whole[key] = (ids[key] > first) & ((before_len + after_len)[key] >= MATCH)
    lead = np.flatnonzero(~whole)
    repeat, member, left, length = repeat_groups(
        groups[lead], around[lead][:, LEFT - 1::-1], before_len[lead], around[lead][:, LEFT:], after_len[lead] - HIDDEN,
        CHECK, HIDDEN)
    member = lead[member]
    if len(repeat):
        begin = np.flatnonzero(np.concatenate([[True], repeat[1:] != repeat[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[member], begin), np.diff(np.append(begin, len(member))))
        later = ids[member] > least
        member, start = member[later], (place[member] - left)[later]
        stop = start + length[later] + reach[member]
    else:
        start = stop = np.empty(0, np.int64)
    gone = np.flatnonzero(whole)
    of = np.concatenate([member, gone]).astype(np.int64)
    start = np.concatenate([start, (place - before_len)[gone]])
    stop = np.concatenate([stop, (place + after_len + reach)[gone]])
    order = np.lexsort((start, marks[of], ids[of]))
    return _merged(ids[of][order], marks[of][order], start[order], stop[order])


def _merged(ids, marks, start, stop) -> pa.RecordBatch:
    """Overlapping and touching spans of a text as one."""
    if len(ids):
        text = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))])
        shift = text * (int(stop.max()) + 2)  # texts one after another, so that ends never reach into the next
        reach = np.maximum.accumulate(stop + shift)
        new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(ids)) - 1
        ids, marks, start, stop = ids[begin], marks[begin], start[begin], reach[last] - shift[last]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, marks, start, stop)],
                                      ["id", "mark", "start", "stop"])


def spans(found: DataFrame) -> DataFrame:
    """Spans to remove among ``found`` suffixes: every occurrence of a maximal repeat but the first document's."""
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append((np.stack([batch.column(k).to_numpy() for k in range(5)]),
                         np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, WIDTH)))
            waiting += batch.num_rows
            if waiting < SEARCH_ROWS:
                continue
            rows, around = np.hstack([r for r, _ in held]), np.vstack([a for _, a in held])
            new = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
            cut = int(new[-1]) if len(new) else 0  # the last anchor may go on in the next batch
            held, waiting = [(rows[:, cut:], around[cut:])], rows.shape[1] - cut if cut else 0
            if cut:
                yield _spans(rows[1:, :cut], rows[0, :cut], around[:cut])
        if held and sum(r.shape[1] for r, _ in held):
            rows, around = np.hstack([r for r, _ in held]), np.vstack([a for _, a in held])
            yield _spans(rows[1:], rows[0], around)

    return found.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lean(search), SPANS)


def crowded_anchors(shared: DataFrame, crowd: int) -> DataFrame:
    """``part``: anchors with more than ``crowd`` places in all texts, from what ``shared_anchors`` found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if times is None:
                    held.append(hashes)
                    size += len(hashes) // 8
                    if size >= SETTLED_ROWS:
                        yield counted(held)
                        held, size = [], 0
                    continue
                h, again = np.frombuffer(hashes, "<u8").astype(np.int64), np.frombuffer(times, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.zeros(len(h), np.int64)), pa.array(again)], ["part", "n", "again"])
        if held:
            yield counted(held)

    def counted(held: list[bytes]) -> pa.RecordBatch:
        h, n = np.unique(np.frombuffer(b"".join(held), "<u8"), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.astype(np.int64)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], ["part", "n", "again"])

    return shared.select("hashes", "times").mapInArrow(
        lean(count), "part bigint, n bigint, again bigint").groupBy("part").agg(
        F.sum("n").alias("n"), F.sum("again").alias("again")).filter(
        (F.col("n") > 0) & (F.col("n") + F.col("again") > crowd)).select("part")


def crowded_spans(found: DataFrame) -> DataFrame:
    """The spans for anchors with very many suffixes: matches are grouped by their bytes, over all tasks."""
    parts = found.select("*", F.shiftright("spot", 16).alias("place"),
                         F.shiftright("spot", 8).bitwiseAND(F.lit(0xFF)).alias("before"),
                         F.col("spot").bitwiseAND(F.lit(0xFF)).alias("after"))
    at = F.explode(F.sequence(F.greatest(F.lit(MATCH) - F.col("after"), F.lit(0)), F.col("before")))
    matches = written(parts.filter(F.col("before") + F.col("after") >= MATCH).select("*", at.alias("left")).select(
        "part", "left", "id", "mark", "reach", (F.col("place") - F.col("left")).alias("start"),
        F.substring("around", (F.lit(LEFT + 1) - F.col("left")).cast("int"), F.lit(CHECK + MATCH - GRAM)).alias("bytes")))
    keys = ["part", "left", "bytes"]
    least = written(matches.groupBy(keys).agg(F.min("id").alias("least")))
    return joined_spans(matches.join(least, keys).filter("id > least").select(
        "id", "mark", "start", (F.col("start") + F.col("reach") + MATCH).alias("stop")))


def joined_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching ``spans`` of a text as one, so that a text's list is no longer than its passages."""
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if last is not None:
                columns = [np.concatenate(x) for x in zip(last, columns)]
            merged = _merged(*columns)
            yield merged.slice(0, merged.num_rows - 1)
            last = [c.to_numpy() for c in merged.slice(merged.num_rows - 1).columns]  # the next batch may go on with it
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["id", "mark", "start", "stop"])

    return spans.repartition(tasks, "id", "mark").sortWithinPartitions("id", "mark", "start").mapInArrow(lean(join), SPANS)


def cut(rows: DataFrame, keep: bool) -> DataFrame:
    """``rows`` with their ``_body`` and ``_spans`` (null: nothing is removed) replaced by ``n_removed, n_spans,
    _kept_sha`` and ``kept``, the last two null where nothing is removed."""

    def without(body: bytes, parts: list[dict]) -> tuple[bytes, int]:
        kept, end, number, last = [], 0, 0, -1
        for start, stop in sorted((p["start"], p["stop"]) for p in parts):
            if start > end or last < 0:
                number += 1
                kept.append(body[end:start])
            end, last = max(end, stop), 0
        kept.append(body[end:])
        return b"".join(kept), number

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, parts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                if not parts.is_valid:
                    out.append((0, 0, None, None))
                    continue
                body = body.as_py()
                rest, number = without(body, parts.as_py())
                out.append((len(body) - len(rest), number, hashlib.sha256(rest).hexdigest(),
                            rest.decode(errors="ignore") if keep else None))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *(pa.array(list(c), t) for c, t in zip(columns, kinds))],
                [*batch.schema.names[:-2], "n_removed", "n_spans", "_kept_sha", "kept"])

    others = [f for f in rows.schema.fields if f.name not in ("_body", "_spans")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.select(*(f.name for f in others), "_body", "_spans").mapInArrow(
        lean(each), f"{fields}, n_removed bigint, n_spans bigint, _kept_sha string, kept string")


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), keep: bool = False,
                   crowd: int = CROWD) -> DataFrame:
    """The columns ``carry`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the
    text that is left, without the bytes of a character cut in two; null where nothing was removed).

    Texts are shuffled twice, to meet their shared anchors and to meet their spans; the second time the columns
    ``carry`` come along, so a caller need not join the result with ``docs`` again.
    """
    body = text_bytes(F.col("text"))
    key = [F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.xxhash64(body).alias("_mark")]
    rows = docs.select(key[0].alias("id"), key[1].alias("mark"), body.alias("body"))
    facts = written(docs.select(*key, F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("_sha")))
    firsts = written(facts.groupBy("_sha").agg(F.min("_id").alias("_first"), F.first("_mark").alias("_mark")))
    long_texts = rows.filter(F.octet_length("body") >= MATCH)
    shared = written(shared_anchors(long_texts))
    release(docs.sparkSession)
    one_text = firsts.select(F.col("_mark").alias("mark"), F.col("_first").alias("id"))
    wanted = shared.filter("times is null").select("mark", F.array("hashes").alias("hashes")).join(one_text, "mark")
    crowds = written(crowded_anchors(shared, crowd))
    found = suffixes(long_texts.join(wanted, ["id", "mark"]))
    if crowds.isEmpty():
        marked = spans(found)
    else:
        found = written(found)
        marked = spans(found.join(crowds, "part", "left_anti")).unionByName(
            crowded_spans(found.join(crowds, "part", "left_semi")))
    marked = written(marked)
    release(docs.sparkSession)
    removed = marked.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_list(F.struct("start", "stop")).alias("_spans"))
    copies = facts.join(firsts.drop("_mark"), "_sha").filter((F.col("_id") > F.col("_first")) & (F.col("n_bytes") >= MATCH))
    copies = copies.select("_id", "_mark", "n_bytes").distinct().select("_id", "_mark", F.array(F.struct(
        F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop"))).alias("_spans"))
    cuts = written(removed.unionByName(copies))
    joined = docs.select(*carry, *key, body.alias("_text")).join(cuts, ["_id", "_mark"], "left")
    changed = F.col("_spans").isNotNull()
    done = cut(joined.select(
        *carry, F.octet_length("_text").cast("bigint").alias("n_bytes"), F.when(~changed, F.sha2("_text", 256)).alias("_sha"),
        F.when(changed, F.col("_text")).alias("_body"), "_spans"), keep)
    return done.select(*carry, "n_bytes", "n_removed", "n_spans", F.coalesce("_kept_sha", "_sha").alias("kept_sha256"),
                       *(["kept"] if keep else []))
