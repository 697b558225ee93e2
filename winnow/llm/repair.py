"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows, in order, are edited so that their role initials read ``(s?(ua)+)?``: a row is kept (K, no cost),
given another role (R, 2) or deleted (D, 3), and rows of user or assistant without text may be inserted before any row or
at the end (I, 2). Blank and duplicate rows must be deleted, a truncated row costs 1 more unless it is. Of the cheapest
repairs the one with the least audit (its edits' letters, in order) is taken.

The search keeps an explicit stack. A node is a row and the state reached (nothing yet, after system, user, assistant);
a suffix bound says what the rest costs at least, children lie on the stack by falling bound, and a node whose cost with
its bound exceeds the incumbent's is left. A table per node holds its best (cost, audit) so far; a prefix that is no
better is dropped. The search ends when the stack is empty, which proves the incumbent best. ``cost_bounds`` is the tightest
suffix bound, so the first dive already meets the least cost and the search visits a node a few times at most;
``forced_bounds`` counts only what faults force, as a check.

Conversations may be of any length. Rows are dealt by ranges of (conversation, turn, role, digest of the text) into
segments of bounded size. Within a segment every conversation but the first and the last is whole and searched at once.
The rows of those two are searched for each state they may be entered and left in, with audits that end with a row's edit,
so that equal costs can be told apart by ranks of audits; a small table per conversation then chooses the states between
its segments. The digest of a repaired conversation is one stream of bytes by nature: its rows pass one task in order,
a batch at a time, and so does its audit, which is one cell of the result.

Nulls: a null turn sorts first and is no turn of its own; a null role or text has to be filled by the caller (``damage``
puts a space). Rows of equal turn are ordered by role and by the text's SHA-256. Repeated rows are rows of their own, all
but the first duplicates. A null conversation id is one conversation. Conversations without rows and empty tables: zeros
and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from winnow.llm.common import lean, written

SEGMENT_ROWS = 100_000
RUN_BITS = 33  # monotonically_increasing_id keeps the partition above these
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FOLLOWING = (USER, USER, ASSISTANT, USER)  # the state that an insert or a new role leads to
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
# What a row may lead to when kept: a system row only at the very start.
KEPT_FROM = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
TURN_COST, DROP_COST, INSERT_COST = 2, 3, 2
SOUND, TRUNCATED, DOOMED = range(3)
NEVER = 1 << 60
TRAIL = " \t\n\x0b\f\r"


def _edits(state: int, role: int, fault: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits of a row, letters rising."""
    edits = [("D", DROP_COST, state)]
    if fault != DOOMED:
        if role and state in KEPT_FROM[role]:
            edits.append(("K", fault, role))
        edits.append(("R", TURN_COST + fault, FOLLOWING[state]))
    return edits


EDITS = {(s, r, f): _edits(s, r, f) for s in range(4) for r in range(4) for f in range(3)}


def cost_bounds(roles: bytes, faults: bytes, last: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """For every row and state the least cost of the rest, whatever its audit; ``last``: cost of ending in a state."""
    after = tuple(last.get(s, NEVER) for s in range(4))
    bounds = [after]
    for role, fault in zip(reversed(roles), reversed(faults)):
        row = [min(cost + after[to] for _, cost, to in EDITS[s, role, fault]) for s in range(4)]
        user, assistant = min(row[USER], INSERT_COST + row[ASSISTANT]), min(row[ASSISTANT], INSERT_COST + row[USER])
        after = (min(row[START], INSERT_COST + user), min(row[SYSTEM], INSERT_COST + user), user, assistant)
        bounds.append(after)
    bounds.reverse()
    return bounds


def forced_bounds(roles: bytes, faults: bytes, last: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Only what faults force: deletions and truncated rows."""
    bounds, rest = [(0,) * 4], 0
    for fault in reversed(faults):
        rest += DROP_COST if fault == DOOMED else fault
        bounds.append((rest,) * 4)
    bounds.reverse()
    return bounds


class _Audit:
    """An audit as a link to the one before its last letter, with a jump back that makes comparing take few steps."""

    __slots__ = ("before", "letter", "length", "jump")

    def __init__(self, before: _Audit | None, letter: str):
        self.before, self.letter = before, letter
        if before is None:
            self.length, self.jump = 0, self
        else:
            far = before.jump
            self.length = before.length + 1
            self.jump = far.jump if before.length - far.length == far.length - far.jump.length and before.length else before

    def at(self, length: int) -> _Audit:
        link = self
        while link.length > length:
            link = link.jump if link.jump.length >= length else link.before
        return link

    def earlier(self, other: _Audit) -> bool:
        """Whether this audit is less than ``other``. Both come from one search: equal beginnings are shared links."""
        shorter = min(self.length, other.length)
        a, b = self.at(shorter), other.at(shorter)
        if a is b:
            return self.length < other.length
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter

    def text(self) -> str:
        letters, link = [], self
        while link.before is not None:
            letters.append(link.letter)
            link = link.before
        return "".join(reversed(letters))


def search(roles: bytes, faults: bytes, entry: int, last: dict[int, int], bounds=None) -> tuple[int, str] | None:
    """Least ``(cost, audit)`` over ``roles`` and ``faults`` from state ``entry`` to a state in ``last`` (with its cost),
    the audit without what the end costs; None where no state of ``last`` can be reached."""
    bounds = (bounds or cost_bounds)(roles, faults, last)
    rows, best, incumbent = len(roles), NEVER, None
    table: dict[tuple[int, int], tuple[int, _Audit]] = {}
    stack = [(bounds[0][entry], 0, entry, 0, _Audit(None, ""))]
    while stack:
        least, row, state, cost, link = stack.pop()
        if least > best or least >= NEVER:
            continue
        known = table.get((row, state))
        if known is not None and not (cost < known[0] or (cost == known[0] and link.earlier(known[1]))):
            continue
        table[row, state] = cost, link
        if row == rows:
            if state in last:
                cost += last[state]
                # every audit ends with an edit of the last row, so none begins with another, whatever the end adds
                if cost < best or (cost == best and link.earlier(incumbent)):
                    best, incumbent = cost, link
            continue
        below = []
        for letter, price, to in EDITS[state, roles[row], faults[row]]:
            below.append((cost + price + bounds[row + 1][to], letter, row + 1, to, cost + price))
        to = FOLLOWING[state]
        below.append((cost + INSERT_COST + bounds[row][to], "I", row, to, cost + INSERT_COST))
        below.sort(reverse=True)
        for least, letter, at, to, price in below:
            if least <= best:
                stack.append((least, at, to, price, _Audit(link, letter)))
    return None if best == NEVER else (best, incumbent.text())


ENDS = {s: INSERT_COST * len(TAILS[s]) for s in range(4)}


def whole(roles: bytes, faults: bytes, bounds=None) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    cost, audit = search(roles, faults, START, ENDS, bounds)
    return cost, audit + TAILS[_state_after(roles, audit)]


def _state_after(roles: bytes, audit: str, state: int = START) -> int:
    row = 0
    for letter in audit:
        if letter in "IR":
            state = FOLLOWING[state]
        elif letter == "K":
            state = roles[row]
        row += letter != "I"
    return state


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: ``conv_id, turn, role, text, copies`` (0: dropped)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = filled("text")
    return conversations.select("conv_id", "turn", filled("role").alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def ordered_rows(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Written rows with ``id`` in the order of conversations and turns and the ``segment`` each lies in."""
    session = rows.sparkSession
    segments = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // segment_rows))
    copies = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "spread"]
    sorted_rows = copies.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(
        segments, *order).sortWithinPartitions(*order)
    return written(sorted_rows.select("conv_id", "turn", "role", "text", "digest",
                                      F.monotonically_increasing_id().alias("id")))


def row_facts(ordered: DataFrame) -> DataFrame:
    """``segment, id, conv_id, turn, initial, fault`` of every row: what the search needs of it, without its text."""
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(TRAIL))
    facts = ordered.select("id", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"),
                           F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    return facts.join(first, "id", "left").select(
        F.shiftright("id", RUN_BITS).alias("segment"), "id", "conv_id", "turn", "initial", fault.alias("fault"))


RUN_SCHEMA = ("conv_id {key}, id bigint, entry int, exit int, cost bigint, rank int, audit string, blank bigint, "
              "duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
              "turns bigint, first_turn bigint, last_turn bigint, least_turn bigint, open boolean")


class _Run:
    """Rows of one conversation within a segment."""

    def __init__(self, conv_id, first: int, segment: int, at_edge: bool):
        self.conv_id, self.id, self.segment, self.open = conv_id, first, segment, at_edge
        self.roles, self.faults = bytearray(), bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initials = 0, ["", ""]
        self.turns, self.turn, self.first_turn, self.least = 0, None, None, None

    def add(self, turn, initial: str, fault: str | None) -> None:
        if self.roles:
            self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
        else:
            self.initials[0] = initial
            self.first_turn = turn
        self.initials[1] = initial
        if turn is not None:
            self.turns += not self.turns or turn != self.turn
            self.least = turn if self.least is None else self.least
        self.turn = turn
        if fault:
            self.counts[fault] += 1
        self.roles.append(STATE_OF.get(initial, 0))
        self.faults.append({None: SOUND, "truncated": TRUNCATED}.get(fault, DOOMED))

    def rows(self) -> Iterator[tuple]:
        roles, faults = bytes(self.roles), bytes(self.faults)
        facts = (*self.counts.values(), self.illegal, *self.initials, self.turns, self.first_turn, self.turn, self.least)
        if not self.open:
            cost, audit = whole(roles, faults)
            yield (self.conv_id, self.id, START, -1, cost, 0, audit, *facts, False)
            return
        for entry in range(4):
            found = {to: search(roles, faults, entry, {to: 0}) for to in range(4)}
            found = {to: f for to, f in found.items() if f is not None}
            ranks = {audit: n for n, audit in enumerate(sorted(audit for _, audit in found.values()))}
            for to, (cost, audit) in found.items():
                yield (self.conv_id, self.id, entry, to, cost, ranks[audit], audit, *facts, True)


def searched_runs(facts: DataFrame) -> DataFrame:
    """The searched runs: one row for a whole conversation, up to 16 (entry and exit states) at a segment's edge."""
    key = facts.schema["conv_id"].dataType.simpleString()
    schema = RUN_SCHEMA.format(key=key)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out = None, []
        for batch in batches:
            for segment, row, conv_id, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or segment != run.segment or conv_id != run.conv_id:
                    if run is not None:
                        run.open = run.open or segment != run.segment
                        out.extend(run.rows())
                    run = _Run(conv_id, row, segment, run is None or segment != run.segment)
                run.add(turn, initial, fault)
                if len(out) >= 1000:
                    yield _batch(out, kinds)
                    out = []
        if run is not None:
            run.open = True
            out.extend(run.rows())
        if out:
            yield _batch(out, kinds)

    return written(facts.repartition("segment").sortWithinPartitions("segment", "id").mapInArrow(lean(search_all), schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def chosen_states(runs: DataFrame) -> DataFrame:
    """``id, entry, exit, tail`` of the runs of conversations that meet a segment's edge, by the least total cost and,
    among equal costs, the least audit. Segments are few and their tables small: costs and ranks, no audits."""

    def choose(table: pa.Table) -> pa.Table:
        steps: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for row, entry, to, cost, rank in zip(*(table.column(n).to_pylist() for n in ("id", "entry", "exit", "cost", "rank"))):
            steps.setdefault(row, {})[entry, to] = cost, rank
        ids = sorted(steps)
        rest, ways = dict(ENDS), []
        for row in reversed(ids):
            best: dict[int, tuple[int, int, int]] = {}
            for (entry, to), (cost, rank) in steps[row].items():
                if to in rest:
                    best[entry] = min(best.get(entry, (NEVER, 0, 0)), (cost + rest[to], rank, to))
            ways.append({entry: to for entry, (_, _, to) in best.items()})
            rest = {entry: cost for entry, (cost, _, _) in best.items()}
        state, chosen = START, []
        for row, way in zip(ids, reversed(ways)):
            chosen.append((row, state, way[state], ""))
            state = way[state]
        chosen[-1] = (*chosen[-1][:3], TAILS[state])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*chosen), (pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                        names=["id", "entry", "exit", "tail"])

    return runs.filter("open").select("conv_id", "id", "entry", "exit", "cost", "rank").groupBy("conv_id").applyInArrow(
        choose, "id bigint, entry int, exit int, tail string")


class _Conversation:
    """What is known of a conversation while its edits and rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.edits, self.at = conv_id, [], "", 0
        self.state, self.sha, self.started = START, hashlib.sha256(), False
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial, self.turn, self.least, self.most, self.turns = None, None, None, None, 0

    def take(self, run: dict) -> None:
        self.drain()
        self.audit.append(run["audit"])
        self.edits, self.at = run["audit"], 0
        for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
            setattr(self, name, getattr(self, name) + run[name])
        if self.initial is not None:
            self.illegal += self.initial + run["first_initial"] not in ("su", "ua", "au")
            self.turns -= self.turn is not None and self.turn == run["first_turn"]
        self.initial, self.turn = run["last_initial"], run["last_turn"]
        if self.least is None:
            self.least = run["least_turn"]
        self.most = run["last_turn"] if run["last_turn"] is not None else self.most

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
        self.started = True

    def insert(self) -> None:
        self.state = FOLLOWING[self.state]
        self.put(ROLE_OF[self.state], "")
        self.at += 1

    def pass_row(self, role: str, text: str) -> None:
        while self.edits[self.at] == "I":
            self.insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = STATE_OF[role[0]]
            self.put(role, text)
        elif edit == "R":
            self.state = FOLLOWING[self.state]
            self.put(ROLE_OF[self.state], text)

    def drain(self) -> None:
        while self.at < len(self.edits):
            self.insert()

    def row(self) -> tuple:
        self.drain()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.sha.hexdigest())


RESULT = ("conv_id {key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
FACTS = ["audit", "cost", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns", "first_turn",
         "last_turn", "least_turn"]


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, copies``): faults, cost, audit, digest."""
    ordered = ordered_rows(rows, segment_rows)
    runs = searched_runs(row_facts(ordered))
    ends = runs.filter("open").join(chosen_states(runs), ["id", "entry", "exit"]).withColumn(
        "audit", F.concat("audit", "tail")).withColumn("cost", F.col("cost") + INSERT_COST * F.length("tail"))
    edits = runs.filter("not open").unionByName(ends.drop("tail")).select("conv_id", "id", F.lit(1).alias("kind"), *FACTS)
    named = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("bigint").alias("id"), F.lit(0).alias("kind"))
    texts = ordered.select("conv_id", "id", F.lit(2).alias("kind"), "role", "text")
    stream = named.unionByName(edits, True).unionByName(texts, True)
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = RESULT.format(key=key)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = stream.columns

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(row["conv_id"])
                if row["kind"] == 1:
                    now.take(row)
                elif row["kind"] == 2:
                    now.pass_row(row["role"], row["text"])
            if out:
                yield _batch(out, kinds)
                out = []
        if now is not None:
            yield _batch([now.row()], kinds)

    return stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "id", "kind").mapInArrow(
        lean(follow), schema)
