from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from winnow.llm import repair

SPACE = " \t\n\x0b\f\r"


def cheapest(roles, faults):
    """Uniform-cost walk over (cost, audit): another method than the search."""
    heap, seen = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(roles) and state in "0a":
            return cost, audit
        turned = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", at, turned))
        if at == len(roles):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
        if faults[at] not in ("blank", "duplicate"):
            more = faults[at] == "truncated"
            heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, turned))
            if (roles[at], state) in {("s", "0"), ("u", "0"), ("u", "s"), ("u", "a"), ("a", "u")}:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles[at]))


def brute(rows):
    """Results of damage and repair by plain Python."""
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        turns = {r[0] for r in mine} - {None}
        cost, audit = cheapest(initials, faults)
        lines, at, state = [], 0, "0"
        for edit in audit:
            turned = "a" if state == "u" else "u"
            named = {"a": "assistant", "u": "user"}[turned]
            if edit == "K":
                lines.append(f"{mine[at][1]}:{mine[at][2]}")
                state = initials[at]
            elif edit in "RI":
                lines.append(f"{named}:{mine[at][2] if edit == 'R' else ''}")
                state = turned
            at += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, conversations, rows):
    r = random.Random(seed)
    texts = ["Hello there.", "no end", "Fine!", " \t", "", None, "What?  \n", "ünï.", "a. b", "x" * 3000 + "."]
    out = []
    for conv in range(conversations):
        for turn in range(r.randint(1, rows)):
            out.append((conv, r.choice([turn, turn, turn * 3, 1, None]), r.choice(["user", "assistant", "system", None, "", "tool", "ugly"]),
                        r.choice(texts) if r.random() < 0.6 else f"text {r.random()}."))
    return out + [(None, t, "user", "Hi.") for t in range(5)] + [(77_000, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string, id int, kind string, segment int, audit int"


def table(llm, rows, parts=5):
    return llm.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("segment_rows", [100_000, 7])
def test_odd_conversations_equal_brute_force(llm, segment_rows):
    rows = made(1, 40, 12)
    got = repair.repair(repair.damage(table(llm, rows)), segment_rows)
    assert rows_of(got) == brute(rows)


def test_one_conversation_over_many_segments(llm):
    rows = made(2, 3, 6) + [(9, t, r, x) for _, t, r, x in made(3, 30, 14)] + [(9, 5, "user", "same.")] * 60
    got = repair.repair(repair.damage(table(llm, rows)), 20)
    assert rows_of(got) == brute(rows)
    ordered = repair.ordered_rows(repair.damage(table(llm, rows)), 20)
    assert ordered.filter("conv_id = 9").selectExpr("shiftright(id, 33) s").distinct().count() > 5


def test_whole_tables_and_none(llm):
    docs = llm.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()]
    assert rows_of(repair.repair(repair.damage(docs))) == brute(rows)
    assert repair.repair(repair.damage(docs.limit(0))).collect() == []


def test_conversation_whose_rows_are_all_dropped(llm):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair(repair.damage(table(llm, [(conv, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def coded(roles, faults):
    return bytes(repair.STATE_OF.get(r, 0) for r in roles), bytes({None: 0, "truncated": 1, "blank": 2}[f] for f in faults)


@pytest.mark.parametrize("seed", range(3))
def test_search_proves_the_optimum(seed):
    r = random.Random(seed)
    for _ in range(400):
        n = r.randint(1, 9)
        roles, faults = r.choices("suax", k=n), r.choices([None, None, None, "truncated", "blank"], k=n)
        assert repair.whole(*coded(roles, faults)) == cheapest(roles, faults)
        if n < 7:  # the weak bound proves the same, only later
            assert repair.whole(*coded(roles, faults), repair.forced_bounds) == cheapest(roles, faults)


@pytest.mark.parametrize("letters", ["sua", "u", "s", "x"])
def test_long_conversations_take_a_few_visits_per_row(letters):
    import time

    r, n = random.Random(0), 20_000
    roles, faults = r.choices(letters, k=n), r.choices([None, None, "truncated", "blank"], k=n)
    started = time.perf_counter()
    cost, audit = repair.whole(*coded(roles, faults))
    assert time.perf_counter() - started < 20 and len(audit.replace("I", "")) == n


def test_audits_compare_as_texts():
    r = random.Random(4)
    links = [repair._Audit(None, "")]
    for _ in range(300):
        parent = r.choice(links)
        letter = r.choice("DIKR")
        if not any(x.before is parent and x.letter == letter for x in links):
            links.append(repair._Audit(parent, letter))
    for _ in range(3000):
        a, b = r.choice(links), r.choice(links)
        assert a.earlier(b) == (a.text() < b.text())
