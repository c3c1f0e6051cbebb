"""Conversation repair against exhaustive search and against a dynamic programme over whole strings; damage, edges and the repaired rows."""

import hashlib
import random
import re
import zlib
from itertools import groupby, product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def exhaustive(rows):
    """The least (cost, audit, digest) over every way to edit a few rows of (role, text, fault)."""
    best = None
    for edits in product("DKua", repeat=len(rows)):
        if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(edits, rows, strict=True)):
            continue
        for gaps in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(gaps):
                for x in gap:
                    cost, audit = cost + 5, audit + "I"
                    out.append(NAMES[x] + ":")
                if i < len(rows):
                    (role, text, fault), e = rows[i], edits[i]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and fault == "truncated" else 0)
                    if e != "D":
                        out.append(f"{role if e == 'K' else NAMES[e]}:{text}")
            if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, sha(out))
    return best


def by_strings(rows):
    """The same by the least (cost, audit, output) for each prefix of rows and state of the grammar, with whole strings."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def put_in(column):
        for _ in range(2):
            for g, (cost, audit, out) in list(column.items()):
                for x, to in moves[g].items():
                    if x != "s":
                        new = (cost + 5, audit + "I", (*out, NAMES[x] + ":"))
                        column[to] = min(column.get(to, new), new)
        return column

    column = put_in({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for g, (cost, audit, out) in column.items():
            ways = [(g, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for x, to in moves[g].items():
                    if role[:1] == x:
                        ways.append((to, (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                    if x != "s":
                        ways.append((to, (cost + more + 1, audit + "R", (*out, f"{NAMES[x]}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        column = put_in(new)
    cost, audit, out = min(column[g] for g in (0, 3) if g in column)
    return cost, audit, sha(out), list(out)


def composed(rows):
    path = c.Composition()
    for role, text, fault in rows:
        path.read(role[:1], fault, role, text)
    return path.end()


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " ", "u2"]), st.sampled_from(["a.", "b"]), st.sampled_from([None, None, "truncated", "blank", "duplicate"]))


@settings(max_examples=40, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_the_cheapest_path_of_few_rows(rows):
    assert composed(rows) == exhaustive(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=24))
def test_the_cheapest_path_of_many_rows(rows):
    assert composed(rows) == by_strings(rows)[:3]


def brute(table):
    """All of the query in plain Python: (the rows by conversation, those repaired by conversation)."""
    convs, out, left = {}, [], {}
    for conv, turn, role, text in table:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faulty.append((role, text, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, digest, left[conv] = by_strings(faulty)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr), left


def found(table):
    return sorted(map(tuple, c.repaired(c.damaged(table)).collect()), key=repr)


def drawn(draw, convs, longest):
    rows = []
    for conv in range(convs):
        n = longest if conv == 3 else draw.randrange(1, 9)
        for turn in range(n):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + draw.randrange(2) * 3, role, draw.choice([f"Said {turn}.", "Again?", "no stop", " \n", "", f"é {turn}!\n ", "Yes.\n ", f"{turn}?"])))
    return rows


def test_repair_of_a_table_with_one_very_long_conversation(spark):
    """Repeated turns, duplicates far apart, and a conversation that holds half of all rows."""
    rows = drawn(random.Random(8), 120, 600)
    random.Random(9).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    want, left = brute(rows)
    assert found(docs) == want
    damaged = c.damaged(docs)
    kept = sorted(map(tuple, c.repaired_rows(damaged, c.repaired(damaged)).collect()))
    got = {conv: [f"{role}:{text}" for _, _, role, text in part] for conv, part in groupby(kept, key=lambda r: r[0])}
    assert got == {conv: lines for conv, lines in left.items() if lines}
    assert all([r[1] for r in part] == list(range(len(got[conv]))) for conv, part in ((k, list(g)) for k, g in groupby(kept, key=lambda r: r[0])))


def test_repair_of_nulls_repeats_clashing_names_long_texts_and_an_empty_table(spark):
    rows = [(None, None, None, None), (None, None, "user", "Null turn."), (5, None, "user", "Hi."), (5, None, "user", "Hi."), (5, 0, None, "Hi."), (5, 9, "assistant", None), (6, 1, "user", "x y. " * 40_000), (6, 2, "assistant", "z! " * 40_000)]
    rows += [(100 + i, i, "user", "Alone.") for i in range(40)]  # some lose their only row
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.select("*", *[F.lit("x").alias(n) for n in ("conv", "gone", "fault", "twin", "n", "kind", "audit", "head")])
    want = brute(rows)[0]
    assert found(docs) == found(more) == want
    assert any(r[1:8] == (0, 0, 0, 0, 0, 0, "") and r[8] == sha([]) for r in want)
    assert found(spark.createDataFrame([], SCHEMA)) == []
