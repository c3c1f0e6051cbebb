"""Conversation repair: rows, edits and a role grammar as weighted automata, composed row by row; the cheapest path is the repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, saved, slices
from factorloom.llm.merkle import field

#: The acceptor of ``(s?(ua)+)?`` over role initials: from each state the next by initial.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def inserted(state: int) -> Iterator[tuple[str, int]]:
    """What insertions alone lead to from a grammar state: the initials put in and the state; no state twice."""
    made, met = "", {state}
    yield made, state
    while True:
        step = next(((c, to) for c, to in GRAMMAR[state].items() if c in ROLES and to not in met), None)
        if step is None:
            return
        made, state = made + step[0], step[1]
        met.add(state)
        yield made, state


INSERTED = [list(inserted(g)) for g in range(len(GRAMMAR))]


def edits(initial: str, fault: str | None) -> list[tuple[str, int, str | None]]:
    """The transducer's arcs over one row: label, cost and the initial that comes out (None: nothing; a re-role gives u or a)."""
    out: list[tuple[str, int, str | None]] = [("D", DELETE, None)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        out += [("K", KEEP + more, initial), *[("R", REROLE + more, c) for c in ROLES]]
    return out


class Composition:
    """The composed automaton over the rows read so far, forwards: for each grammar state the least (cost, label string) path into it.

    States are (row, grammar state), so rows are a topological order and only the last column is kept, with one
    byte a state and row to trace labels back.  Of label strings only their order counts: any two of a column end with the
    edit of the same row, so neither is the beginning of the other, and what follows can't change their order.
    The output tape is hashed as it is written, for each state its own.
    """

    def __init__(self):
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.tape = [(hashlib.sha256(), False), None, None, None]
        self.back = bytearray()

    def read(self, initial: str, fault: str | None, role: str, text: str) -> None:
        best: list[tuple | None] = [None] * 4
        arcs = edits(initial, fault)
        for g in range(4):
            if self.cost[g] is None:
                continue
            for made, h in INSERTED[g]:
                for label, cost, out in arcs:
                    to = h if out is None else GRAMMAR[h].get(out)
                    if to is None:
                        continue
                    path = (self.cost[g] + INSERT * len(made) + cost, self.rank[g], "I" * len(made) + label, g, made, out)
                    if best[to] is None or path[:3] < best[to][:3]:
                        best[to] = path
        order = {p[1:3]: i for i, p in enumerate(sorted((p for p in best if p), key=lambda p: p[1:3]))}
        tape = []
        for to in range(4):
            p = best[to]
            if p is None:
                tape.append(None)
                self.back.append(255)
                continue
            _, _, labels, g, made, out = p
            name = None if out is None else f"{role if labels[-1] == 'K' else ROLES[out]}:{text}"
            tape.append(self.written(g, made, name))
            self.back.append(g << 4 | len(made) << 2 | "DKR".index(labels[-1]))
        self.cost = [p and p[0] for p in best]
        self.rank = [p and order[p[1:3]] for p in best]
        self.tape = tape

    def written(self, g: int, made: str, row: str | None):
        """The tape of a state with inserted rows and a row after it; tapes that gain nothing are shared."""
        tape, some = self.tape[g]
        more = [f"{ROLES[c]}:" for c in made] + ([] if row is None else [row])
        if not more:
            return tape, some
        tape = tape.copy()
        tape.update((("\n" if some else "") + "\n".join(more)).encode("utf-8", "surrogatepass"))
        return tape, True

    def end(self) -> tuple[int, str, str]:
        """Cost, labels and the digest of the tape of the least path into a final state."""
        ends = [(self.cost[g] + INSERT * len(made), self.rank[g], "I" * len(made), g, made) for g in range(4) if self.cost[g] is not None for made, h in INSERTED[g] if h in FINAL]
        cost, _, last, g, made = min(ends)
        digest, labels = self.written(g, made, None)[0].hexdigest(), [last]
        for i in range(len(self.back) - 4, -1, -4):
            code = self.back[i + g]
            labels.append("I" * (code >> 2 & 3) + "DKR"[code & 3])
            g = code >> 4
        return cost, "".join(reversed(labels)), digest


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text, gone)``: the rows as the query damages them, by the CRC-32 of ``conv:turn``; nulls are one space.

    Of a row that is dropped only ``(conv, gone)`` stays, so that its conversation is reported.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    out = rows.select(conv.alias("conv"), turn.cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    keep = F.col("kind") != 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = out.select("conv", *[F.when(keep, c).alias(n) for c, n in ((F.col("turn"), "turn"), (role, "role"), (text, "text"))], (~keep).alias("gone"), F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return out.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``damaged`` rows with ``fault`` (blank, duplicate, truncated or null), and ``first``: whether rows alike at the same turn may hold the first of their kind.

    A duplicate has the role and text of a row at an earlier turn; rows alike at one turn stand next to each other and are told
    apart when they are read.  First turns are aggregated by a digest, and those of very frequent rows joined by a bounded broadcast.
    """
    twin = F.when(~F.col("gone"), F.md5(F.concat(field(F.col("conv")), field(F.col("role")), field(F.col("text")))))
    rows = rows.withColumn("twin", twin)
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    firsts = saved(rows.where("twin is not null").groupBy("twin").agg(F.min(turn).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-turns")
    often = F.col("n") * 2000 > F.lit(firsts.agg(F.sum("n")).first()[0] or 0)  # true of fewer than 2000 digests
    rows = rows.join(F.broadcast(firsts.where(often).select("twin", F.col("least").alias("known"))), "twin", "left")
    other = F.when(F.col("known").isNull() & F.col("twin").isNotNull(), F.col("twin")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))  # joins nothing, and is dealt out
    rows = rows.withColumn("other", other).join(firsts.where(~often).select(F.col("twin").alias("other"), "least"), "other", "left")
    least = F.coalesce("known", "least")
    blank = ~F.col("text").rlike(WORD)
    fault = F.when(blank, "blank").when(least != turn, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.select("conv", "turn", "role", "text", "gone", F.when(~F.col("gone"), fault).alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of a conversation one after another in one task: rows that are gone first, then by turn, nulls first; rows of one turn by role and text."""
    return rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("gone"), F.asc_nulls_first("turn"), "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation of ``damaged`` rows.

    A fault counts once a row, the first of blank, duplicate (role and text stand earlier) and truncated (no stop at the end).  The cheapest edits, of
    equal cost those whose initials come first in ASCII, leave rows whose role initials are ``(s?(ua)+)?``.

    A task streams conversations row by row and holds of each a few numbers, four hashes and four bytes a row, never its texts; the digest of
    a whole conversation can only be taken in order.  A conversation without rows has zeros, no audit and the digest of nothing.  A null
    conversation is one of its own; nulls elsewhere are one space; turns may repeat; other columns are ignored; an empty table gives no rows.
    """
    ordered = in_order(with_faults(rows))
    kind = dict(rows.dtypes)["conv"]

    def walk(batches):
        def told(done):
            columns = list(zip(*done, strict=True))
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", *COUNTS, "audit", "repaired_sha256"])

        def close(c):
            cost, audit, digest = c["path"].end()
            gaps = c["high"] - c["low"] + 1 - c["distinct"] if c["distinct"] else 0
            return (c["conv"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, digest)

        now = conv_type = None
        for whole in batches:
            conv_type = whole.schema.field("conv").type
            done = []
            for batch in slices(whole, "text", 4 << 20):
                for r in batch.to_pylist():
                    if now is None or now["conv"] != r["conv"]:
                        if now is not None:
                            done.append(close(now))
                        now = {"conv": r["conv"], "low": None, "high": None, "distinct": 0, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "path": Composition()}
                    if r["gone"]:
                        continue
                    role, text, turn = r["role"], r["text"], r["turn"]
                    if turn is not None and turn != now["high"]:
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["high"], now["distinct"] = turn, now["distinct"] + 1
                    fault, last = r["fault"], now["last"]
                    if fault != "blank" and last == (turn, role, text):
                        fault = "duplicate"
                    if fault:
                        now[fault] += 1
                    if last and last[1][:1] + role[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["last"] = (turn, role, text)
                    now["path"].read(role[:1], fault, role, text)
            if done:
                yield told(done)
        if now is not None:
            yield told([close(now)])

    return ordered.mapInArrow(walk, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, place, role, text)``: the rows that the audits in ``found`` leave of ``damaged`` rows, streamed in order, ``place`` from 0."""
    kind = dict(rows.dtypes)["conv"]
    heads = found.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("gone"), F.lit(True).alias("head"))
    ordered = in_order(rows.where("not gone").withColumn("head", F.lit(False)).unionByName(heads))

    def apply(batches):
        audit, at, state, place, conv = "", 0, 0, 0, None
        names = ["conv", "place", "role", "text"]
        for whole in batches:
            types = [whole.schema.field("conv").type, pa.int64(), pa.string(), pa.string()]
            for batch in slices(whole, "text", 4 << 20):
                out = []

                def put(role, text):
                    nonlocal state, place
                    state = GRAMMAR[state][role[0]]
                    out.append((conv, place, role, text))  # noqa: B023
                    place += 1

                def fill():
                    nonlocal at
                    while audit[at : at + 1] == "I":  # an inserted row has the only role, of the two, that may follow
                        put(next(ROLES[c] for c in GRAMMAR[state] if c in ROLES), "")  # noqa: B023
                        at += 1

                for r in batch.to_pylist():
                    if r["head"]:
                        audit, at, state, place, conv = r["text"], 0, 0, 0, r["conv"]
                        fill()
                        continue
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        put(r["role"] if edit == "K" else next(ROLES[c] for c in GRAMMAR[state] if c in ROLES), r["text"])
                    fill()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return ordered.mapInArrow(apply, f"conv {kind}, place long, role string, text string")
