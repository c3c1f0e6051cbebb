"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from string import punctuation

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import i64, rolling, saved, slices, with_only

#: Units whose name is a slot of its own; fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs day days week weeks month months year years usd eur gbp dollars euros cents percent mph kmh kph w kw kwh v a hz khz mhz ghz b kb mb gb tb".split())
#: A number with a sign, separators, a fraction, an exponent; money and percent signs belong to it.
NUMBER = re.compile(r"[$€£]?[-+]?\d[\d,._:/]*(?:[eE][-+]?\d+)?%?")
NUMBER_UNIT = re.compile(r"([$€£]?[-+]?\d[\d,._]*)([A-Za-z]{1,5})")
EDGE = re.compile(r"^\W+|\W+$")
SENTENCE_END = frozenset(".?!:\n")
NAME, NUM, UNIT = (xxhash.xxh3_64_intdigest(w) for w in (b"<name>", b"<num>", b"<unit>"))
PARTS = re.compile(r"\n|[^\s]+")


class Canon:
    """Words to (template word, slot value).  A slot is a number, a unit or a name; a name is a capitalised word inside a sentence, in typed templates anywhere."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[tuple[str, bool], list[tuple[str, str | None]]] = {}
        self.most = most

    def word(self, raw: str, starts: bool) -> list[tuple[str, str | None]]:
        got = self.seen.get((raw, starts))
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            got = self.seen[raw, starts] = self.fresh(raw, starts)
        return got

    @staticmethod
    def fresh(raw: str, starts: bool) -> list[tuple[str, str | None]]:
        bare = raw.strip(punctuation)
        if not bare.isalpha():
            bare = EDGE.sub("", raw)
            signed = raw.strip(".,;:!?()[]{}\"'")
            if not bare:
                return []
            if NUMBER.fullmatch(signed) or NUMBER.fullmatch(bare):
                return [("<num>", bare)]
            if (m := NUMBER_UNIT.fullmatch(bare)) and m[2].lower() in UNITS:
                return [("<num>", m[1]), ("<unit>", m[2].lower())]
        low = bare.lower()
        if low in UNITS and len(low) > 1:
            return [("<unit>", low)]
        if not starts and bare[0].isupper() and bare[1:].islower():
            return [("<name>", low)]
        return [(low, None)]

    def template(self, text: str | None, typed: bool = False) -> tuple[list[str], list[str | None]]:
        """``typed``: capitalised words that start a sentence or line are names too."""
        words, values, starts = [], [], True
        for m in PARTS.finditer(text or ""):
            raw = m[0]
            if raw == "\n":
                starts = True
                continue
            for w, v in self.word(raw, starts and not typed):
                words.append(w)
                values.append(v)
            starts = raw[-1] in SENTENCE_END
        return words, values


class TemplateHashes(dict):
    """Numbers by raw word, and by number the hashes of its template words; starts anew at ``most`` words."""

    LINE = "\ue000"  # stands for a line's end between the words

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.first = np.zeros((1024, 2), np.uint64)  # inside a sentence, at its start
        self.second = np.zeros(1024, np.uint64)
        self.size = np.zeros(1024, np.int8)
        self.ends = np.zeros(1024, bool)

    def __missing__(self, raw: str) -> int:
        i = self[raw] = len(self)
        if i == len(self.size):
            self.first, self.second, self.size, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.second, self.size, self.ends))
        if raw == self.LINE:
            self.ends[i] = True
            return i
        core = raw.rstrip(".,;:!?")
        if core != raw:
            self.ends[i] = raw[-1] in SENTENCE_END
        if core.isalpha() and core not in UNITS:
            if core.islower():  # the same wherever it stands: most words
                self.size[i], self.first[i] = 1, xxhash.xxh3_64_intdigest(core.encode())
                return i
            if (low := core.lower()) not in UNITS and core[0].isupper() and core[1:].islower():
                self.size[i], self.first[i] = 1, (NAME, xxhash.xxh3_64_intdigest(low.encode()))
                return i
        for starts in (0, 1):
            found = Canon.fresh(raw, bool(starts))
            self.size[i] = len(found)
            for place, (w, _) in enumerate(found):
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                if place:
                    self.second[i] = h
                else:
                    self.first[i, starts] = h
        return i

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's template words, as ``Canon.template`` finds them."""
        return self.both(text)[0]

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of ``of`` and those of the typed template, of as many words."""
        if not text:
            return (np.empty(0, np.uint64),) * 2
        if len(self) > self.most:
            self.reset()
        parts = text.replace("\n", f" {self.LINE} ").split()
        at = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if not len(at):
            return (np.empty(0, np.uint64),) * 2
        starts = np.append(True, self.ends[at[:-1]])
        h, typed, size = self.first[at, starts.astype(np.int64)], self.first[at, 0], self.size[at]
        if (size != 1).any():
            two = np.cumsum(size)[size == 2] - 1
            h, typed = np.repeat(h, size), np.repeat(typed, size)
            h[two] = typed[two] = self.second[at[size == 2]]
        return h, typed


def grouped(h: np.ndarray) -> np.ndarray:
    """The places of template words less those that follow a slot of their own type."""
    slot = (h == NAME) | (h == NUM) | (h == UNIT)
    return np.flatnonzero(np.append(True, ~(slot[1:] & (h[1:] == h[:-1]))))[: len(h)]


def telling(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of template hashes at these places has two different plain words at least."""
    lanes = h[at[:, None] + np.arange(size)]
    slot = (lanes == NAME) | (lanes == NUM) | (lanes == UNIT)
    return np.where(slot, ~np.uint64(0), lanes).min(1, initial=~np.uint64(0)) < np.where(slot, np.uint64(0), lanes).max(1, initial=0)


def at_ends(hashes: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Which windows are among the first or last ``most`` of a run of equal ones at neighbouring places."""
    if not len(at):
        return np.empty(0, bool)
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1] + 1)))
    size = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, size)
    return (inside < most) | (np.repeat(size, size) - inside <= most)


def template_windows(table: DataFrame, width: int, id_col: str, text_col: str, *, short: bool = False, lengths: Sequence[int] = (), only: np.ndarray | None = None, longest: int | None = None) -> DataFrame:
    """``(id, row, mode, at, n, size, whole, template, hash, slots)``: every window of ``width`` template words; ``n`` windows in the text.

    A window of ``width`` words is compared by its ``template`` if that has two different plain words at least; else by template and values, so that rows of
    numbers are copies only where the numbers are the same.  Of a run of neighbouring windows that are all alike the first and last
    ``longest`` are enough to find an item of so many windows.

    ``mode`` is 0 for the template whose sentences start with plain words, 1 for the typed one, 2 for the typed one with
    neighbouring slots of a type as one.  ``row`` tells texts of one id apart.
    ``slots`` lists the values of the window's ``size`` words; of slots made one, that of the first decides (``value``) and ``all`` holds each.
    With ``short`` a text of fewer words is one window; windows of the ``lengths``, all smaller than ``width``, are cut from any text.
    ``whole``: the window is the text.  ``only``: sorted hashes to keep, of templates and with values.
    """
    kind = dict(table.dtypes)[id_col]

    def cut(batches):
        canon, hashes = Canon(), TemplateHashes()
        mask = np.uint64((1 << 22) - 1)
        if only is not None:
            likely = np.zeros(1 << 22, bool)
            likely[only & mask] = True

        def known(w: np.ndarray) -> np.ndarray:
            """The places of hashes that are in ``only``: most others are told apart by their last bits."""
            if only is None:
                return np.arange(len(w))
            at = np.flatnonzero(likely[w & mask])
            return at[only[np.minimum(np.searchsorted(only, w[at]), len(only) - 1)] == w[at]]

        for whole in batches:
            for batch in slices(whole, text_col, 4 << 20):
                ids = batch.column(id_col)
                row, key, modes, at, total, sizes, full, plain_hashes, out, slots = [], [], [], [], [], [], [], [], [], []
                for i, text in enumerate(batch.column(text_col).to_pylist()):
                    plain, typed = hashes.both(text)
                    group = grouped(typed)
                    for mode, h in enumerate((plain, typed, typed[group])):
                        if mode < 2 or len(group) < len(typed):  # else all windows are those of mode 1
                            full_windows = rolling(h, width)
                            full_kept = known(full_windows)
                        cuts = [(width, full_windows)]
                        if mode < 2:
                            own = {len(h)} if short and 0 < len(h) < width else set()
                            cuts += [(k, rolling(h, k) ^ np.uint64(k)) for k in sorted({*lengths, *own}) if k <= len(h)]
                        values = None
                        for size, w in cuts:
                            keep = full_kept if size == width else known(w)
                            if not len(keep):
                                continue
                            if values is None:
                                found = canon.template(text, mode > 0)[1]
                                values = [(v, v) for v in found]
                                if mode == 2:
                                    ends = [*group[1:].tolist(), len(found)]
                                    values = [(found[p], found[p] and " ".join(found[p:q])) for p, q in zip(group.tolist(), ends, strict=True)]
                            final = w[keep]
                            if size == width:
                                for j in np.flatnonzero(~telling(h, keep, size)).tolist():
                                    place = int(keep[j])
                                    final[j] = xxhash.xxh3_64_intdigest("\0".join(values[place + o][1] or "" for o in range(size)).encode("utf-8", "surrogatepass"), int(final[j]))
                                stay = np.ones(len(keep), bool)
                                if only is not None:
                                    stay = only[np.minimum(np.searchsorted(only, final), len(only) - 1)] == final
                                if longest is not None:
                                    stay &= at_ends(final, keep, longest)
                                keep, final = keep[stay], final[stay]
                            digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                            for j in keep.tolist():
                                row.append(i)
                                key.append(digest)
                                modes.append(mode)
                                at.append(j)
                                total.append(len(w))
                                sizes.append(size)
                                full.append(size == len(h))
                                slots.append([{"place": j + o, "value": values[j + o][0], "all": values[j + o][1]} for o in range(size) if values[j + o][0] is not None])
                            plain_hashes.append(w[keep])
                            out.append(final)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(key, pa.int64()), *[pa.array(x, pa.int32()) for x in (modes, at, total, sizes)], pa.array(full, pa.bool_()), *[i64(np.concatenate(x) if x else np.empty(0, np.uint64)) for x in (plain_hashes, out)], pa.array(slots, pa.list_(pa.struct([("place", pa.int32()), ("value", pa.string()), ("all", pa.string())])))],
                    names=["id", "row", "mode", "at", "n", "size", "whole", "template", "hash", "slots"],
                )

    return with_only(table, id_col, text_col).mapInArrow(cut, f"id {kind}, row long, mode int, at int, n int, size int, whole boolean, template long, hash long, slots array<struct<place:int,value:string,all:string>>")


def chains(hits: list[tuple[int, int]], n: int, least: float, drift: int) -> list[list[int]]:
    """Lists of places in ``hits`` that may be one copy each: ``(at in the item, at in the document)`` in order, on diagonals near each other.

    Those of every single diagonal, and the longest chains of runs where a diagonal differs from the one before by ``drift`` at most.
    Only those that cover ``least`` of the item's ``n`` windows.
    """
    lanes: dict[int, list[int]] = {}
    for i in sorted(range(len(hits)), key=hits.__getitem__):
        lanes.setdefault(hits[i][1] - hits[i][0], []).append(i)
    found = [at for at in lanes.values() if len(at) >= least * n]
    if len(lanes) == 1 or len({b for b, _ in hits}) < least * n:
        return found
    # by run of neighbouring windows of a lane: the best chain that ends in it, from the ends (item, document) of earlier runs
    runs = []
    for lane, at in lanes.items():
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or hits[at[k]][0] != hits[at[k - 1]][0] + 1:
                runs.append((lane, at[start:k]))
                start = k
    runs.sort(key=lambda r: (hits[r[1][0]], r[0]))
    ends: dict[int, list[tuple[int, int, int]]] = {}  # by lane: (end in the item, most hits so far, run), rising in both
    before, held, last = [-1] * len(runs), [0] * len(runs), [0] * len(runs)
    for j, (lane, at) in enumerate(runs):
        (b, d), best, prev = hits[at[0]], 0, -1
        for near in range(lane - drift, lane + drift + 1):
            e = ends.get(near)
            if e:
                # the last earlier run of that lane that ends before this one in item and document
                k = bisect_left(e, (min(b, d - near), 0, 0)) - 1
                if k >= 0 and e[k][1] > best:
                    best, prev = e[k][1], e[k][2]
        before[j], held[j] = prev, best + len(at)
        mine = ends.setdefault(lane, [])
        if mine and mine[-1][1] > held[j]:
            mine.append((hits[at[-1]][0], mine[-1][1], mine[-1][2]))
        else:
            mine.append((hits[at[-1]][0], held[j], j))
    inner = {p for p in before if p >= 0}
    for j in range(len(runs)):
        if j not in inner and before[j] >= 0 and held[j] >= least * n:
            out, k = [], j
            while k >= 0:
                out = runs[k][1] + out
                k = before[k]
            found.append(out)
    return found


def copies(pairs: DataFrame, width: int, least: float, drift: int) -> DataFrame:
    """``(id, item, coverage, exact, n_slots)`` of the chains with slots that agree; one row for each pair of texts and mode at most."""
    kinds = dict(pairs.dtypes)
    hits = pairs.groupBy("id", "row", "item", "item_row", "mode", "size").agg(
        F.first("n").alias("n"), F.max("whole").alias("whole"), F.collect_list(F.struct("at", "doc_at", "slots", "doc_slots")).alias("hits")
    )

    def judge(batches):
        for batch in batches:
            keep, cover, exact, count = [], [], [], []
            for i, r in enumerate(batch.select(["size", "n", "whole", "hits"]).to_pylist()):
                rows, best = r["hits"], None
                for at in chains([(x["at"], x["doc_at"]) for x in rows], r["n"], least, drift):
                    slots = {(a["place"], a["value"], b["value"], a["all"] == b["all"]) for k in at for a, b in zip(rows[k]["slots"], rows[k]["doc_slots"], strict=False)}
                    pair = {(a, b) for _, a, b, _ in slots}
                    if len({a for a, _ in pair}) < len(pair) or len({b for _, b in pair}) < len(pair):
                        continue
                    same = all(x[3] and x[1] == x[2] for x in slots)
                    plain = r["size"] - len(rows[at[0]]["slots"])
                    if r["size"] < width and not r["whole"] and not same and 2 * plain < width:
                        continue
                    one = (len({rows[k]["at"] for k in at}) / r["n"], same, len({x[:3] for x in slots}))
                    best = one if best is None else max(best, one)
                if best:
                    keep.append(i)
                    cover.append(best[0])
                    exact.append(best[1])
                    count.append(best[2])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("item").take(at), pa.array(cover, pa.float64()), pa.array(exact, pa.bool_()), pa.array(count, pa.int64())], names=["id", "item", "coverage", "exact", "n_slots"])

    return hits.mapInArrow(judge, f"id {kinds['id']}, item {kinds['item']}, coverage double, exact boolean, n_slots long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 8,
    least: float = 0.5,
    drift: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    prefilter_windows: int = 1_000_000,
) -> DataFrame:
    """``(id, item_id, coverage, exact, n_slots)``: documents that hold a benchmark item, as it is or re-parameterised.

    Windows of ``width`` template words are hash-joined, once with sentences' first words as they are,
    once with those that are capitalised as names, and once more with neighbouring slots of a type as one ("Mary Smith" and "Alice"):
    any of these may find a copy.  Windows of a document and an item that
    lie on one diagonal (same distance between their places), or in order on diagonals that differ from one to
    the next by ``drift`` words at most, so that words may be put in or left out, are one copy; it counts if it covers ``least``
    of the item's windows and its slots agree: no slot value of the item stands
    for two values in the document, and none in the document for two of the item.  ``exact``: all values alike.
    The best copy is kept for each pair.

    Windows without two different plain words, as in tables of numbers, count only with the same values; a long run of one
    repeated window is looked at from its ends.

    The document side is filtered by the item windows' hashes in each task while there are at most
    ``prefilter_windows`` of them (16 MB), which is checked by a count; beyond that all windows are joined by a shuffle, with the same result.
    Long texts are cut into windows a text at a time.  Null or empty texts hold nothing; null ids stay null but never match an item that is null;
    repeated rows are one document; items of fewer words than ``width`` are one window of their own length, found inside any
    document: with other values only if half of ``width`` are plain words or it is the whole document, since "12 km" stands
    everywhere; empty tables give no rows.
    """
    items = template_windows(benchmark, width, item_col, item_text_col, short=True).where("id is not null")
    items = saved(items, "item-windows")
    prints = items.select(F.explode(F.array("template", "hash")).alias("hash")).distinct()
    count = prints.limit(prefilter_windows + 1).count()
    only = None
    if count <= prefilter_windows:
        only = np.sort(np.array([r[0] for r in prints.collect()], np.int64).view(np.uint64))
        if not len(only):
            only = np.array([0], np.uint64)
    lengths = [r[0] for r in items.where(F.col("size") < width).select("size").distinct().collect()]  # fewer than width
    longest = items.agg(F.max("n")).first()[0] or 0
    found = template_windows(docs, width, id_col, text_col, lengths=lengths, only=only, longest=longest)
    d, b = found.alias("d"), items.alias("b")
    pairs = d.join(b, (F.col("d.hash") == F.col("b.hash")) & (F.col("d.mode") == F.col("b.mode")) & (F.col("d.size") == F.col("b.size"))).select(
        "d.id", "d.row", F.col("b.id").alias("item"), F.col("b.row").alias("item_row"), "d.mode", "d.size", F.col("b.n").alias("n"), "d.whole",
        F.col("b.at").alias("at"), F.col("d.at").alias("doc_at"), F.col("b.slots").alias("slots"), F.col("d.slots").alias("doc_slots"),
    )
    best = copies(pairs.distinct(), width, least, drift).groupBy("id", "item").agg(F.max(F.struct("coverage", "exact", "n_slots")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.coverage", "best.exact", "best.n_slots")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are; those with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    found = contaminated(docs.where(F.col(f"`{id_col}`").isNotNull()), benchmark, **options).select(F.col(f"`{id_col}`").alias("_found")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"))  # so that names can't clash
    return rows.join(found, F.col("_id") == F.col("_found"), "left_anti").select("_doc.*")
