"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import slices

#: First and last code points of the scripts told apart; fixed values of the Unicode blocks.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
NAMES = sorted({s[0] for s in SCRIPTS}) + ["other"]
_STARTS = np.array([s[1] for s in SCRIPTS])
LETTER = re.compile(r"[^\W\d_]")  # and some numbers
BITS = 14


def script(word: str) -> int:
    """Index into NAMES of a word's first letter; -1 if it has none."""
    letter = next((m[0] for m in LETTER.finditer(word) if m[0].isalpha()), None)  # superscripts, fractions and numerals in circles are none
    if letter is None:
        return -1
    c = ord(letter)
    k = int(np.searchsorted(_STARTS, c, side="right")) - 1
    return NAMES.index(SCRIPTS[k][0]) if k >= 0 and c <= SCRIPTS[k][2] else len(NAMES) - 1


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams of each word between boundary marks, one after another, and where each word's start."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    h = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
    at = np.arange(len(data) - 2)
    ends = np.cumsum(sizes)
    keep = np.ones(len(data) - 2, bool)  # not those across two words
    keep[(ends[:-1, None] + np.array([-2, -1])).ravel()] = False
    firsts = np.append(0, np.cumsum(sizes - 2)[:-1])
    return h[at[keep]].astype(np.int64), firsts


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages: whether a language is written in a script


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rare: float = 0.001) -> Model:
    """Trigram and script counts by language over all rows with a language.

    Each task sends one count for each language and bucket it has met, so what is shuffled and what
    the driver gets is bounded by languages x 2**14, not by the texts.
    """

    def count(batches):
        kinds: dict[str, np.ndarray] = {}
        waiting: dict[str, Counter] = {}

        def flush(lang):
            got = waiting.pop(lang)
            words = list(got)
            n = np.fromiter(got.values(), np.int64, len(words))
            buckets, firsts = grams([w.encode("utf-8", "surrogatepass") for w in words])
            total = kinds.setdefault(lang, np.zeros((1 << BITS) + len(NAMES) + 1, np.int64))
            total += np.bincount(buckets, np.repeat(n, np.diff(np.append(firsts, len(buckets)))), len(total)).astype(np.int64)
            scripts = np.fromiter(map(script, words), np.int64, len(words))
            total += np.bincount(np.where(scripts < 0, len(total) - 1, (1 << BITS) + scripts), n, len(total)).astype(np.int64)

        for whole in batches:
            for batch in slices(whole, text_col):
                for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist(), strict=True):
                    if text and lang is not None:
                        got = waiting.setdefault(lang, Counter())
                        got.update(w for w in text.lower().split())
                        if len(got) > 300_000:
                            flush(lang)
        for lang in list(waiting):
            if waiting[lang]:
                flush(lang)
        for lang, total in kinds.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).where(F.col(f"`{lang_col}`").isNotNull())
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros(((1 << BITS) + len(NAMES) + 1, len(langs)))
    table[counts["bucket"].to_numpy(int), [langs.index(x) for x in counts["lang"]]] = counts["n"].to_numpy(float)
    seen = table[: 1 << BITS] + 0.5
    scripts = table[1 << BITS : -1]
    return Model(langs, np.log(seen / seen.sum(0)).astype(np.float32) if langs else seen, scripts > rare * np.maximum(1, scripts.sum(0)))


class WordScores:
    """Scores of words by language; the table starts anew at ``most`` words."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)
        self.weight = np.zeros(1024, np.int32)

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.at)
        if not new:
            return
        if len(self.at) + len(new) > self.most and self.at:
            self.clear()
            new = sorted(words)
        start, n = len(self.at), len(self.at) + len(new)
        if n > len(self.table):
            more = max(n, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((more - len(self.table), self.table.shape[1]), np.float32)])
            self.weight = np.concatenate([self.weight, np.zeros(more - len(self.weight), np.int32)])
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            buckets, firsts = grams([w.encode("utf-8", "surrogatepass") for w in some])
            score = np.add.reduceat(self.model.logp[buckets], firsts, axis=0)
            kinds = np.fromiter(map(script, some), np.int64, len(some))
            fits = self.model.uses[np.maximum(kinds, 0)]
            fits[~fits.any(1)] = True  # a script that none is written in
            score = np.where(fits, score - score.max(1, keepdims=True), -1e4).astype(np.float32)
            score[kinds < 0] = 0  # no letter
            self.table[start + i : start + i + len(some)] = score
            self.weight[start + i : start + i + len(some)] = [len(w) if k >= 0 else 0 for w, k in zip(some, kinds, strict=True)]
        self.at.update(zip(new, range(start, n), strict=True))


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every item of many sequences, given one after another with the longest first.

    A change of label costs ``penalty``.  All sequences advance together, one item a step.
    """
    out = np.zeros(len(score), np.int16)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # how many are longer than t
    stay = np.zeros(score.shape, bool)
    came = np.zeros(len(score), np.int16)
    last = np.zeros(len(lengths), np.int16)
    v = score[starts[: active[0]]].copy() if steps else None
    for t in range(1, steps + 1):
        n = active[t] if t < steps else 0
        if n < len(v):
            last[n : len(v)] = v[n:].argmax(1)
            v = v[:n]
        if not n:
            break
        at = starts[:n] + t
        best = v.argmax(1)
        change = v[np.arange(n), best] - np.float32(penalty)
        stays = v >= change[:, None]
        stay[at], came[at] = stays, best
        v = np.where(stays, v, change[:, None]) + score[at]
        v -= v.max(1, keepdims=True)
    label = last
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        now = label[:n]
        out[at] = now
        label[:n] = np.where(stay[at, now], now, came[at]) if t else now
    return out


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """``(id, lang_pred, score)`` of every whole text, with ``spans`` also ``spans array<(start, end, lang)>`` in words.

    Words are runs without white space, lower-cased; each scores by the trigrams of each language that is written in the word's script, and
    Viterbi finds the best labels where a change costs ``penalty`` nats.  A document's language is that of most letters, ties to the
    first by name; the score is its share.  ``und`` with score 0 if the text is null, has no letter, or no language was learned.
    Null ids stay null, repeated rows are labelled each, other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    many = len(model.langs)

    def label(batches):
        scores = WordScores(model)
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                parts = [t.lower().split() if t and many and LETTER.search(t) else [] for t in texts]
                order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
                order = [i for i in order if parts[i]]
                pred, sure, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if order:
                    scores.learn(set().union(*(parts[i] for i in order)))
                    lengths = np.array([len(parts[i]) for i in order])
                    flat = np.fromiter((scores.at[w] for i in order for w in parts[i]), np.int64, int(lengths.sum()))
                    labels = viterbi(scores.table[flat], lengths, penalty)
                    doc = np.repeat(np.arange(len(order)), lengths)
                    share = np.bincount(doc * many + labels, scores.weight[flat], len(order) * many).reshape(-1, many)
                    top, total = share.argmax(1), share.sum(1)
                    ends = np.cumsum(lengths)
                    for j, i in enumerate(order):
                        if total[j] > 0:
                            pred[i], sure[i] = model.langs[top[j]], float(share[j, top[j]] / total[j])
                        if spans:
                            own = labels[ends[j] - lengths[j] : ends[j]]
                            cuts = np.append(np.append(0, np.flatnonzero(np.diff(own)) + 1), len(own)).tolist()
                            found[i] = [{"start": a, "end": b, "lang": model.langs[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [batch.column(id_col), pa.array(pred, pa.string()), pa.array(sure, pa.float64())]
                if spans:
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "spans"][: len(columns)])

    more = ", spans array<struct<start:bigint,end:bigint,lang:string>>" if spans else ""
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double{more}")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from documents whose crc32 of the id, as text, modulo 3 is not 1."""
    out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(docs.where(~out()))
    return identify(docs, model).select("doc_id", out().alias("held_out"), "lang_pred", "score")
