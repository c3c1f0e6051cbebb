"""Toxicity: boosted trees over dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import saved, slices, words

if TYPE_CHECKING:  # every Python worker imports this module, and keeps what that loads: pyspark.ml brings pandas, and only the driver needs either
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

#: Bytes of text that a task turns into Python objects at a time.
SLICE = 4 << 20
#: Insults known without any label.
SEED = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool liar coward vermin filth shut hate kill die".split())
#: Words that speak to the reader, in the languages of the corpus.
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("@4310$57!|", "aaeiosstii")
ODD = re.compile(r"[A-Za-z][@$!*#%&0-9|]+[A-Za-z]|(.)\1{3,}")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NAMES = ["lexicon_density", "lexicon_hits", "learned_density", "learned_hits", "learned_weight", "near_second", "second_density", "capitals", "caps_words", "exclaims", "questions", "runs_of_marks", "marks", "obfuscated", "log_words", "repeats"]


def normal(word: str) -> str:
    """Lower case, without marks at the edges, letter-like signs inside as letters."""
    bare = EDGE.sub("", word).lower()
    return bare.translate(LEET) if not bare.isalpha() and not bare.isdigit() else bare


class Kinds(dict):
    """Bit flags by word: 1 seed lexicon, 2 learned lexicon, 4 second person, 8 all capitals, 16 obfuscated."""

    def __init__(self, learned: dict[str, float], most: int = 100_000):
        super().__init__()
        self.learned, self.most = learned, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "replace")
        n = normal(text)
        self[word] = k = (n in SEED) | (n in self.learned) << 1 | (n in SECOND) << 2 | (len(n) > 1 and text.isupper()) << 3 | (ODD.search(text) is not None) << 4
        return k


def features(text: str | None, kinds: Kinds) -> list[float]:
    parts = words(text)
    if not parts:
        return [0.0] * len(NAMES)
    k = np.fromiter(map(kinds.__getitem__, parts), np.uint8, len(parts))
    n = len(parts)
    seed, learned, second = k & 1 > 0, k & 2 > 0, k & 4 > 0
    hits = np.flatnonzero(seed | learned)
    you = np.flatnonzero(second)
    near = 0
    if len(hits) and len(you):
        spot = np.searchsorted(you, hits)
        left = hits - you[np.maximum(spot - 1, 0)]
        right = you[np.minimum(spot, len(you) - 1)] - hits
        near = int(((left >= 0) & (left <= 5) | (right >= 0) & (right <= 5)).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, lower = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 97) & (raw <= 122)).sum())
    marks = (raw == 33) | (raw == 63)
    signs = (raw < 128) & (raw > 32) & ~((raw >= 48) & (raw <= 57) | (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122))
    weight = sum(kinds.learned[x] for x in (normal(parts[i].decode("utf-8", "replace")) for i in np.flatnonzero(learned).tolist()))
    return [
        float(seed.mean()), float(seed.sum()), float(learned.mean()), float(learned.sum()), float(weight), near / n, float(second.mean()),
        upper / max(1, upper + lower), float((k & 8 > 0).mean()), float((raw == 33).sum()) / n, float((raw == 63).sum()) / n,
        float((marks[1:] & marks[:-1]).sum()) / n, float(signs.sum()) / len(raw), float((k & 16 > 0).mean()), float(np.log1p(n)), 1 - len(set(parts)) / n,
    ]


def with_features(docs: DataFrame, learned: dict[str, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``features array<double>`` of every whole text."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n in keep)

    def run(batches):
        kinds = Kinds(learned)
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                found = np.array([features(t, kinds) for t in batch.column(text_col).to_pylist()]).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "features"])

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]).mapInArrow(run, f"{schema}, features array<double>")


def learned_lexicon(labelled: DataFrame, most: int, least_docs: int = 5, held: int = 50_000) -> dict[str, float]:
    """The ``most`` words that tell toxic documents from others best: log ratio of document rates, significant at 5 sigma.

    A task hands its counts on once it holds ``held`` of them, a document's words more at most.
    """

    def rows(got):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([int(k[1]) for k in got], pa.int32()), pa.array(list(got.values()), pa.int64())], names=["word", "label", "n"])

    def count(batches):
        got = Counter()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                    got.update((w, label) for w in {normal(x) for x in (text or "").split()} if w)
                    if len(got) >= held:
                        yield rows(got)
                        got = Counter()
        yield rows(got)

    per = labelled.select("text", "label").mapInArrow(count, "word string, label int, n long")
    total = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0))
    table = per.groupBy("word").agg(of(1).alias("a"), of(0).alias("b")).where(F.col("a") >= least_docs)
    rate = (F.col("a") + F.col("b")) / F.lit(float(toxic + clean))
    z = (F.col("a") / F.lit(float(toxic)) - F.col("b") / F.lit(float(max(1, clean)))) / F.sqrt(rate * (1 - rate) * F.lit(1.0 / max(1, toxic) + 1.0 / max(1, clean)) + 1e-12)
    weight = F.log((F.col("a") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(clean + 1.0))
    best = table.select("word", weight.alias("weight"), z.alias("z")).where("z > 5 and weight > 1").orderBy(F.desc("z"), "word").limit(most)
    return {r["word"]: r["weight"] for r in best.collect()}


@dataclass
class Model:
    learned: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    rate: float


def train(docs: DataFrame, labels: DataFrame, *, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_words: int = 150, seed: int = 7) -> Model:
    """Fits on labelled documents for whose id ``usable`` holds; at most ``most_rows`` of them, drawn by hash of the id.

    Four fifths fit lexicon and trees, one fifth, which these never see, the calibration; where a kind has fewer than 10 rows, or one of the parts
    lacks a kind, all rows fit all three.
    Without labels of both kinds there is no model.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    drawn = labels.where(usable).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    drawn = drawn.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = saved(texts.join(F.broadcast(drawn), "id"), "toxicity-sample")  # most_rows bounds the small side
    total = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    rows = sum(total.values())
    rate = total.get(1, 0) / rows if rows else 0.0
    if len(total) < 2:
        return Model({}, None, None, rate)
    fold = F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string"))) % 5
    few = min(total.values()) < 10 or sample.select(fold > 0, "label").distinct().count() < 4
    learned = learned_lexicon(sample if few else sample.where(fold > 0), most_words)
    table = saved(with_features(sample, learned, ["id", "label"]).repartition(4, "id"), "toxicity-features")
    table = table.select("label", array_to_vector("features").alias("features"), fold.alias("fold"))
    fit, rest = (table, table) if few else (table.where("fold > 0"), table.where("fold = 0"))
    leaf = min(5, max(1, min(total.values()) // 2))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=leaf, seed=seed).fit(fit)
    raw = trees.transform(rest).select(F.col("label").cast("double"), vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="score").fit(raw)
    return Model(learned, trees, steps, rate)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text, 0 to 1.

    Null and empty texts score as texts without any feature.  Null ids stay null, repeated rows are scored each, other columns
    are ignored.  Where labels are of one kind, or there are none, their rate is given to all.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model.trees is None:
        return docs.select(F.col(f"`{id_col}`"), F.lit(float(model.rate)).alias("score"))
    rows = with_features(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), model.learned, [id_col], text_col)
    raw = model.trees.transform(rows.select(f"`{id_col}`", array_to_vector("features").alias("features"))).select(f"`{id_col}`", vector_to_array("probability")[1].alias("raw"))
    return model.steps.transform(raw).select(f"`{id_col}`", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id, as text, modulo 4 is 2: rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    model = train(docs, labels, usable=~is_held_out())
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, all columns as they are; nothing is joined or shuffled.

    Without a model nothing tells documents apart, and all stay.  Columns go through Python once each, the text too, by place,
    so that no name clashes with those that the model adds.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model.trees is None:
        return docs
    names = docs.columns
    text = names.index(text_col) if text_col in names else [c.lower() for c in names].index(text_col.lower())
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = with_features(plain, model.learned, plain.columns, f"c{text}").select(*plain.columns, array_to_vector("features").alias("features"))
    raw = model.trees.transform(rows).select(*plain.columns, vector_to_array("probability")[1].alias("raw"))
    return model.steps.transform(raw).where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
