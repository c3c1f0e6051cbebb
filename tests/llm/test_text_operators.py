"""Operators over documents: small fixtures against brute force, with nulls, ties, empty tables and clashing columns."""

import hashlib
import random
import time
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Originals, exact and near copies, shared passages, repeated lines, empty and null texts, and one very long one."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(20)]
    passage = prose(rng, 60)
    out = list(base)
    out += base[:4]
    for t in base[4:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    lines = [prose(rng, 6) for _ in range(6)]
    out += ["\n".join(lines), "\n".join(lines[1:5]), "\n".join([lines[0], "", lines[1], lines[3]]), "\n".join(lines[2:4] * 3)]
    out += ["", None, "   \n\t ", "one", "one", "Two Words", "two words", prose(rng, 6000), "so " * 300]
    return [(i, t) for i, t in enumerate(out)] + [(None, base[0]), (None, None), (7, base[7])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t) if t else 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_jaccard_components(spark, texts, docs):
    from factorloom.llm.jaccard import jaccard_components

    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in jaccard_components(docs).collect())
    sets = [shingles(t, 4) for _, t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is not None and texts[j][0] is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d is None, d or 0, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(texts))
    assert got == want


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, texts, docs, batches):
    from factorloom.llm.substrings import remove_repeats

    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, batches=batches).collect())
    first = {}
    for d, t in texts:
        w = split(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t in texts:
        w = split(t)
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d is None, d or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(x[3] for x in want) > 100
    assert got == sorted(want)


def test_substring_index_compacts(spark):
    from factorloom.llm.substrings import Index, with_row

    rng = random.Random(3)
    shared = prose(rng, 70)
    rows = with_row(spark.createDataFrame([(i, f"{prose(rng, 30)} {shared}", "en", "s", 0) for i in range(6)], SCHEMA), "doc_id", "text")
    index = Index(spark, most_runs=2)
    for i in range(6):
        found = index.add(rows.where(F.col("id") == i), rows)
        starts = {s for r in found.collect() for s in range(r["a"], r["b"] + 1)}
        assert len(starts) == (0 if i == 0 else 21)
    assert len(index.runs) <= 2
    # what is left of the compacted runs gives the same as all of them
    more = with_row(spark.createDataFrame([(9, shared), (10, prose(rng, 60))], "doc_id long, text string"), "doc_id", "text")
    found = index.add(more, rows.union(more))
    assert {(r["id"], s) for r in found.collect() for s in range(r["a"], r["b"] + 1)} == {(9, s) for s in range(21)}


def test_runs_are_merged_without_an_exchange(spark):
    from factorloom.llm.substrings import Index, with_row

    rng = random.Random(6)
    rows = with_row(spark.createDataFrame([(i, prose(rng, 400)) for i in range(40)], "doc_id long, text string"), "doc_id", "text")
    index = Index(spark, parts=3)
    index.add(rows.where("id < 20"), rows)
    index.add(rows.where("id >= 20"), rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = index.runs
        plan = index.cold(old).join(index.cold(new).select("fp"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        merged = index.cold(old).union(index.cold(new)).groupBy("fp", "ctx").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in merged
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_is_opened_again(spark):
    """Another session goes on from the manifest; a version that was never finished does not count."""
    from factorloom.llm.common import new_path
    from factorloom.llm.substrings import Index, remove_repeats, with_row

    rng = random.Random(17)
    shared = prose(rng, 80)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "lasting-index")
    first = Index(spark, folder=folder)
    assert {r["n_removed"] for r in remove_repeats(table([(5, f"{prose(rng, 50)} {shared}")]), index=first, batches=1).collect()} == {0}
    first.close()
    unfinished = Index(spark, folder=folder)
    batch = with_row(table([(6, prose(rng, 90))]), "doc_id", "text")
    unfinished.add(batch, batch)  # never committed
    unfinished.close()
    again = Index(spark, folder=folder)
    assert again.version == 1 and len(again.runs) == 1
    got = remove_repeats(table([(1, f"{shared} {prose(rng, 50)}"), (2, prose(rng, 100))]), index=again, batches=1)
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 80, 2: 0}
    with pytest.raises(ValueError, match="50 words"):
        Index(spark, width=40, folder=folder)


def test_line_dedup(spark, texts, docs):
    from factorloom.llm.lines import drop_repeated_lines

    out = drop_repeated_lines(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "", r["n_removed"]) for r in out.collect())
    order = sorted({(d is None, d or 0, t) for d, t in texts if t is not None})
    seen, gone = set(), {}
    for none, d, t in order:
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip()]
        dead = set()
        for (i, a), (j, b) in zip(lines, lines[1:]):
            if (a, b) in seen:
                dead |= {i, j}
            seen.add((a, b))
        gone[none, d, t] = dead
    want = []
    for d, t in texts:
        if t is None:
            want.append((d is None, d or 0, True, "", 0))
        else:
            dead = gone[d is None, d or 0, t]
            want.append((d is None, d or 0, False, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dead), len(dead)))
    assert any(x[4] for x in want)
    assert got == sorted(want)


def test_mixing(spark, texts, docs):
    from factorloom.llm.mixing import in_training_order, mix

    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
    total = sum(r["size"] for r in rows)
    assert total == sum(len(split(t)) for _, t in texts)
    target = {s: v[0]["target"] for s, v in by.items()}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    for s, v in by.items():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert target[s] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - target[s]) <= 1
    # water filling: those below their cap have one level
    weight = dict(zip(sorted(by, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    level = {round(target[s] / weight[s], 6) for s, v in by.items() if target[s] < 2 * v[0]["source_size"] - 1e-6}
    assert len(level) <= 1
    assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, rows))
    placed = in_training_order(mix(docs)).collect()
    assert [r["position"] for r in placed] == sorted(r["position"] for r in placed)


def test_decontamination(spark):
    from factorloom.llm.decontamination import contaminated, without_contaminated

    item = "A train leaves Paris at 10:30 and travels 120 km in 2 h to reach Lyon, how fast does the train of Paris go on average"
    swapped = item.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "300")
    mixed_up = item.replace("leaves Paris", "leaves Rome")  # one name stands for two
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (None, item)], "item_id long, text string")
    rows = [(1, f"Intro words. {item}. Then more."), (2, f"Other words here. {swapped} and so on"), (3, mixed_up), (4, "nothing of the kind at all in these few words"), (5, None), (6, ""), (None, item), (7, "Short one"), (1, f"Intro words. {item}. Then more.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("hash", F.lit(1))
    for most in (1_000_000, 3):
        got = {(r["doc_id"], r["item_id"]): r["exact"] for r in contaminated(docs, bench, prefilter_windows=most).collect()}
        assert got == {(1, 1): True, (2, 1): False, (None, 1): True, (7, 3): True}
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 6]
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_names_at_sentence_starts(spark):
    from factorloom.llm.decontamination import contaminated

    item = "Alice has 12 apples. Bob gives Alice 5 more. How many apples does Alice have"
    swapped = "Carol has 7 apples. Dave gives Carol 9 more. How many apples does Carol have"
    mixed_up = "Carol has 7 apples. Dave gives Erin 9 more. How many apples does Frank have"
    lines = "Put down:\nCarol has 7 apples. Dave gives Carol 9 more. How many apples does Carol have"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, swapped), (3, mixed_up), (4, lines), (5, f"So, {swapped}")], "doc_id long, text string")
    for most in (1_000_000, 3):
        got = {r["doc_id"]: (r["coverage"], r["exact"]) for r in contaminated(docs, bench, prefilter_windows=most).collect()}
        assert got == {1: (1.0, True), 2: (1.0, False), 4: (1.0, False), 5: (1.0, False)}


def test_decontamination_of_edited_and_short_items(spark):
    from factorloom.llm.decontamination import contaminated

    item = "a farmer walks to the old market with Smith and sells some of the fresh eggs for 5 dollars then buys bread and milk and cheese before going back to the small farm near the river again"
    half = item.split()
    inserted = " ".join([*half[:19], "really", *half[19:]])
    removed = " ".join([*half[:19], *half[20:]])
    two = item.replace("Smith", "van Dyke").replace("5 dollars", "$5")
    names = "we know that Mary Smith meets Bob Jones at the park and then Mary Smith calls Bob Jones at home so Mary Smith can see Bob Jones there"
    fewer = names.replace("Mary Smith", "Ann").replace("Bob Jones", "Tom")
    halves = " ".join([*half[19:], *half[:19]])
    bench = spark.createDataFrame([(1, item), (2, names), (3, "what is the capital of France"), (4, "12 km")], "item_id long, text string")
    rows = [(1, inserted), (2, removed), (3, two), (4, f"so {fewer} today"), (5, "they ask what is the capital of Spain every day of the year"), (6, "it is 12 km from here to there and back again"), (7, "it is 15 km from here to there and back again"), (8, halves.replace("Smith", "Jones")), (9, "15 km")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1_000_000, 3):
        got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, prefilter_windows=most).collect()}
        assert got - {(8, 1)} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4), (9, 4)}


def test_chains_against_brute_force():
    from factorloom.llm.decontamination import chains

    rng = random.Random(9)
    for _ in range(300):
        hits = sorted({(rng.randrange(8), rng.randrange(12)) for _ in range(rng.randrange(1, 14))})
        got = chains(hits, 8, 0.0, 2)
        for at in got:  # in order, and never far from one diagonal to the next
            path = [hits[i] for i in at]
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(path, path[1:]))
            lanes = [d - b for b, d in path]
            assert len(set(lanes)) == 1 or all(abs(p - q) <= 2 for p, q in zip(lanes, lanes[1:]))


def test_typed_template_hashes_follow_templates():
    from factorloom.llm.common import WordHashes
    from factorloom.llm.decontamination import Canon, TemplateHashes

    canon, hashes, one = Canon(), TemplateHashes(), WordHashes()
    for t in ["Hello World, this is Bob. He ran 5km in 3.5 h! $20 and 10%\nAlice 5 kg -- ... 12:30 Paris", "", None, "in IN In. in, KG kg. Kg"]:
        assert np.array_equal(hashes.both(t)[1], one.of([w.encode() for w in canon.template(t, True)[0]]))


def test_template_hashes_follow_templates():
    from factorloom.llm.common import WordHashes
    from factorloom.llm.decontamination import Canon, TemplateHashes

    canon, hashes, one = Canon(), TemplateHashes(most=20), WordHashes()
    for t in ["Hello World, this is Bob. He ran 5km in 3.5 h! $20 and 10%\nAlice 5 kg -- ... 12:30 Paris", "", None, "a\n\nB c D Ee x2 €5", "¿Qué es Juan? Él", "in IN In. in, KG kg. Kg"] * 2:
        want = one.of([w.encode() for w in canon.template(t)[0]])
        assert np.array_equal(hashes.of(t), want)


def test_token_counts(spark, texts, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from factorloom.llm.token_counts import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a<|startoftext|>b", "don't STOP it now", "é ́x", "ΟΔΟΣ ΣΑΣ", "日本語テキスト 12345", "a\x1cb\x85c", "𝔘𝔫 🙂🙂"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)], SCHEMA)
    for most in (1_000_000, 20, 0):  # all pre-tokens frequent, some, none
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs.select(*more.columns).union(more).where("doc_id is not null"), path, most=most).collect()}
        for i, t in [*texts, *((1000 + i, t) for i, t in enumerate(odd))]:
            if i is not None:
                n = len(library.encode(t or "", add_special_tokens=False).ids)
                assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_token_counts_of_repeated_and_empty_rows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from factorloom.llm.token_counts import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "a b", 1), (None, "a b", 2), (7, None, 3), (7, "", 4), (7, " \n", 5), (7, " \n", 6), (8, "zz " * 5000, 7), (9, "a" * 40 + " b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    for most in (1_000_000, 0):
        got = sorted((tuple(r) for r in token_counts(docs, path, most=most).collect()), key=str)
        assert [r[:2] for r in got] == [(7, 0), (7, 0), (7, 2), (7, 2), (8, 15000), (9, 42), (None, 3), (None, 3)]
        assert [r[2] for r in got[:4]] == [0] * 4 and got[4][3] and got[6] == got[7] and got[6][2] == 2
        assert got[5][2] == len(Tokenizer.from_file(path).encode("a" * 40 + " b", add_special_tokens=False).ids)
        assert token_counts(docs.where("false"), path, most=most).count() == 0


def test_language(spark):
    from factorloom.llm.language import held_out_languages, identify, train

    rng = random.Random(1)
    words = {"aa": "strong winter thing water house north", "bb": "ñandu niño señor agua casa calle", "cc": "мир дом вода река город"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(30)), k, "s", 0) for i, k in enumerate(list(words) * 20)]
    rows += [(100, None, "aa", "s", 0), (101, "123 -- 4", None, "s", 0), (102, "", "bb", "s", 0), (None, "strong house", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = held_out_languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            assert r["lang_pred"] == rows[r["doc_id"]][2] and r["score"] > 0.9
        if r["doc_id"] in (100, 101, 102):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    mixed = spark.createDataFrame([(1, "strong winter thing water house north strong house " * 2 + "señor agua casa calle niño ñandu señor casa " * 2)], "doc_id long, text string")
    spans = identify(mixed, train(docs), spans=True).first()["spans"]
    assert [(s["start"], s["end"], s["lang"]) for s in spans] == [(0, 16, "aa"), (16, 32, "bb")]
    nothing = held_out_languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert held_out_languages(docs.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    from factorloom.llm.language import viterbi

    rng = np.random.default_rng(2)
    lengths = np.array([6, 5, 5, 1])
    score = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    got, at = viterbi(score, lengths, 0.7), 0
    for n in lengths:
        part = score[at : at + n]
        value = lambda path: sum(part[i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(value(got[at : at + n]) - max(map(value, product(range(3), repeat=int(n))))) < 1e-5
        at += n


def test_toxicity(spark):
    from factorloom.llm.toxicity import held_out_scores, is_held_out, train, without_toxic

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 40).split()
        if toxic := i % 5 == 0:
            w[7], w[20], w[30] = "you", "grobnik", "idiot"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "you idiot", "en", "s", 0), (902, "You IDIOT!! " * 2000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("features", F.lit("clash"))
    labelled = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in held_out_scores(docs, labelled).collect()}
    assert len(got) == len(rows)
    held = [got[i] for i, _, _ in labels if got[i]["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and got[902]["predicted"] == 1
    model = train(docs, labelled, usable=~is_held_out())
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = held_out_scores(docs, labelled.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.0]


def test_toxicity_of_few_labels(spark):
    from factorloom.llm.toxicity import held_out_scores, is_held_out, train, without_toxic

    rng = random.Random(6)
    rows = []
    for i in range(120):
        w = prose(rng, 40).split()
        if i % 7 == 0:
            w[7], w[20], w[30] = "you", "moron", "idiot"
        rows.append((i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in held_out_scores(docs, labels).collect()}
    assert got == {i: int(i % 7 == 0) for i in range(120)}
    kept = without_toxic(docs, train(docs, labels, usable=~is_held_out()))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(120) if i % 7}
    assert without_toxic(docs, train(docs, labels.where("toxic = 1"), usable=~is_held_out())).count() == 120


def test_toxicity_in_a_small_worker(spark, monkeypatch):
    """What a Python worker imports and holds: no pandas, each text once, counts in parts that give the same lexicon."""
    import subprocess
    import sys

    from factorloom.llm import toxicity as t

    loaded = subprocess.run([sys.executable, "-c", "import sys, factorloom.llm.toxicity; print(*sys.modules)"], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(x for x in sys.path if x)}).stdout.split()
    assert "factorloom.llm.toxicity" in loaded and not {"pandas", "pyspark.ml"} & set(loaded)

    rng = random.Random(12)
    rows = [(i, prose(rng, 30) + (" you grobnik idiot" if i % 4 == 0 else ""), "en", "s", i) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labelled = spark.createDataFrame([(r[1], int(r[0] % 4 == 0)) for r in rows], "text string, label int")
    whole = t.learned_lexicon(labelled, 150)
    assert {"grobnik", "idiot"} <= set(whole) and t.learned_lexicon(labelled, 150, held=20) == whole

    model, given = t.train(docs, spark.createDataFrame([(r[0], int(r[0] % 4 == 0)) for r in rows], "doc_id long, toxic int"), usable=F.lit(True)), []
    plain = t.with_features
    monkeypatch.setattr(t, "with_features", lambda d, learned, keep, text_col="text": given.append(d.select(*dict.fromkeys([*keep, text_col]))) or plain(d, learned, keep, text_col))
    upper = t.without_toxic(docs.withColumnRenamed("text", "Text"), model)
    assert upper.columns == ["doc_id", "Text", *docs.columns[2:]]
    kept = t.without_toxic(docs, model)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, upper.collect())) == [r for r in rows if r[0] % 4]
    for sent in given:
        assert all(str(r).count(rows[r[0]][1]) == 1 for r in sent.collect())


def test_jaccard_of_repeated_and_null_ids(spark):
    from factorloom.llm.jaccard import jaccard_components, one_of_each

    rng = random.Random(8)
    one, two, three = (prose(rng, 80) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    # two texts of id 5, each with a near copy; a null id before the text that has a near copy
    rows = [(5, one), (5, two), (6, near(one)), (7, near(two)), (None, three), (8, three), (9, near(three)), (5, "one text of its own that nothing is like")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect() if r["doc_id"])
        assert got == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8)]
    docs = spark.createDataFrame([(3, one), (5, near(one)), (5, two), (None, one)], "doc_id long, text string").coalesce(1)
    assert sorted(((r[0] or 0), r[1]) for r in one_of_each(docs).collect()) == sorted([(0, one), (3, one), (5, two)])


def test_substring_index_lasts_between_tables(spark):
    from factorloom.llm.substrings import Index, remove_repeats

    rng = random.Random(12)
    shared, other = prose(rng, 60), prose(rng, 60)
    wrap = lambda t: f"{prose(rng, 45)} {t} {prose(rng, 45)}"
    old = [(10, wrap(shared)), (11, wrap(other))]
    new = [(20, wrap(shared)), (2, wrap(other)), (21, prose(rng, 90))]
    again = [(30, wrap(shared)), (1, wrap(other))]
    index = Index(spark)
    for rows, want in ((old, {10: 0, 11: 0}), (new, {20: 60, 2: 60, 21: 0}), (again, {30: 60, 1: 60})):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), index=index, batches=1)
        assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want


def test_training_order_is_whole(spark, texts, docs):
    import corpus_pipeline

    from factorloom.llm.mixing import mix

    rows = corpus_pipeline.mixing(spark, docs, "").collect()
    mixed = mix(docs).collect()
    at = [r["position"] for r in rows]
    known = [x for x in at if x is not None]
    assert known == sorted(known) and at == known + [None] * (len(at) - len(known))
    assert sorted(known) == sorted(x for r in mixed for x in (r["position"], r["again_at"]) if x is not None)
    assert len([r for r in rows if r["pass"] <= 1]) == len(texts)
    assert {r["pass"] for r in rows if r["position"] is None} == {0}


def test_line_dedup_of_single_lines(spark):
    from factorloom.llm.lines import drop_repeated_lines

    rng = random.Random(14)
    long, short, other = prose(rng, 12), prose(rng, 3), [prose(rng, 12) for _ in range(4)]
    rows = [(1, f"{other[0]}\n{long}\n{short}"), (2, f"{long}\n{other[1]}\n{short}"), (3, long), (4, f"{other[2]}\n\n{long}\n{long}"), (None, long), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in drop_repeated_lines(docs, single_words=8, counts=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"{other[1]}\n{short}", 1), 3: ("", 1), 4: (f"{other[2]}\n", 2), None: ("", 1), 5: (None, 0)}
    assert {r["n_removed"] for r in drop_repeated_lines(docs, counts=True).collect()} == {0}


def test_empty_tables(spark, docs):
    from factorloom.llm.jaccard import jaccard_components
    from factorloom.llm.lines import drop_repeated_lines
    from factorloom.llm.mixing import mix
    from factorloom.llm.substrings import remove_repeats

    none = docs.limit(0)
    for df in (jaccard_components(none), remove_repeats(none), drop_repeated_lines(none), mix(none)):
        assert df.count() == 0


def test_decontamination_of_tables_of_numbers(spark):
    """Rows of numbers are copies only with the same numbers, and take time in proportion, however many there are; so do repeated words."""
    from factorloom.llm.decontamination import contaminated

    rng = random.Random(12)
    numbers = " ".join(str(rng.randrange(10**6)) for _ in range(40))
    prices = "Prices in the list: " + " ".join(f"{rng.randrange(900)} kg {rng.randrange(900)} km" for _ in range(20))
    items = [(1, numbers), (2, prices), (3, "0 " * 40), (4, "ha " * 30 + "said the old man in the boat to himself")]
    docs = [
        (1, " ".join(str(rng.randrange(10**6)) for _ in range(100_000))),  # other numbers
        (2, f"Some words before it {numbers} and some words after it"),
        (3, " ".join(f"{rng.randrange(900)} kg {rng.randrange(900)} km" for _ in range(2000))),
        (4, f"From a report.\n{prices} So it ends."),
        (5, "0 " * 100_000),
        (6, "ha " * 50_000 + "said the old man in the boat to himself"),
        (7, "3 apples " * 20_000),
        (8, " ".join(str(rng.randrange(10**6)) for _ in range(50_000)) + f" {numbers} " + " ".join(str(rng.randrange(10**6)) for _ in range(50_000))),
    ]
    began = time.time()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(2, 1), (4, 2), (5, 3), (6, 4), (8, 1)]
    assert all(r["exact"] for r in got)
    assert time.time() - began < 120
