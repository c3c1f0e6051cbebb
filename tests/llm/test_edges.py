"""Clashing columns, empty tables, odd ids and options of the operators and stages."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_copy", "_copy_row", "_found", "_gone", "_gone_id", "_gone_row", "_row_key", "_doc", "_id", "_text", "_row", "id", "row", "key", "h", "n", "at", "start", "hash", "item", "part", "features", "raw", "score", "label", "token", "position_", "bits")


def prose(rng, n):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    one = "\n".join(prose(rng, 12) for _ in range(4))
    item = "Alice bought 12 apples and 5 pears for Bob at 3 dollars each on Monday morning in town"
    out = [(i, prose(rng, 40)) for i in range(12)]
    out += [(20, one), (21, one), (22, f"{prose(rng, 30)}\n{item}\n{prose(rng, 30)}"), (23, None), (24, ""), (None, one), (24, one), (25, "x " * 20_000)]
    return out, item


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows[0]], SCHEMA).withColumns({n: F.lit("clash") for n in CLASHES})


def test_stages_take_clashing_columns_nulls_and_empty_tables(spark, docs, rows, tmp_path):
    from factorloom.llm.decontamination import without_contaminated
    from factorloom.llm.jaccard import one_of_each
    from factorloom.llm.lines import drop_repeated_lines
    from factorloom.llm.mixing import in_training_order, mix
    from factorloom.llm.toxicity import train, without_toxic

    benchmark = spark.createDataFrame([(1, rows[1]), (2, None)], "item_id long, text string").withColumns({"_found": F.lit(1), "id": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int")
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    whole, got = ids(docs.collect()), {}
    stages = {"near": one_of_each, "bench": lambda d: without_contaminated(d, benchmark), "lines": drop_repeated_lines, "toxic": lambda d: without_toxic(d, train(d, labels, usable=F.lit(True)))}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got[name] = out.collect()
        assert {r["_copy"] for r in got[name]} == {"clash"}
        assert stage(docs.limit(0)).count() == 0
    assert set(whole) - set(ids(got["bench"])) == {(False, 22)}
    assert set(whole) - set(ids(got["near"])) == {(False, 21)}
    assert ids(got["near"]).count((False, 24)) == 1  # the copy goes, the empty text of the same id stays
    assert ids(got["lines"]) == whole == ids(mix(docs).collect())
    assert in_training_order(mix(docs.limit(0))).count() == 0
    assert ids(without_contaminated(docs, benchmark.limit(0)).collect()) == whole


@pytest.mark.parametrize("min_run", [1, 2, 3, 4])
def test_line_runs_of_any_length(spark, min_run):
    """Against plain Python: every window of so many lines that stands at a smaller place goes."""
    from factorloom.llm.lines import drop_repeated_lines, fingerprints, own_windows

    rng = random.Random(min_run)
    pool = [prose(rng, 5) for _ in range(7)]
    texts = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randrange(0, 15)))) for i in range(40)]
    texts += [(50, "\n".join(pool[:6])), (51, "\n".join([*pool[:6], "end"]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs, min_run=min_run).collect()}
    # rows with one id and text are told apart by nothing, so order by id alone is enough here
    seen, want = set(), {}
    for d, t in sorted(texts):
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip()]
        dead = set()
        for j in range(len(lines) - min_run + 1):
            part = lines[j : j + min_run]
            key = tuple(x for _, x in part)
            if key in seen:
                dead |= {i for i, _ in part}
            seen.add(key)
        want[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dead)
    assert got == want
    # each window is held by exactly one fingerprint
    prints = fingerprints(docs, min_run, "doc_id", "text")
    held = {(r["id"], r["start"]) for r in prints.select("id", F.explode(own_windows(min_run)["start"]).alias("start")).collect()}
    assert held == {(d, j + 1) for d, t in texts for j in range(len([x for x in t.split("\n") if x.strip()]) - min_run + 1)}


def test_positions_follow_the_demand_of_the_whole_mix(spark):
    """At a position of the mix every source has been read as far as its weight schedule says, and all together as far as the position says."""
    from factorloom.llm.mixing import mix

    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(5, 60)), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    slopes = {"a": 0.5, "b": 0.0, "c": -0.5}
    rows = mix(docs, share=0.9).collect()
    target = {r["source"]: r["target"] for r in rows}
    for at in (0.2, 0.5, 0.8):
        t = next(x / 100_000 for x in range(100_001) if sum(n * ((1 - slopes[s]) * x / 100_000 + slopes[s] * (x / 100_000) ** 2) for s, n in target.items()) >= at * sum(target.values()))
        for s, n in target.items():
            read = sum(r["size"] for r in rows if r["source"] == s for x in (r["position"], r["again_at"]) if x is not None and x < at)
            assert abs(read - n * ((1 - slopes[s]) * t + slopes[s] * t * t)) <= 130
    assert sum(r["taken"] for r in rows) == sum(round(n) for n in target.values())


def test_tokenizers_that_span_words_are_refused(tmp_path):
    import public_tokenizers

    from factorloom.llm.token_counts import check_tokenizer

    check_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="white space"):
        check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_frequent_keys_join_like_others(spark):
    from factorloom.llm.common import join_by_frequency

    rows = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0")
    got = join_by_frequency(rows, keyed, ["k"], share=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed, ["k"]).collect()))


def test_toxicity_of_one_kind_in_a_fold_and_of_empty_tables(spark):
    from factorloom.llm.toxicity import held_out_scores

    rng = random.Random(3)
    docs = [(i, prose(rng, 20) + (" you stupid idiot" if i % 5 == 0 else "")) for i in range(60)]
    table = spark.createDataFrame(docs + [docs[0], (None, "x")], "doc_id long, text string")
    for kept in (lambda i: i % 5 == 0, lambda i: i % 5 != 0, lambda i: i < 6, lambda i: i < 25):
        labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs if kept(i)], "doc_id long, toxic int")
        out = held_out_scores(table, labels).collect()
        assert len(out) == 62 and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in held_out_scores(table, none).collect()} == {0}
    assert held_out_scores(table.limit(0), none).count() == 0


def test_lines_of_very_long_documents(spark):
    """Texts of 200,000 lines, one twice and one whose lines repeat within, next to short ones."""
    from factorloom.llm.lines import drop_repeated_lines

    n = 200_000
    lines = [f"line {i}" for i in range(n)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(["top", *lines[500:900], "middle", *lines[n - 300 :]])), (4, "\n".join(["a", "b"] * (n // 2))), (5, "a\nx\nb")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in drop_repeated_lines(docs, counts=True).collect()}
    assert got == {1: (texts[0][1], n, 0), 2: ("", n, n), 3: ("top\nmiddle", 702, 700), 4: ("a\nb", n, n - 2), 5: (texts[4][1], 3, 0)}
