"""The pipeline's contract: stages in order, whole tables, columns of documents, and a result that its stages account for."""

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "jaccard", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    rows = docs
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes, name
        path = p.saved(rows, f"test-{name}")
        now = {r[0] for r in path.select("doc_id").collect()}
        assert now <= ids
        if name == "line_dedup":
            assert now == ids
        ids, rows = now, path
    whole = p.run(spark, SF)
    added = ["size", "source_size", "target", "taken", "pass", "position"]
    assert whole.columns == [*docs.columns, *added] and whole.dtypes[: len(docs.columns)] == docs.dtypes
    final = whole.collect()
    assert {r["doc_id"] for r in final} == ids
    texts = {r["doc_id"]: tuple(r[c] for c in docs.columns) for r in rows.collect()}
    assert all(tuple(r[c] for c in docs.columns) == texts[r["doc_id"]] for r in final)
    places = [r["position"] for r in final]
    read = [x for x in places if x is not None]
    assert places == sorted(read) + [None] * (len(places) - len(read))


def test_training_order_keeps_columns_and_tells_equal_rows_apart(spark):
    """Null and repeated ids, a column named as one of the order's, and an empty table."""
    from factorloom.llm.mixing import ORDER, mix, training_order

    rows = [(i % 30 if i else None, "w " * (i % 7), f"s{i % 3}", f"n{i}") for i in range(90)]
    rows += [rows[40]] * 3  # alike in all columns
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    out = training_order(docs.selectExpr("*", "'x' AS taken", "1 AS uid", "2 AS id", "3 AS doc")).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "note", "uid", "id", "doc", *ORDER}
    assert sorted({r["note"] for r in out}) == sorted({r[3] for r in rows}) and len([r for r in out if r["pass"] <= 1]) == len(rows)
    assert all(r["size"] == len((r["text"] or "").split()) for r in out)
    taken = lambda found: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in found)
    assert [x[1:] for x in taken([r for r in out if r["pass"] <= 1])] == [x[1:] for x in taken(mix(docs).collect())]
    assert training_order(docs.limit(0)).count() == 0


def test_run_against_plain_python(spark, tmp_path):
    """run() on planted toxic, repeated, near-copy and benchmark texts against plain versions of the stages before the mix."""
    import random

    import corpus_pipeline as p

    rng = random.Random(21)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    texts = {i: "\n".join(prose(20) for _ in range(4)) for i in range(120)}
    toxic = {i for i in texts if i % 6 == 0}
    for i in toxic:
        w = texts[i].split(" ")
        w[5], w[12], w[30] = "you", "idiot", "moron"
        texts[i] = " ".join(w)
    run = "\n".join(prose(15) for _ in range(2))
    for i in (7, 13, 19):
        texts[i] += f"\n{run}"
    for i, j in ((1, 101), (2, 92), (3, 93)):  # near copies: a word changed in every other line, so that no two lines in a row repeat
        texts[j] = "\n".join(" ".join([*line.split()[:-1], f"end{k}"]) if k % 2 else line for k, line in enumerate(texts[i].split("\n")))
    texts[25] = f"{prose(20)} {item} {prose(20)}"
    texts[31] = f"{prose(5)}\n{item}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in texts.items() if i not in toxic}
    seen = set()
    for i in sorted(left):
        lines = left[i].split("\n")
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in left.items()}
    near = {j for j in left for i in left if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near == {92, 93, 101}
    left = {i: t for i, t in left.items() if i not in near and item not in t.replace("\n", " ")}
    assert len(left) == 120 - 20 - 3 - 2
    rows = p.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(t.split()) for i, t in left.items()}
    assert len([r for r in rows if r["pass"] <= 1]) == len(left)
