"""The Merkle manifest against plain Python, its monoid, and the edges of its tables."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """(root, the proof of each leaf as (left, right) pairs)."""
    tiers = [leaves]
    while len(tiers[-1]) > 1:
        tiers.append([h(*tiers[-1][i : i + 3]) for i in range(0, len(tiers[-1]), 3)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for tier in tiers[:-1]:
            start = i - i % 3
            steps.append(("".join(tier[start:i]), "".join(tier[i + 1 : start + 3])))
            i //= 3
        proofs.append(steps)
    return tiers[-1][0], proofs


def brute(rows):
    sources, out = {}, []
    for doc_id, text, lang, source, n_chars in rows:
        fields = [value(doc_id), value(source), value(lang), value(n_chars)]
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = text.replace("\n", "") if even and text is not None else text
        sources.setdefault(source, []).append((doc_id, h(*fields, value(text)), h(*fields, value(other))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([x[1] for x in sources[s]]) for s in names}
    root, top = tree([trees[s][0] for s in names]) if names else (None, [])
    for s, above in zip(names, top, strict=True):
        for (doc_id, leaf, bad), own in zip(sources[s], trees[s][1], strict=True):
            steps, fold = own + above, bad
            for left, right in steps:
                fold = h(left, fold, right)
            out.append((doc_id, leaf, trees[s][0], root, h(*[x for p in steps for x in p]), fold, fold == root))
    return sorted(out, key=repr)


def found(docs):
    rows = merkle.manifest(docs, tampered=merkle.stripped_of_newlines(docs))
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=repr)


def test_manifest_of_hot_and_lone_sources(spark):
    """One source holds most rows, in many blocks; others one, two or four; texts of each kind."""
    draw = random.Random(3)
    texts = [None, "", "\n", "one\ntwo", "no line feed", "é\n漢", "x\n" * 30_000]
    rows = [(i, draw.choice(texts[:6]), draw.choice(["en", None]), "hot" if i % 3 else f"s{i % 50}", draw.choice([None, i])) for i in range(900)]
    rows += [(900 + i, texts[6], "en", None, 5) for i in range(2)] + [(950, "a", "en", "", 1), (951, "a\nb", "en", "lone", 3)]
    draw.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_manifest_of_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a\nb", "en", "s", 1), (None, None, None, None, None), (7, "a\nb", "en", "s", 3), (7, "a\nb", "en", "s", 3), (7, "b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("tree", "id", "leaf", "idx", "n", "block", "root", "bad", "salt", "part")])
    assert found(docs) == found(more) == brute(rows)


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = [(4, "a\nb", "en", "s", 3)]
    assert found(spark.createDataFrame(one, SCHEMA)) == brute(one)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(120)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), steps=True).collect():
        node = r["leaf"]
        for left, right in zip(r["lefts"], r["rights"], strict=True):
            node = h(left, node, right)
        assert node == r["root"] and r["verified"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=3), st.randoms(use_true_random=False))
def test_fragments_merge_in_any_order(sizes, draw):
    """Whatever the fragments and the order in which they meet: the same roots and runs; the empty forest is neutral."""
    nodes = [(t, n, 0, i, h(f"{t}:{i}").encode()) for t, n in enumerate(sizes) for i in range(n)]
    draw.shuffle(nodes)
    parts = [merkle.Forest() for _ in range(draw.randint(1, 6))]
    for x in nodes:
        draw.choice(parts).add(*x)
    while len(parts) > 1:
        a = parts.pop(draw.randrange(len(parts)))
        parts[draw.randrange(len(parts))].merge(a)
    whole = merkle.Forest().merge(parts[0])
    want = {t: tree([h(f"{t}:{i}") for i in range(n)])[0].encode() for t, n in enumerate(sizes)}
    assert whole.roots() == parts[0].roots() == want
    for t, n in enumerate(sizes):
        proofs = tree([h(f"{t}:{i}") for i in range(n)])[1]
        assert all(parts[0].above(t, 0, i) == [(a.encode(), b.encode()) for a, b in proofs[i]] for i in range(n))


def test_sizes_around_powers_of_three(spark):
    rows = [(i, f"{i}\n", "en", f"s{n}", i) for n in (1, 2, 3, 4, 9, 10, 81, 82, 244) for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clean_rows_are_folded_too(spark):
    """What a row's leaf and siblings lead to is computed for rows that nobody tampered with as well, not taken from the root that is given."""
    sizes = (1, 2, 82, 244)
    leaves = {t: [h(f"{t}:{i}") for i in range(n)] for t, n in enumerate(sizes)}
    rows = [(t, i, bytearray.fromhex(x), None) for t, xs in leaves.items() for i, x in enumerate(xs)]

    def finish(table, tops, forest, roots, height):
        none = F.array().cast("array<string>")
        return merkle.proofs(table, tops.select("tree", "block", none.alias("lefts"), none.alias("rights"), F.lit("0" * 64).alias("root")), forest, height, False)

    got = merkle.climbed(spark.createDataFrame(rows, "tree int, name long, leaf binary, bad binary"), ["name"], finish).collect()
    assert len(got) == sum(sizes) and all(r["root"] == "0" * 64 and r["folded_root"] == tree(leaves[r["tree"]])[0] for r in got)
