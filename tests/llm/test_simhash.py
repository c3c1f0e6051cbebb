"""SimHash components against brute force over all pairs, BK-trees against plain search, and edges."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import simhash

SCHEMA = "doc_id long, text string"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = (text or "").translate(ASCII_LOWER)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    known = [x for x in prints if x[0] is not None]
    parent = list(range(len(known)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            if (known[i][1] ^ known[j][1]).bit_count() <= radius or known[i][0] == known[j][0] and known[i][1] == known[j][1]:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(known):
        least[top(i)] = min(doc, least.get(top(i), doc))
    out = [(doc, f"{fp:016x}", least[top(i)]) for i, (doc, fp) in enumerate(known)]
    return sorted(out + [(None, f"{fp:016x}", None) for i, fp in prints if i is None], key=repr)


def found(docs, **more):
    return sorted(map(tuple, simhash.simhash_components(docs, **more).collect()), key=repr)


def varied(draw, base, changes):
    words = base.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def test_components_of_copies_and_near_copies(spark):
    """A group of copies holds a third of all rows; near copies of a long text differ in few bits, and link in chains."""
    draw = random.Random(5)
    base = " ".join(f"v{draw.randrange(500)}" for _ in range(400))
    texts = [base] * 80 + [varied(draw, base, draw.randint(1, 6)) for _ in range(80)] + [" ".join(f"u{draw.randrange(900)}" for _ in range(draw.randint(1, 30))) for _ in range(60)]
    texts += [None, "", " \t\n", "One", "one", "one TWO", "one\vtwo", "one two three", "one two", "É é", "a b c d " * 9000]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    want = brute(rows)
    assert 5 < len({c for _, _, c in want}) < len({f for _, f, _ in want})
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs) == want
    assert found(docs, most_nodes=4) == want  # chunks with a tree each, looked through by each other


def test_nulls_repeats_clashing_names_and_an_empty_table(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (3, "other words here"), (9, "a b c d"), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "fp", "n", "key", "pair", "root", "chunk", "component_id")])
    assert found(docs) == found(more) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20, unique=True), min_size=1, max_size=5), st.integers(0, 3), st.randoms(use_true_random=False))
def test_trees_find_all_within_the_radius(groups, radius, draw):
    for g in groups:  # neighbours too
        g += sorted({x ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for x in g} - set(g))
    fp = np.array([x for g in groups for x in g], np.uint64)
    size = np.array([len(g) for g in groups])
    root = np.repeat(np.cumsum(size) - size, size)
    trees = simhash.Trees(fp, root, radius)
    got = {(int(q), int(x)) for qs, xs in trees.within(fp, root, np.repeat(size, size), most=16) for q, x in zip(qs, xs, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if root[i] == root[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert got == want
    one = simhash.Trees.unpacked(trees.packed(0, len(groups[0])), radius)
    assert np.array_equal(one.fp, fp[: size[0]])
    again = {(int(q), int(x)) for qs, xs in one.within(fp, np.zeros(len(fp), np.int64), np.full(len(fp), size[0])) for q, x in zip(qs, xs, strict=True)}
    assert again == {(i, j) for i in range(len(fp)) for j in range(size[0]) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_joined_is_the_smallest_reachable(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in pairs:
            reach[a] |= reach[b]
            reach[b] |= reach[a]
    made = [(np.array([a]), np.array([b])) for a, b in pairs]
    assert simhash.joined(n, made).tolist() == [min(reach[i]) for i in range(n)]
