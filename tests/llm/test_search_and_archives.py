"""Exact search against brute force; archives by exact round trip."""

import hashlib
import io
import math
import random

import numpy as np
import pytest


def test_maxscore_is_exact(spark):
    from factorloom.llm.topk import top_k

    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) if j % 3 else rng.choice([0.0, 0.25]) for j in range(12)], 0) for i in range(500)]
    rows += [(500 + i, rows[50][1], 0) for i in range(30)]  # ties
    rows += [(900, None, 0), (901, [0.1] * 11 + [None], 0), (902, [float("nan")] * 12, 0), (903, [math.inf] + [0.0] * 11, 0), (950, [0.5, 0.5], 0), (None, [0.1] * 12, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for shard, block in ((60, 400), (100_000, 1 << 20)):
        found = top_k(vectors, vectors.where("vec_id % 50 = 0"), batch_rows=shard, block_bytes=block).collect()
        got[shard] = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 50 == 0:
            scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got[60] == got[100_000] == sorted(want)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_scores_of_large_components_and_repeated_queries(spark):
    from factorloom.llm.topk import top_k

    rng = random.Random(4)
    rows = [(i, [rng.choice([1e30, -1e30, 3.0, 1e12, -1e12]) for _ in range(3)]) for i in range(30)]
    rows += [(100, [1.0, 2.0, 3.0]), (100, [-1.0, 0.0, 5.0]), (100, [1.0, 2.0, 3.0]), (7, [1e308, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    quantised = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    want = []
    for q, v in {(q, tuple(v)) for q, v in quantised if q % 50 == 0}:
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), sum(a * b for a, b in zip(v, w)), i) for i, w in quantised if i != q]
        best = sorted(scores, key=lambda x: (-x[1], x[2]))[:5]
        want += [(q, s) for s, _, _ in best]
    for batch in (3, 1000):
        found = top_k(vectors, vectors.where("vec_id % 50 = 0"), batch_rows=batch).collect()
        assert sorted((r["query_id"], r["score"]) for r in found) == sorted(want)
        assert sorted(r["rank"] for r in found) == sorted([1, 2, 3, 4, 5] * 3)


def test_warc_round_trip(spark):
    from factorloom.llm.warc import archive

    rng = random.Random(2)
    page = lambda n: "<p>" + "".join(rng.choice("abc é\r\n") for _ in range(n))
    big = page(3000)
    rows = [(i, f"http://x/{i}", page(rng.randrange(0, 400))) for i in range(40)]
    rows += [(100, "u", big), (101, None, big), (99, "u\r\nv", big), (200, "u", None), (201, "u", ""), (202, "u", "tiny"), (203, "u", "tiny"), (300, "u", page(300_000)), (None, "u", big), (400, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.selectExpr("*", "1 as id", "'x' as first", "'y' as payload_digest")  # names that the operator uses itself
    back, index = archive(pages)
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in back.collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "") == (html or "")), default=None)
        again = len(data) >= 100 and i is not None and first != i
        want.append((i is None, i or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda x: x[:2])
    assert index.count() == len(rows)
    assert archive(pages.limit(0))[0].count() == 0


def test_bundle_frames_are_independent():
    from factorloom.llm.warc import Bundle, frame, parsed, record, seek_table

    out = io.BytesIO()
    bundle = Bundle(out, frame_bytes=500)
    where = {i: bundle.add(record("response", i, "http://x", b"z" * (i * 37 % 300), "d" * 64)) for i in range(30)}
    bundle.close()
    table = seek_table(out, len(out.getvalue()))
    assert len(table) > 5
    for i in random.Random(1).sample(range(30), 30):
        f, at = where[i]
        head, body, _ = parsed(frame(out, table[f]), at)
        assert head["WARC-Record-ID"] == f"<urn:page:{i}>" and body.endswith(b"z" * (i * 37 % 300))


def test_signature_tree_loses_no_pair():
    from factorloom.llm.jaccard import bitmap, cell_pairs

    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, rng.integers(20, 200)).astype(np.uint64) for _ in range(8)]
    sets = []
    for b in base:
        for _ in range(25):
            keep = rng.random(len(b)) > rng.choice([0.02, 0.05, 0.2])
            sets.append(np.unique(b[keep]))
    key, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    comp = rng.integers(0, 40, len(sets))
    packed = [np.packbits(bitmap(s)).tobytes() for s in sets]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 100 * common >= 85 * (n[i] + n[j] - common):
                want.add((j, i))
    assert want
    one = set(cell_pairs(key, n, comp, np.zeros(len(sets), int), packed, 85))
    assert want <= one and len(one) < len(sets) ** 2 / 6
    block = key % 2
    parts = set()
    for a, b in ((0, 0), (0, 1), (1, 1)):
        m = np.isin(block, [a, b])
        parts |= set(cell_pairs(key[m], n[m], comp[m], block[m], [p for p, x in zip(packed, m) if x], 85))
    assert want <= parts


@pytest.mark.parametrize("k", [1, 2, 3, 7, 50])
def test_rolling_hashes_tell_runs_apart(k):
    from factorloom.llm.common import rolling

    h = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    h[200:300] = h[50:150]
    r = rolling(h, k)
    assert len(r) == 400 - k + 1
    assert np.array_equal(r[200 : 301 - k], r[50 : 151 - k])
    assert len(np.unique(r)) == len(r) - (101 - k)
    assert len(rolling(h[: k - 1], k)) == 0
