"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by BK-trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import join_by_frequency, saved, slices
from factorloom.llm.jaccard import LOWER, components

BITS, SEED = 64, 42


def fingerprint(text: str | None, k: int = 3) -> int:
    """The majority of each bit over the XXH64 hashes of all k-word shingles; zero without words.  Long texts are counted in pieces."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not parts:
        return 0
    n, hashed = max(1, len(parts) - k + 1), xxhash.xxh64_intdigest
    if len(parts) <= k:
        return hashed(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[: n - 1] + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 15):
        j = min(n, i + (1 << 15))
        h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist(), strict=True)), "<u8", j - i)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class Trees:
    """BK-trees of several groups in one table: a node's child at each Hamming distance to it.

    ``fp``: the nodes' fingerprints, those of a group distinct; ``root``: for each the first node of its group.  All trees are
    grown at once, level by level: of the nodes that come down one edge the first becomes the child, the others go on from there.
    """

    def __init__(self, fp: np.ndarray, root: np.ndarray, radius: int):
        self.fp, self.radius, self.wide = fp, radius, BITS + 1 + 2 * radius
        self.child = np.full(len(fp) * self.wide, -1, np.int32)
        self.parent, self.edge = np.full(len(fp), -1, np.int32), np.zeros(len(fp), np.uint8)
        going = np.flatnonzero(root != np.arange(len(fp)))
        at = root[going]
        while len(going):
            away = np.bitwise_count(fp[going] ^ fp[at])
            slot = at * self.wide + away + radius
            first = np.unique(slot, return_index=True)[1]
            self.child[slot[first]] = going[first]
            self.parent[going[first]], self.edge[going[first]] = at[first], away[first]
            at = self.child[slot].astype(np.int64)
            on = at != going
            going, at = going[on], at[on]

    def packed(self, start: int, stop: int) -> bytes:
        """One group's tree: fingerprints, parents and the distances to them."""
        parent = np.where(self.parent[start:stop] < 0, -1, self.parent[start:stop] - start).astype(np.int32)
        return self.fp[start:stop].tobytes() + parent.tobytes() + self.edge[start:stop].tobytes()

    @classmethod
    def unpacked(cls, data: bytes, radius: int) -> Trees:
        n = len(data) // 13
        out = cls.__new__(cls)
        out.fp, out.radius, out.wide = np.frombuffer(data, np.uint64, n), radius, BITS + 1 + 2 * radius
        out.parent, out.edge = np.frombuffer(data, np.int32, n, 8 * n), np.frombuffer(data, np.uint8, n, 12 * n)
        out.child = np.full(n * out.wide, -1, np.int32)
        below = np.flatnonzero(out.parent >= 0)
        out.child[out.parent[below].astype(np.int64) * out.wide + out.edge[below] + radius] = below
        return out

    def within(self, queries: np.ndarray, root: np.ndarray, size: np.ndarray, most: int = 1 << 20):
        """(query, node) pairs within the radius: from each node only edges whose distance differs from the query's by the radius at most are followed.

        ``size``: of each query's tree; queries go in blocks that can't visit more than about ``most`` nodes at once.
        """
        edges = np.arange(2 * self.radius + 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for block in np.split(np.arange(len(queries)), cuts):
            q, node = block, root[block]
            while len(q):
                away = np.bitwise_count(queries[q] ^ self.fp[node]).astype(np.int64)
                near = away <= self.radius
                yield q[near], node[near]
                down = self.child[(node * self.wide + away)[:, None] + edges]
                i, j = np.nonzero(down >= 0)
                q, node = q[i], down[i, j].astype(np.int64)


def joined(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest one that it is connected with by the pairs."""
    label = np.arange(n)
    held = [np.stack(p) for p in pairs]
    u, v = np.concatenate(held, axis=1) if held else (label[:0], label[:0])
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fingerprints(docs: DataFrame, k: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row, the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def of(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                fp = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, fp long")


def banded(fps: DataFrame, radius: int) -> DataFrame:
    """``(pair, key, fp)``: the fingerprint with all but two of its ``radius + 2`` bands blanked, for each two.

    Fingerprints within the radius differ in ``radius`` bands at most, so two bands at least are the same in both.
    """
    bands = radius + 2
    ends = [BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(bands)]
    both = [x - (1 << BITS) if x >> (BITS - 1) else x for x in (masks[i] | masks[j] for i, j in combinations(range(bands), 2))]
    keys = [F.struct(F.lit(p).alias("pair"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for p, m in enumerate(both)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "fp")


def tree_links(groups: DataFrame, radius: int) -> DataFrame:
    """``(a, b, pair, key, chunk, tree)`` from ``(pair, key, chunk, n, m, fp)``: links that connect what trees connect, then each tree of a split group.

    Each (pair, key, chunk) has a tree, in which its members look for each other.
    A task holds some ten thousand members at a time, and links each to the first of its component within the chunk, not to all.
    """
    dealt = groups.repartition("pair", "key", "chunk").sortWithinPartitions("pair", "key", "chunk")

    def link(batches):
        def told(t: pa.Table):
            at = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("pair", "key", "chunk")])
            first = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(0)))
            size = np.diff(np.append(first, t.num_rows))
            root, sizes = np.repeat(first, size), np.repeat(size, size)
            fp = t.column("fp").to_numpy().view(np.uint64)
            trees = Trees(fp, root, radius)
            label = joined(len(fp), ((q[q > x], x[q > x]) for q, x in trees.within(fp, root, sizes)))
            on = np.flatnonzero(label != np.arange(len(fp)))
            n = len(on)
            rows = [pa.array(fp[on].view(np.int64)), pa.array(fp[label[on]].view(np.int64)), *[pa.nulls(n, x) for x in (pa.int32(), pa.int64(), pa.int32(), pa.binary())]]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            split = t.column("chunks").to_numpy()[first] > 1
            for i, m in zip(first[split].tolist(), size[split].tolist(), strict=True):
                rows = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(at[0, i])], pa.int32()), pa.array([int(at[1, i])]), pa.array([int(at[2, i])], pa.int32()), pa.array([trees.packed(i, i + m)])]
                yield pa.RecordBatch.from_arrays(rows, names=names)

        names = ["a", "b", "pair", "key", "chunk", "tree"]
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 32_768:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("pair", "key", "chunk")])
            last = np.flatnonzero((at != at[:, -1:]).any(0))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if whole:
                yield from told(t.slice(0, whole).combine_chunks())
            held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield from told(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(link, "a long, b long, pair int, key long, chunk int, tree binary")


def links_across(trees: DataFrame, radius: int, most_bytes: int = 32 << 20) -> DataFrame:
    """``(a, b)`` between the chunks of split groups: each chunk's members look in the trees of all chunks before it.

    The trees are broadcast where they have at most ``most_bytes``, which is summed first, else joined by a shuffle; a cell has one tree and one chunk.
    """
    size = trees.agg(F.sum(F.octet_length("tree"))).first()[0] or 0
    side = F.broadcast if size <= most_bytes else lambda df: df
    cells = trees.where("chunk > 0").select("pair", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("other")).repartition("pair", "key", "chunk", "other")
    rows = cells.join(side(trees.select("pair", "key", "chunk", F.col("tree").alias("mine"))), ["pair", "key", "chunk"]).join(side(trees.select("pair", "key", F.col("chunk").alias("other"), "tree")), ["pair", "key", "other"]).select("mine", "tree")

    def look(batches):
        for batch in batches:
            for mine, tree in zip(batch.column("mine"), batch.column("tree"), strict=True):
                tree, mine = Trees.unpacked(tree.as_py(), radius), mine.as_py()
                fp = np.frombuffer(mine, np.uint64, len(mine) // 13)
                n, m = len(tree.fp), len(fp)
                label = joined(n + m, ((x, q + n) for q, x in tree.within(fp, np.zeros(m, np.int64), np.full(m, n))))
                every = np.concatenate([tree.fp, fp])
                on = np.flatnonzero(label != np.arange(n + m))
                yield pa.RecordBatch.from_arrays([pa.array(every[on].view(np.int64)), pa.array(every[label[on]].view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(look, "a long, b long")


def simhash_components(docs: DataFrame, *, k: int = 3, radius: int = 2, most_nodes: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)``: connected components of documents whose fingerprints differ in ``radius`` bits or fewer.

    1. Equal fingerprints are one from here on.  Each is dealt by every two of its ``radius + 2`` bands (16 bits each for two), of which any
       two within the radius share one; keys of a single fingerprint go.
    2. A key's fingerprints make a BK-tree, children keyed by their Hamming distance to the parent, in which each
       looks for its neighbours.  A key of more than ``most_nodes`` is split into chunks with a tree each, and the packed trees
       are broadcast (by size, see ``links_across``) to the cells in which other chunks look through them.
    3. Trees give links that connect what they have found, not all pairs; components follow from these by large-star and small-star steps.
    No link is lost, and neither copies nor a hot key are ever in one task.

    A null text, and one without words, has fingerprint zero and is linked like any other; fewer words than ``k`` are one
    shingle.  A null id keeps its fingerprint, is in no component (null) and links nothing.  Rows of one id are documents of their own that share a name.
    Other columns are ignored; an empty table gives no rows; long texts are hashed piece by piece.
    """
    rows = saved(fingerprints(docs, k, id_col=id_col, text_col=text_col), "fingerprints")
    reps = saved(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    keyed = banded(reps.select("fp"), radius)
    shared = keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = join_by_frequency(keyed, saved(shared, "shared-bands"), ["pair", "key"]).withColumn("chunks", F.ceil(F.col("n") / most_nodes).cast("int"))
    near = near.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    found = saved(tree_links(near.select("pair", "key", "chunk", "chunks", "fp"), radius), "simhash-links")
    trees = found.where("tree is not null").select("pair", "key", "chunk", "tree")
    links = saved(found.where("tree is null").select("a", "b").union(links_across(trees, radius)).distinct(), "links")
    named = reps.join(components(links), F.col("fp") == F.col("key"), "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_fp = saved(named.select("fp", "n", "root").join(names, "root").select("fp", "n", "component_id"), "components")
    out = join_by_frequency(rows.where("id is not null"), of_fp, ["fp"]).select("id", "fp", "component_id")
    out = out.unionByName(rows.where("id is null"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
