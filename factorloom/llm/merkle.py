"""Merkle manifest of a dataset: ternary hash trees per source, reduced from fragments, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import saved

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[bytes]) -> bytes:
    """Lower-case hex SHA-256 of digests, themselves hex text, put together."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    return -(-n // ARITY**level)


def depth(n: int) -> int:
    """The level of the root of n leaves."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def levels(nodes: list[bytes], count: int) -> list[list[bytes]]:
    """The nodes and their ancestors, ``count`` levels up; the first node begins a run at each of them."""
    out = [nodes]
    for _ in range(count):
        below = out[-1]
        out.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


class Forest:
    """Fragments of trees, a commutative monoid: nodes that wait for siblings, by (tree, level, index), and the runs that are complete.

    A tree's number of leaves tells the arity of each run beforehand, so a run is hashed as soon as its last
    sibling is there, in whatever order fragments meet; the empty forest is neutral.  ``runs`` has the members of
    completed runs by (tree, level, parent's index), from which proofs are read.
    """

    def __init__(self):
        self.waiting: dict[tuple, bytes] = {}
        self.runs: dict[tuple, list[bytes]] = {}
        self.leaves: dict = {}

    def add(self, tree, n: int, level: int, index: int, node: bytes) -> Forest:
        self.leaves[tree] = n
        self.waiting[tree, level, index] = node
        while (wide := width(n, level)) > 1:
            parent = index // ARITY
            keys = [(tree, level, i) for i in range(ARITY * parent, min(ARITY * parent + ARITY, wide))]
            if any(k not in self.waiting for k in keys):
                break
            run = self.runs[tree, level, parent] = [self.waiting.pop(k) for k in keys]
            level, index = level + 1, parent
            self.waiting[tree, level, index] = digest(run)
        return self

    def merge(self, other: Forest) -> Forest:
        self.runs |= other.runs
        for (tree, level, index), node in other.waiting.items():
            self.add(tree, other.leaves[tree], level, index, node)
        return self

    def roots(self) -> dict:
        return {tree: node for (tree, level, _), node in self.waiting.items() if width(self.leaves[tree], level) == 1}

    def above(self, tree, level: int, index: int) -> list[tuple[bytes, bytes]]:
        """The siblings left and right of a node and of each of its ancestors, as far as this forest holds their runs."""
        out = []
        while (run := self.runs.get((tree, level, index // ARITY))) is not None:
            at = index % ARITY
            out.append((b"".join(run[:at]), b"".join(run[at + 1 :])))
            level, index = level + 1, index // ARITY
        return out


def numbered(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``rows``, a saved table with a column ``tree``, with the place ``idx`` of each in its tree and the tree's size ``n``.

    A range sort deals a large tree to many tasks; only the counts of (tree, task) are summed in windows, at most one a task and tree.
    """
    keys = [F.asc_nulls_first("tree"), *[F.asc_nulls_first(c) for c in order]]
    ordered = saved(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "merkle-ordered")
    tree = Window.partitionBy("tree")
    counts = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved(counts.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), before.alias("_start"), F.sum("m").over(tree).alias("n")), "merkle-starts")
    joined = ordered.join(starts, (F.col("part") == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree")))
    place = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*keys[1:]))
    return saved(joined.withColumn("idx", F.col("_start") + place - 1).drop("_tree", "_part", "_start", "part"), "merkle-numbered")


def cut(batches: Iterator[pa.RecordBatch], first) -> Iterator[pa.Table]:
    """The rows of each block, whose first row ``first(idx)`` tells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = np.flatnonzero(first(batch.column("idx").to_numpy())).tolist()
        for i, (a, b) in enumerate(zip([0, *at], [*at, batch.num_rows], strict=True)):
            if i and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def hexed(column) -> list[bytes | None]:
    return [x and x.hex().encode() for x in column.to_pylist()]


def climbed(rows: DataFrame, order: list[str], finish) -> DataFrame:
    """What ``finish(numbered, tops, forest, roots, height)`` makes of the trees of ``rows``.

    Trees are cut into blocks of ``3**height`` leaves, between 4 and 12 for each shuffle partition and as many more as there
    are trees.  A block is hashed in one task up to its top, ``tops``.  Tops of trees of several blocks are
    fragments of a forest that ``treeReduce`` merges: at most 18 nodes for each shuffle partition, however long the input.
    ``roots``, (tree, root), is a table.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, height = rows.count(), 4
    while ARITY ** (height + 1) <= total // (4 * parts):
        height += 1
    size = ARITY**height
    table = numbered(rows, order, parts)
    kind = table.schema["tree"].dataType.simpleString()

    def top(batches):
        for block in cut(batches, lambda idx: idx % size == 0):
            n, idx = block.column("n")[0].as_py(), block.column("idx")[0].as_py()
            level = min(height, depth(n))
            node = levels(hexed(block.column("leaf")), level)[-1][0]
            yield pa.RecordBatch.from_arrays([block.column("tree").combine_chunks().slice(0, 1), *[pa.array([x], t) for x, t in ((n, pa.int64()), (level, pa.int64()), (idx // size, pa.int64()), (node.decode(), pa.string()))]], names=["tree", "n", "level", "block", "node"])

    block = F.floor(F.col("idx") / size).alias("block")
    dealt = table.select("tree", "idx", "n", "leaf", block).repartition("tree", "block").sortWithinPartitions(F.asc_nulls_first("tree"), "idx").drop("block")
    tops = saved(dealt.mapInArrow(top, f"tree {kind}, n long, level long, block long, node string"), "merkle-tops")
    large = tops.where(F.col("n") > size)
    forest = Forest()
    if not large.isEmpty():
        fragments = large.rdd.mapPartitions(lambda found: [_fragment(found)])
        forest = fragments.treeReduce(Forest.merge)
    roots = tops.where(F.col("n") <= size).select("tree", F.col("node").alias("root"))
    if forest.leaves:
        roots = roots.union(spark.createDataFrame([(tree, node.decode()) for tree, node in forest.roots().items()], f"tree {kind}, root string"))
    return finish(table, tops, forest, roots, height)


def _fragment(rows) -> Forest:
    out = Forest()
    for r in rows:
        out.add(r["tree"], r["n"], r["level"], r["block"], r["node"].encode())
    return out


def proofs(table: DataFrame, heads: DataFrame, forest: Forest, height: int, steps: bool) -> DataFrame:
    """Each row of ``table`` with ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and, for ``steps``, its siblings ``lefts`` and ``rights``.

    ``heads``: for every (tree, block) the siblings ``lefts`` and ``rights`` beyond the tree, and the root.  A task holds one block.
    Every row's own leaf, or its tampered one, is folded with its siblings up to ``folded_root``; the root is never taken instead.
    """
    size = ARITY**height
    names = [c for c in table.columns if c not in ("idx", "n", "tree", "leaf", "bad")]
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    head = heads.select("tree", F.lit(-1).cast("long").alias("idx"), "block", F.col("lefts"), F.col("rights"), "root")
    rows = table.withColumn("block", F.floor(F.col("idx") / size)).unionByName(head, allowMissingColumns=True)
    rows = rows.repartition("tree", "block").sortWithinPartitions(F.asc_nulls_first("tree"), "block", "idx")
    known = table.sparkSession.sparkContext.broadcast(forest)

    def walk(batches):
        for block in cut(batches, lambda idx: idx < 0):
            beyond = [(a.encode(), b.encode()) for a, b in zip(block.column("lefts")[0].as_py(), block.column("rights")[0].as_py(), strict=True)]
            root = block.column("root")[0].as_py().encode()
            at, tree = block.column("block")[0].as_py(), block.column("tree")[0].as_py()
            body = block.slice(1)
            n = body.column("n")[0].as_py()
            leaves, bad = hexed(body.column("leaf")), hexed(body.column("bad"))
            tiers = levels(leaves, min(height, depth(n)))
            above = known.value.above(tree, height, at)
            subroot = tiers[-1][0]
            for left, right in above:
                subroot = digest((left, subroot, right))
            shared = above + beyond
            out = [[], [], [], []]
            for i in range(0, len(leaves), ARITY):  # a run of leaves shares what is above it
                upper, index = [], i // ARITY
                for tier in tiers[1:-1]:
                    start, spot = index - index % ARITY, index % ARITY
                    upper.append((b"".join(tier[start : start + spot]), b"".join(tier[start + spot + 1 : start + ARITY])))
                    index //= ARITY
                upper += shared
                tail = b"".join(x for pair in upper for x in pair)
                run = leaves[i : i + ARITY]
                for j in range(len(run)):
                    own = [(b"".join(run[:j]), b"".join(run[j + 1 :]))] if len(tiers) > 1 else []
                    out[0].append(hashlib.sha256(own[0][0] + own[0][1] + tail if own else tail).hexdigest())
                    fold = run[j] if bad[i + j] is None else bad[i + j]
                    for left, right in own + upper:
                        fold = digest((left, fold, right))
                    out[1].append(fold.decode())
                    if steps:
                        out[2].append([x.decode() for x, _ in own + upper])
                        out[3].append([x.decode() for _, x in own + upper])
            m = len(leaves)
            made = [pa.array([x.decode() for x in leaves]), pa.array([subroot.decode()] * m), pa.array([root.decode()] * m), pa.array(out[0]), pa.array(out[1])]
            made += [pa.array(x, pa.list_(pa.string())) for x in out[2:]] if steps else []
            yield from pa.Table.from_arrays([*[body.column(c) for c in names], body.column("tree"), *made], names=[*names, "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["lefts", "rights"] if steps else [])]).combine_chunks().to_batches()

    more = ", lefts array<string>, rights array<string>" if steps else ""
    return rows.mapInArrow(walk, ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "tree"]) + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string" + more)


def field(column: Column) -> Column:
    """A value for hashing: its UTF-8 length, a colon and itself; ``-`` if null."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", tampered: dict[str, Column] | None = None, steps: bool = False) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row, ``lefts`` and ``rights`` of its proof for ``steps``.

    A row's leaf hashes its ``fields``.  Leaves of one ``tree_col`` ascend by id and are hashed three by three to the
    subroot; the subroots, in order of their tree, likewise to the root.  A proof has the siblings of a leaf, then of each
    ancestor.  ``tampered`` has other values for some of the fields, as expressions of the table; ``folded_root`` is what such a leaf and
    the siblings of the untampered trees lead to, and ``verified`` tells whether that is the root.

    Range-sorted rows are numbered without a window over a whole tree, so a tree may hold most rows.  A null tree is one of its own and comes first, as
    do null ids; rows of equal ids follow by leaf; repeated rows are leaves of their own.  Empty and very long
    texts are hashed like any other, on the JVM.  Other columns are ignored, an empty table gives no rows.
    """
    tampered = tampered or {}
    of = lambda c: F.col(f"`{c}`")
    good = leaf([of(c) for c in fields])
    changed = [~tampered[c].eqNullSafe(of(c)) for c in fields if c in tampered]
    bad = F.lit(None).cast("binary")
    if changed:
        differs = changed[0]
        for more in changed[1:]:
            differs = differs | more
        bad = F.when(differs, leaf([tampered.get(c, of(c)) for c in fields]))
    rows = saved(docs.select(of(tree_col).alias("tree"), of(id_col).alias("id"), good.alias("leaf"), bad.alias("bad")), "merkle-leaves")
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # deals out repeated rows

    def finish(table, tops, forest, roots, height):
        def upper(sources, tops_above, forest_above, roots_above, height_above):
            none = F.array().cast("array<string>")
            heads = tops_above.select("tree", "block").join(roots_above, "tree").select("tree", "block", none.alias("lefts"), none.alias("rights"), "root")
            return proofs(sources, heads, forest_above, height_above, True)

        sources = saved(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("leaf"), F.lit(None).cast("binary").alias("bad")), "merkle-subroots")
        beyond = saved(climbed(sources, ["name"], upper).select("name", "lefts", "rights", "root"), "merkle-sources")
        heads = tops.select("tree", "block").join(beyond, F.col("tree").eqNullSafe(F.col("name"))).drop("name")
        return proofs(table.drop("salt"), heads, forest, height, steps)

    found = climbed(rows, ["id", "leaf", "salt"], finish)
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["lefts", "rights"] if steps else []))


def stripped_of_newlines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The tampering of the query: rows whose id has an even CRC-32 lose the line feeds of their text."""
    chosen = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0
    text = F.col(f"`{text_col}`")
    return {text_col: F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)}
