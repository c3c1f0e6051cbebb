"""N-gram Jaccard join: prefix blocks, signature trees inside them, exact verification, components."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WordHashes, delete, discard, i64, new_path, rolling, saved, slices

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HEAVY_BITS = 23
BLOCK, LEAF, FOLD = 512, 16, 4096


class Shingles:
    """Sets of distinct word k-grams as sorted 64-bit hashes; fewer words than k are one shingle."""

    def __init__(self, k: int):
        self.k, self.hashes = k, WordHashes(11)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else [] for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(parts)), np.uint64, int(sizes.sum()))
        grams = rolling(h, self.k)
        out, at = [], 0
        for n in sizes.tolist():
            if n >= self.k:
                out.append(np.unique(grams[at : at + n - self.k + 1]))
            else:
                out.append(rolling(h[at : at + n], n) if n else np.empty(0, np.uint64))
            at += n
        return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set of tokens, signed."""
    one = int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29)))) ^ int(s.sum(dtype=np.uint64)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return one - (1 << 64) if one >> 63 else one


def set_check(s: np.ndarray) -> int:
    """Another 64-bit hash of the set, signed: with the key it tells sets apart by 128 bits."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(s).tobytes(), 5) - (1 << 63)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit for each token's low bits, in the power of two from 4 times as many bits."""
    m = max(256, 1 << int(4 * len(tokens) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[tokens & np.uint64(m - 1)] = True
    return bits


def folded(bits: np.ndarray, m: int) -> np.ndarray:
    """The bitmap of m bits that the same tokens make."""
    return bits if len(bits) <= m else bits.reshape(-1, m).any(0)


class Tree:
    """Signature tree over documents in order of set size: nodes hold the OR of their bitmaps, a size range and slack.

    ``slack``: the most tokens of a member that share a bit with another of its own.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.bits, self.n, self.comp = bits, n, comp
        slack = n - bits.sum(1)
        self.rest = slack
        starts = np.arange(0, len(n), LEAF)
        level = [np.logical_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts), np.maximum.reduceat(slack, starts), np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)]
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), 4)
            level = [np.logical_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), *[np.maximum.reduceat(x, at) for x in level[2:4]], np.minimum.reduceat(level[4], at), np.maximum.reduceat(level[5], at)]
            self.levels.append(level)


def may_link(overlap: np.ndarray, rest_a, rest_b, a, b, percent: int):
    """Whether sets of these sizes, with so many common bits, can reach the similarity: overlap is at most common bits plus slack."""
    most = np.minimum(np.minimum(overlap + rest_a, overlap + rest_b), np.minimum(a, b))
    return (100 + percent) * most >= percent * (a + b)


def traverse(x: Tree, y: Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs of two trees that may link, from different components: node pairs that can't hold any are left at once."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    top = max(len(x.levels), len(y.levels)) - 1
    pairs = [(0, 0)]
    for depth in range(top, -1, -1):
        p, q = x.levels[min(depth, len(x.levels) - 1)], y.levels[min(depth, len(y.levels) - 1)]
        kept = []
        for i, j in pairs:
            low_a, high_a, low_b, high_b = p[1][i], p[2][i], q[1][j], q[2][j]
            if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
                continue  # sizes too far apart
            if p[4][i] == p[5][i] == q[4][j] == q[5][j]:
                continue  # one component already
            common = int((p[0][i] & q[0][j]).sum())
            most = min(high_a, high_b, common + p[3][i], common + q[3][j])
            if (100 + percent) * most < percent * (low_a + low_b):
                continue
            kept.append((i, j))
        if depth == 0:
            pairs = kept
            break
        below = lambda t, i: range(4 * i, min(4 * i + 4, len(t.levels[depth - 1][1]))) if depth < len(t.levels) else [i]
        pairs = [(a, b) for i, j in kept for a in below(x, i) for b in below(y, j) if not same or a <= b]
    for i, j in pairs:
        s, t = slice(LEAF * i, LEAF * i + LEAF), slice(LEAF * j, LEAF * j + LEAF)
        common = x.bits[s].astype(np.float32) @ y.bits[t].astype(np.float32).T
        a, b = x.n[s][:, None], y.n[t][None]
        ok = may_link(common, x.rest[s][:, None], y.rest[t][None], a, b, percent) & (x.comp[s][:, None] != y.comp[t][None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if same and i == j:
            ok = np.triu(ok, 1)
        u, v = np.nonzero(ok)
        found_a.append(u + LEAF * i)
        found_b.append(v + LEAF * j)
    return np.concatenate(found_a), np.concatenate(found_b)


def cell_pairs(key: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, packed: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Candidate pairs of a cell: members of one block with each other, or of two blocks across."""
    blocks = np.unique(block)
    bits = [np.unpackbits(np.frombuffer(p, np.uint8)).view(bool) for p in packed]
    width = np.array([len(b) for b in bits])
    trees, rows = {}, {}
    out = []

    def tree(b, m, at):
        if (b, m, at) not in trees:
            mine = np.flatnonzero((block == b) & (width == m))
            mine = mine[np.lexsort((key[mine], n[mine]))]
            rows[b, m, at] = mine
            trees[b, m, at] = Tree(np.stack([folded(bits[i], at) for i in mine]), n[mine], comp[mine])
        return trees[b, m, at], rows[b, m, at]

    sides = [(blocks[0], blocks[-1])] if len(blocks) > 1 else [(blocks[0], blocks[0])]
    for p, q in sides:
        mine, other = np.unique(width[block == p]), np.unique(width[block == q])
        for m in mine.tolist():
            for w in other.tolist():
                if max(m, w) > 2 * min(m, w) or (p == q and w < m):
                    continue  # sizes that differ so much can't link
                at = min(m, w)
                (x, i), (y, j) = tree(p, m, at), tree(q, w, at)
                a, b = traverse(x, y, percent, p == q and m == w)
                out += [(min(u, v), max(u, v)) for u, v in zip(key[i[a]].tolist(), key[j[b]].tolist(), strict=True)]
    return out


def sketches(docs: DataFrame, k: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """``(id, row, n, key, check, bits, prefix)`` of every document: set size, two hashes of the set, packed bitmap, and its prefix tokens.

    Two sets that link share a token of their prefixes, the first ``n - ceil(percent n) + 1`` in one global
    order: tokens whose bit in ``heavy`` is unset first, then by hash.
    """
    kind = dict(docs.dtypes)["id"]

    def cut(batches):
        shingles, seen = Shingles(k), set()
        late = np.unpackbits(heavy).view(bool)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                n, key, check, bits, prefix = [], [], [], [], []
                nulls = batch.column("id").is_null().to_pylist()
                for s, null in zip(shingles.sets(batch.column("text").to_pylist()), nulls, strict=True):
                    n.append(len(s))
                    if not len(s):
                        key.append(None)
                        check.append(None)
                        bits.append(None)
                        prefix.append(None)
                        continue
                    key.append(set_key(s))
                    check.append(set_check(s))
                    one = key[-1] << 64 | check[-1] + (1 << 63)
                    if null or one in seen:  # links nothing, or sent already from this task
                        bits.append(None)
                        prefix.append(None)
                        continue
                    if len(seen) < 200_000:
                        seen.add(one)
                    bits.append(np.packbits(bitmap(s)).tobytes())
                    most = len(s) - (percent * len(s) + 99) // 100 + 1
                    spot = late[(s >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)]
                    order = np.lexsort((s, spot))[:most]
                    prefix.append((s[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                lists = pa.array(prefix, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(bits, pa.binary()), lists], names=["id", "row", "n", "key", "check", "bits", "prefix"])

    return docs.mapInArrow(cut, f"id {kind}, row long, n long, key long, check long, bits binary, prefix array<int>")


def heavy_tokens(docs: DataFrame, k: int, least: int = 32, most: int = 1 << 20) -> np.ndarray:
    """A bitmap of 2**23 bits (1 MB at any input) with those of tokens that very many documents hold.

    It only orders tokens, so that common passages come last in prefixes; any bitmap gives the same links.
    Each task counts its own tokens and sends those it met 4 times at least.
    """

    def count(batches):
        shingles = Shingles(k)
        held, size = [], 0

        def tell():
            t = np.concatenate([*held, np.empty(0, np.uint64)])
            held.clear()
            t.sort()
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.empty(0, np.int64)
            t, c = t[first], np.diff(np.append(first, len(t)))
            keep = c >= 4
            return pa.RecordBatch.from_arrays([i64(t[keep]), pa.array(c[keep].astype(np.int64))], names=["token", "n"])

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                for s in shingles.sets(batch.column("text").to_pylist()):
                    held.append(s)
                    size += len(s)
                if size > 6_000_000:
                    yield tell()
                    size = 0
        yield tell()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    tokens = found.orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    bits = np.zeros(1 << HEAVY_BITS, bool)
    bits[(tokens >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def plausible(pairs: DataFrame, used, percent: int) -> DataFrame:
    """The ``(a, b)`` pairs whose whole bitmaps, ``used(pairs)``, allow the similarity."""
    bits = used(pairs)
    one, two = bits.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), bits.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    rows = pairs.join(one, "a").join(two, "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))

    def test(batches):
        for batch in batches:
            keep = []
            for r in batch.select(["n_a", "bits_a", "n_b", "bits_b"]).to_pylist():
                x, y = (np.unpackbits(np.frombuffer(r[c], np.uint8)).view(bool) for c in ("bits_a", "bits_b"))
                m = min(len(x), len(y))
                x, y = folded(x, m), folded(y, m)
                keep.append(bool(may_link(np.int64((x & y).sum()), r["n_a"] - int(x.sum()), r["n_b"] - int(y.sum()), r["n_a"], r["n_b"], percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, most_rows: int = 500_000) -> DataFrame:
    """The pairs whose sets, made again from the texts, have the similarity."""
    pairs = saved(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ids = saved(needed.join(reps.select("key", "id", "check"), "key"), "needed")
    small = ids.limit(most_rows + 1).count() <= most_rows
    side = ids.select("id", F.col("key").alias("want"), "check")
    rows = docs.join(F.broadcast(side) if small else side, "id").select("want", "check", "text")

    def sets(batches):
        shingles = Shingles(k)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = shingles.sets(batch.column("text").to_pylist())
                # rows of one id but other texts: the set of the wanted hash is the one that was sketched
                at = [i for i, (s, check) in enumerate(zip(found, batch.column("check").to_pylist(), strict=True)) if len(s) and set_check(s) == check]
                yield pa.RecordBatch.from_arrays([batch.column("want").take(pa.array(at, pa.int64())), pa.array([found[i].view(np.int64) for i in at], pa.list_(pa.int64()))], names=["key", "tokens"])

    # tables of their own on both sides of each join, so that Spark splits the pairs of a set that is in very many
    tokens = saved(rows.mapInArrow(sets, "key long, tokens array<long>").dropDuplicates(["key"]), "token-sets")
    one, two = tokens.select(F.col("key").alias("a"), F.col("tokens").alias("x")), tokens.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    links = saved(both.where(F.lit(100) * F.col("common") >= F.lit(percent) * union).select("a", "b"), "links")
    discard(pairs, ids, tokens)
    return links


def components(edges: DataFrame) -> DataFrame:
    """``(key, root)`` of every key in the ``(a, b)`` edges, root the smallest key it is connected with.

    Large-star and small-star steps until nothing changes; each is two aggregations and a join, and no
    component is ever in one place.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # a table of its own, so that Spark splits the edges of a hub in the join
        low = saved(e.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lows")
        out = e.join(low, "a")
        if large:
            out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).union(out.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    path, e, last = None, edges.where("a <> b").select("a", "b"), None
    while True:
        new = new_path(spark, "stars")
        star(star(e, True), False).write.parquet(new)
        if path:
            delete(spark, path)
        path, e = new, spark.read.schema("a long, b long").parquet(new)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("key"), F.col("b").alias("root")).union(e.select("b", F.col("b").alias("root"))).distinct()


def jaccard_components(docs: DataFrame, *, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)``: connected components of documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    1. Documents with equal sets are one from here on, by 128 bits of hashes.  Every set sends its prefix tokens.
    2. Within a token and size band all sets are compared with the one of the smallest id: whole-text bitmaps first, then
       the sets themselves.  This joins most copies of one text by a star, not by all pairs.
    3. What is left in tokens that still hold several components is dealt into cells of at most two blocks of about
       512 sets.  A signature tree in each finds pairs across components that may link; these are verified likewise.
    No link is lost: each linking pair shares a prefix token, and is in one component after (2) or a candidate in (3).

    A null text, or one without words, has an empty set and is linked with nothing.  A null id is kept,
    with its size, and is in no component (null).  Rows of one id are documents of their own, linked by their texts.
    Other columns are ignored; an empty table gives no rows.
    """
    out = with_components(docs, k, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def row_key(text: Column) -> Column:
    """Tells rows of one id but other texts apart."""
    return F.xxhash64(text)


def with_components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, n, component_id)`` of every row."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    heavy = heavy_tokens(docs, k)
    all_rows = saved(sketches(docs, k, percent, heavy), "sketches")
    # sets of one key but another check, which 64 bits let through now and then, take a key of their own
    alike = all_rows.where("key is not null").groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("key", "low")
    alike = saved(alike, "alike")
    if not alike.isEmpty():
        new = F.when(F.col("low").isNotNull() & (F.col("check") != F.col("low")), F.xxhash64("key", "check")).otherwise(F.col("key"))
        all_rows = saved(all_rows.join(alike, "key", "left").withColumn("key", new).drop("low"), "sketches")
    rows = all_rows.where("id is not null and key is not null")
    reps = saved(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("check").alias("check")), "reps")
    bits = rows.where("bits is not null").select("key", "n", "bits")
    # tokens of two sets or more
    tokens = rows.where("prefix is not null").select("key", F.explode("prefix").alias("token"))
    twice = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    members = tokens.join(twice, "token", "left_semi").distinct()
    members = saved(members.join(reps.select("key", "id", "n"), "key").withColumn("band", F.floor(F.log("n") / F.lit(-float(np.log(percent / 100)))).cast("int")), "members")
    used = lambda pairs: bits.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    # stars around the smallest id of each token and band, also from the next band
    hub = members.groupBy("token", "band").agg(F.min(F.struct("id", "key")).alias("hub"))
    hubs = hub.select("token", "band", F.col("hub.key").alias("b")).union(hub.select("token", F.col("band") + 1, F.col("hub.key")))
    stars = saved(ordered_pairs(members.select("token", "band", F.col("key").alias("a")).join(hubs, ["token", "band"])), "stars")
    links = verified(plausible(stars, used, percent), docs, reps, k, percent)
    roots = saved(components(links), "roots")
    # tokens that still hold several components
    placed = members.join(roots, "key", "left").select("token", "key", "n", F.coalesce("root", "key").alias("root"))
    open_tokens = placed.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high and m > 2").select("token", "m")
    rest = saved(placed.join(open_tokens, "token"), "rest")
    small = used(rest.select(F.col("key").alias("a")).distinct().select("a", F.col("a").alias("b")))
    more = saved(cells(rest, small, percent).distinct(), "candidates")
    links = links.union(verified(plausible(more.join(stars, ["a", "b"], "left_anti"), used, percent), docs, reps, k, percent))
    roots = saved(components(links), "roots")
    named = reps.select("key", "id").join(roots, "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_key = named.join(names, "root").select("key", "component_id")
    out = all_rows.select("id", "row", "n", "key").join(of_key, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "row", "n", component.alias("component_id"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cells(rest: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` across components from ``(token, key, n, root, m)``; cells of two blocks at most, whatever a token's group."""
    rows = rest.join(fold_bits(bits, FOLD).drop("n"), "key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tree_pairs(rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "n", "root", "block", "bits"), percent)


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of different roots that the trees of each cell ``(token, i, j)`` let through: within a block, or across where a cell has two."""
    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pair(batches):
        def tell(table: pa.Table):
            if table.num_rows < 2:
                return []
            block = table.column("block").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            if i != j and len(np.unique(block)) < 2:
                return []
            root = table.column("root").to_numpy()
            if (root == root[0]).all():
                return []
            return cell_pairs(table.column("key").to_numpy(), table.column("n").to_numpy(), root, block, table.column("bits").to_pylist(), percent)

        def out(found):
            found = list(set(found))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            at = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1 if at.shape[1] else np.empty(0, np.int64)
            edges = [0, *cuts.tolist()]
            found = []
            table = table.combine_chunks()
            for a, b in zip(edges, edges[1:], strict=False):
                found += tell(table.slice(a, b - a))
            held = table.slice(edges[-1])
            if found:
                yield out(found)
        if held is not None:
            yield out(tell(held))

    return dealt.mapInArrow(pair, "a long, b long")


def fold_bits(bits: DataFrame, most: int) -> DataFrame:
    """``(key, n, bits)`` with bitmaps of at most ``most`` bits, for the rows of cells."""

    def fold(batches):
        for batch in batches:
            packed = [np.packbits(folded(np.unpackbits(np.frombuffer(b, np.uint8)).view(bool), most)).tobytes() if len(b) > most // 8 else b for b in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(packed, pa.binary())], names=["key", "n", "bits"])

    return bits.select("key", "n", "bits").mapInArrow(fold, "key long, n long, bits binary")


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but the smallest id of each component, all columns as they are; those with a null id or without words stay.

    Rows of one id are judged each by its own text.
    """
    found = with_components(docs, k, percent, id_col, text_col)
    copies = found.where("id <> component_id").select(F.col("id").alias("_copy"), F.col("row").alias("_copy_row")).distinct()
    # all columns in one, so that names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), row_key(F.col(f"`{text_col}`")).alias("_row"))
    return rows.join(copies, (F.col("_id") == F.col("_copy")) & (F.col("_row") == F.col("_copy_row")), "left_anti").select("_doc.*")
