"""The thin ``opN_*`` queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import read, saved


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.toxicity import held_out_scores

    return held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.topk import top_k

    vectors = read(spark, sf_dir, "embeddings")
    found = top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), F.col("score").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (doc_id, item_id) pairs of documents that hold an item."""
    from factorloom.llm.decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.warc import archive

    return archive(read(spark, sf_dir, "pages"))[0]


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole training order, range-sorted by position; the rows are read from it, each document's first one."""
    from factorloom.llm.mixing import in_training_order, mix

    order = saved(in_training_order(mix(read(spark, sf_dir, "documents")), untaken=True), "training-order")
    return order.where("pass <= 1").select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.substrings import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factorloom.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.language import held_out_languages

    return held_out_languages(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(read(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.merkle import manifest, stripped_of_newlines

    docs = read(spark, sf_dir, "documents")
    return manifest(docs, tampered=stripped_of_newlines(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorloom.llm.conversations import damaged, repaired

    return repaired(damaged(read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


ORACLE: dict[str, str] = {
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
             w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
             f AS (SELECT key, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
             g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM w JOIN f USING (key) WHERE doc_id > first),
             p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM d),
             k AS (SELECT p.doc_id, count(*) AS n_words, count(g.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.place) FILTER (g.place IS NULL), '') AS kept
                   FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY 1)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
             f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM l WHERE regexp_matches(line, '[^\s]')),
             w AS (SELECT a.doc_id, a.i, a.place AS p1, b.place AS p2, a.line || chr(10) || b.line AS key FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
             r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM w),
             g AS (SELECT doc_id, p1 AS place FROM r WHERE n > 1 UNION SELECT doc_id, p2 FROM r WHERE n > 1),
             k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '') AS kept
                   FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY 1)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)""",
    "op5_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
             b AS (SELECT *, (('0x' || substr(key, 1, 6))::BIGINT) % 4096 AS bucket FROM d),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
             w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
             c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
             l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
             t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, cap)) AS target FROM l),
             o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b)
        SELECT doc_id, size, source_size, target,
               greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size)) AS taken
        FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
}

#: CRC-32 of a column's text, bit by bit: DuckDB has no such function.
CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split({text}, '')])::BIGINT[]),
              lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"""



def field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode({name}::VARCHAR)) || ':' || {name} END"


ORACLE["op11_merkle_manifest"] = f"""
        WITH RECURSIVE c AS (SELECT *, {CRC32.format(text="doc_id::VARCHAR")} AS crc FROM documents),
             v AS (SELECT doc_id, source, {field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} AS head, {field('text')} AS body,
                          CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM c),
             l AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || {field('other')}) AS bad FROM v),
             b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
             t AS (SELECT source, 0 AS lvl, idx, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM b
                   UNION ALL SELECT source, lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY source, lvl, idx // 3),
             s AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM t WHERE n = 1),
             u AS (SELECT 0 AS lvl, idx, subroot AS d, count(*) OVER () AS n FROM s
                   UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY lvl, idx // 3),
             a AS (SELECT t.*, s.idx AS place FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source),
             g AS (SELECT x.source, x.lvl, x.idx, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lo, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS hi
                   FROM a x JOIN a y ON x.place = y.place AND x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2, 3, x.place),
             h AS (SELECT x.lvl, x.idx, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lo, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS hi
                   FROM u x JOIN u y ON x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2),
             f AS (SELECT b.doc_id, b.source, b.leaf, 0 AS lvl, b.idx, b.bad AS d, '' AS proof FROM b
                   UNION ALL SELECT f.doc_id, f.source, f.leaf, f.lvl + 1, f.idx // 3, sha256(g.lo || f.d || g.hi), f.proof || g.lo || g.hi
                   FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source AND f.lvl = g.lvl AND f.idx = g.idx),
             m AS (SELECT f.doc_id, f.source, f.leaf, s.subroot, s.idx, f.d, f.proof FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
                   WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source IS NOT DISTINCT FROM f.source AND g.lvl = f.lvl AND g.idx = f.idx)),
             w AS (SELECT doc_id, leaf, subroot, 0 AS lvl, idx, d, proof FROM m
                   UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.idx // 3, sha256(h.lo || w.d || h.hi), w.proof || h.lo || h.hi FROM w JOIN h ON w.lvl = h.lvl AND w.idx = h.idx),
             r AS (SELECT d AS root FROM u WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
        FROM w, r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lvl = w.lvl AND h.idx = w.idx)"""


def path(p: str, cost: str, label: str = "''", row: str = "''") -> str:
    return f"{{'c': {p}.c + {cost}, 'l': {p}.l || {label}, 'r': {p}.r || {row}}}"


def least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


USER, ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
NO_PATH = "{'c': 1000000000::BIGINT, 'l': '', 'r': ''}"


def put_in(table: str) -> str:
    """Two steps of insertions: what leads to U, then to A."""
    user = least("p2", *[path(p, "5", "'I'", USER) for p in ("p0", "p1", "p3")])
    return f"(SELECT *, {least('p3', path('q2', '5', chr(39) + 'I' + chr(39), ASSISTANT))} AS q3 FROM (SELECT *, {user} AS q2 FROM {table}))"


def moved(state: str, *to: tuple[str, str, str]) -> str:
    """The least path into a state after one row: deleted, or from other states kept or given another role."""
    kept = [f"CASE WHEN must THEN {NO_PATH} WHEN i = '{c}' THEN {path(p, 'more', chr(39) + 'K' + chr(39), 'chr(10) || role || chr(58) || text')} ELSE " + (NO_PATH if c == "s" else path(p, "more + 1", "'R'", f"{role} || text")) + " END" for p, c, role in to]
    return least(path(state, "2", "'D'"), *kept)


ORACLE["op13_conversation_repair"] = rf"""
        WITH RECURSIVE c AS (SELECT *, {CRC32.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS x FROM conversations),
             d AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
                          unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
             o AS (SELECT *, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
             f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS two FROM o),
             g AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM f),
             v AS (SELECT DISTINCT conv_id FROM conversations),
             r AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'l': '', 'r': ''}} AS p0, {NO_PATH} AS p1, {NO_PATH} AS p2, {NO_PATH} AS p3 FROM v
                   UNION ALL SELECT k.conv_id, g.n, {path("p0", "2", "'D'")}, {moved("p1", ("p0", "s", ""))}, {moved("q2", ("p0", "u", USER), ("p1", "u", USER), ("q3", "u", USER))}, {moved("q3", ("q2", "a", ASSISTANT))}
                   FROM {put_in("r")} k JOIN g ON k.conv_id IS NOT DISTINCT FROM g.conv_id AND g.n = k.n + 1),
             e AS (SELECT conv_id, {least("p0", "q3")} AS p FROM {put_in("(SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY conv_id))")}),
             s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               p.c AS cost, p.l AS audit, sha256(substr(p.r, 2)) AS repaired_sha256
        FROM e LEFT JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id"""
