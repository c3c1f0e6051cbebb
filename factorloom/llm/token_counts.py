"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies; ids are never materialised."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import saved, slices, with_only

#: Longer pre-tokens are never broadcast, so ``most`` entries have a bound in bytes too: 44 each at most.
LONGEST = 32


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each pre-token of ``texts`` and the pre-token itself, a run of bytes between ASCII white space."""
    parts = pc.ascii_split_whitespace(texts)
    row, part = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(part), 0)
    return row.filter(some).to_numpy(), part.filter(some)


def distinct_parts(docs: DataFrame, text_col: str, held_bytes: int = 32 << 20) -> DataFrame:
    """``(part, seen)``: every distinct pre-token, and in how many slices of the texts it stands.

    A task counts what it meets and sends each pre-token once, or once for each ``held_bytes`` of distinct ones, so a word that is everywhere
    costs a row a task.
    """

    def found(batches):
        held, size = [], 0

        def tell():
            counts = pa.concat_arrays(held).value_counts() if held else pa.array([], pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["part", "seen"])

        for whole in batches:
            for batch in slices(whole, text_col, 8 << 20):
                part = pc.unique(pre_tokens(batch.column(text_col))[1])
                held.append(part)
                size += part.nbytes
                if size > held_bytes:
                    yield tell()
                    held, size = [], 0
        yield tell()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own, as tasks of few bytes are long here: encoding is what takes the time
    return with_only(docs, text_col).mapInArrow(found, "part string, seen long").repartition(n, "part").groupBy("part").agg(F.sum("seen").alias("seen"))


#: Ways to cut a text that never let a piece span or hold white space, as the library's files name them; fixed values.
CUTTING = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
SPACES = " \t\n\x0b\x0c\r"


def check_tokenizer(path: str) -> None:
    """Raises ValueError unless texts may be counted by pre-tokens: no piece spans white space, white space adds none, words don't change each other.

    The file must drop white space where it cuts texts, and its added tokens hold none; then words, marks and special strings of
    several scripts are encoded together and one by one, between each kind of white space.
    """
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    cut = config.get("pre_tokenizer") or {}
    first = (cut.get("pretokenizers") or [{}])[0] if cut.get("type") == "Sequence" else cut
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # a split that removes what its pattern does not match, where no part of the pattern matches white space
    matching = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not any(regex.search(pattern, f"a{s}b{s}{s}!") and any(c in SPACES for m in regex.finditer(pattern, f"a{s}b{s}{s}!{s}1") for c in m[0]) for s in SPACES)
    if first.get("type") not in CUTTING and not matching:
        raise ValueError(f"{path} doesn't cut texts at white space; its tokens can't be counted by words")
    if any(t.get("lstrip") or t.get("rstrip") or any(c in SPACES for c in t["content"]) for t in config.get("added_tokens", [])):
        raise ValueError(f"{path} has added tokens that take in white space")
    tokenizer = open_tokenizer(path)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False))
    parts = ["The", "don't", "naïve", "e\u0301", "\u0301x", "Σίσυφος", "мир", "你好", "x1234y", "!?", "...", "<|endoftext|>", "a<|startoftext|>b", "\u00a0", "ﬁ", "İ", "🙂"]
    alone = sum(count(p) for p in parts)
    if any(count(s.join(parts)) != alone for s in [*SPACES, "  ", "\r\n"]) or any(count(a + " " + b) != count(a) + count(b) for a in parts for b in parts):
        raise ValueError(f"{path} counts words otherwise together than alone; its tokens can't be counted by words")


def open_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_counts(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``pieces`` of each row's ``part``, as the tokenizer gives them without added special tokens."""

    def count(batches):
        tokenizer = open_tokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "part", 4 << 20):
                coded = tokenizer.encode_batch_fast(batch.column("part").to_pylist(), add_special_tokens=False)
                yield batch.append_column("pieces", pa.array(map(len, coded), pa.int64()))

    return parts.mapInArrow(count, "part string, seen long, pieces long")


def frequent(counts: DataFrame, most: int) -> float:
    """The least level of ``seen`` at which at most ``most`` pre-tokens of up to LONGEST bytes stand; levels are eighths of a power of two, so there are few."""
    left = most
    least = float("inf")
    for level, n in counts.where(F.octet_length("part") <= LONGEST).groupBy(_level().alias("level")).count().orderBy(F.desc("level")).collect():
        left -= n
        if left < 0:
            break
        least = level
    return least


def _level():
    return F.floor(F.log2("seen") * 8).cast("double")


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, most: int = 1_000_000) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text.

    The tokenizer must drop white space and never let a piece span it (``check_tokenizer`` raises otherwise), so a text has as many tokens as its
    pre-tokens have together.  Pieces are counted once for each distinct pre-token of all texts.  The most
    frequent ones, at most ``most`` of up to 32 bytes, are broadcast and joined to a document's frequencies where it is read; all
    others, each in few slices of the texts, by a shuffled join.  Special strings in a text count as the library
    counts them by default; none are added.  A null or empty text has 0 bytes and 0 tokens; a null id stays null;
    repeated rows are counted each; other columns are ignored.
    """
    check_tokenizer(tokenizer_path)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    docs = with_only(docs, id_col, text_col).toDF("id", "text")
    counts = saved(piece_counts(distinct_parts(docs, "text"), tokenizer_path), "pieces")
    least = frequent(counts, most)
    is_frequent = (_level() >= least) & (F.octet_length("part") <= LONGEST)
    known = counts.where(is_frequent).select("part", "pieces").toArrow().combine_chunks()
    rest = counts.where(~is_frequent).select("part", "pieces")
    table = spark.sparkContext.broadcast((pa.array(known.column("part").to_pylist(), pa.string()), known.column("pieces").to_numpy()))

    names = ["id", "h", "n_bytes", "n", "part"]

    def joined(batches):
        """A row of each document with the tokens of its frequent pre-tokens, then its other pre-tokens with their frequencies."""
        part_of, pieces_of = table.value
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                n = batch.num_rows
                row, part = pre_tokens(batch.column("text"))
                coded = part.dictionary_encode()
                at = pc.index_in(coded.dictionary, value_set=part_of)
                pieces = np.append(pieces_of, 0)[pc.fill_null(at, len(part_of)).to_numpy()]
                code = coded.indices.to_numpy()
                tokens = np.bincount(row, pieces[code], n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), size, pa.array(tokens), pa.nulls(n, pa.string())], names=names)
                other = pc.is_null(at).to_numpy(zero_copy_only=False)[code] if len(row) else np.zeros(0, bool)
                pairs, times = np.unique(row[other].astype(np.int64) << 32 | code[other], return_counts=True)
                for i in range(0, len(pairs), 100_000):
                    some, where = pairs[i : i + 100_000], pairs[i : i + 100_000] >> 32
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(where)), batch.column("h").take(pa.array(where)), pa.nulls(len(some), pa.int64()), pa.array(times[i : i + 100_000].astype(np.int64)), coded.dictionary.take(pa.array(some & 0xFFFFFFFF))],
                        names=names,
                    )

    rows = docs.withColumn("h", F.xxhash64("text")).mapInArrow(joined, f"id {kind}, h long, n_bytes long, n long, part string")
    if not rest.isEmpty():
        # a document's own row goes with a key that no pre-token equals, so that these rows spread over the tasks of the join
        rows = rows.withColumn("part", F.coalesce("part", F.concat(F.lit(" "), F.col("h").cast("string")))).join(rest, "part", "left")
        rows = rows.withColumn("n", F.col("n") * F.coalesce("pieces", F.lit(1)))
        # repeated rows have the same count, so they are summed together and set apart again
        rows = rows.groupBy("id", "h").agg(F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
        rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n", (F.col("n") / F.col("copies")).cast("long"))
    return rows.select(F.col("id").alias(id_col), "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
