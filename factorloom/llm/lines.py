"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, join_by_frequency, saved


def held(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, also where lambdas of later columns use it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def fingerprints(docs: DataFrame, min_run: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, h, p, lead, around)``: a row for each line that winnowing selects, blank lines left out.

    Of each window of ``min_run`` lines that follow each other the smallest line hash is selected, the last one of ties;
    windows next to each other mostly select the same line.  ``p`` is the line's place from 1 among lines that aren't blank,
    ``around`` it and the ``min_run - 1`` lines before and after it (hash ``h`` and line number ``place``), ``lead`` how many of these come before it.
    Only these small structs are exploded, so time and memory are linear in a text's lines.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(F.when(line.rlike(r"[^\s]"), F.xxhash64(line)).alias("h"), i.alias("place")))
    rows = held(rows.select("id", "row", F.filter(numbered, lambda x: x["h"].isNotNull()).alias("lines")), "full", F.col("lines")).drop("lines").where(F.size("full") >= min_run)
    rank = lambda i: F.struct(F.get("full", i)["h"].alias("h"), (-i).alias("p"))
    least = lambda ranks: F.least(*ranks) if len(ranks) > 1 else ranks[0]
    picks = F.transform(F.sequence(F.lit(0), F.size("full") - min_run), lambda i: -least([rank(i + j) for j in range(min_run)])["p"])
    near = lambda i: F.filter(F.array(*[F.get("full", i + j) for j in range(1 - min_run, min_run)]), lambda x: x.isNotNull())
    chosen = F.transform(F.array_distinct(picks), lambda i: F.struct(F.get("full", i)["h"].alias("h"), (i + 1).alias("p"), F.least(i, F.lit(min_run - 1)).alias("lead"), near(i).alias("around")))
    return rows.select("id", "row", F.explode(chosen).alias("x")).select("id", "row", "x.*")


def own_windows(min_run: int) -> Column:
    """Of a row of ``fingerprints`` the windows that selected its line: where they ``start``, their line numbers ``at`` and line hashes ``key``."""
    line = lambda j: F.get("around", F.col("lead") + j)
    out = []
    for first in range(1 - min_run, 1):
        others = [j for j in range(first, first + min_run) if j]
        selected = F.lit(True)
        for j in others:  # null where the window does not exist
            selected = selected & ((line(j)["h"] >= F.col("h")) if j < 0 else (line(j)["h"] > F.col("h")))
        window = F.struct((F.col("p") + first).alias("start"), F.array(*[line(j)["place"] for j in range(first, first + min_run)]).alias("at"), F.array(*[line(j)["h"] for j in range(first, first + min_run)]).alias("key"))
        out.append(F.when(selected, window))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def reach(min_run: int, step: int) -> Column:
    """How many lines before (``step`` -1) or after (1) a fingerprint are the same as around its ``first`` place, of those that both carry."""
    out, same = F.lit(0), F.lit(True)
    for j in range(1, min_run):
        here, there = F.get("around", F.col("lead") + step * j)["h"], F.get("first.around", F.col("first.lead") + step * j)["h"]
        same = same & F.coalesce(here == there, F.lit(False))
        out = out + same.cast("int")
    return out


def long_lines(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, at, key)``: a row for each line of ``words`` words or more, alone."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("place", "line"))
    rows = rows.where(F.regexp_count("line", F.lit(WORD)) >= words)
    return rows.select("id", "row", F.col("place").alias("start"), F.array("place").alias("at"), F.unhex(F.md5("line")).alias("key"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def repeated_lines(docs: DataFrame, *, min_run: int = 2, single_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, gone)``: the line numbers, from 0, that ``drop_repeated_lines`` deletes, for documents that lose any."""
    prints = saved(fingerprints(docs, min_run, id_col, text_col), "line-fingerprints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "p")
    first = F.min(F.struct(place.alias("place"), "lead", "around"))
    firsts = saved(prints.groupBy("h").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-fingerprints")
    # every other position of a fingerprint, compared outwards with its first one
    matches = join_by_frequency(prints, firsts, ["h"]).where(~place.eqNullSafe(F.col("first.place"))).withColumns({"before": reach(min_run, -1), "after": reach(min_run, 1), "windows": own_windows(min_run)})
    matches = saved(matches.select("id", "row", "p", "lead", "around", "before", "after", "windows"), "line-matches")
    run = F.slice("around", F.col("lead") - F.col("before") + 1, F.col("before") + 1 + F.col("after"))
    later = matches.where(F.col("before") + 1 + F.col("after") >= min_run).select("id", "row", F.transform(run, lambda x: x["place"]).alias("at"))
    # windows that stand otherwise around the first position may still stand alike at a later one: by their own first place
    covered = lambda w: (w["start"] >= F.col("p") - F.col("before")) & (w["start"] + (min_run - 1) <= F.col("p") + F.col("after"))
    rest = matches.select("id", "row", F.explode(F.filter("windows", lambda w: ~covered(w))).alias("w")).select("id", "row", "w.*")
    later = later.union(later_copies(saved(rest, "line-windows")).select("id", "row", "at"))
    if single_words is not None:
        later = later.union(later_copies(saved(long_lines(docs, single_words, id_col, text_col), "long-lines")).select("id", "row", "at"))
    return later.select("id", "row", F.explode("at").alias("line")).groupBy("id", "row").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def later_copies(near: DataFrame) -> DataFrame:
    """The rows whose ``key`` stands at a smaller place too, with the ``first`` such place: each joins one place, however many there are."""
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("start").alias("start"))
    first = near.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").select("key", "first", "n")
    return join_by_frequency(near, saved(first, "first-places"), ["key"]).where(~place.eqNullSafe(F.col("first")))


def drop_repeated_lines(docs: DataFrame, *, min_run: int = 2, single_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The documents with their text less every later copy of a run of ``min_run`` lines or more; all other columns as they are.

    A run of lines (blank ones don't count and don't break it) is a later copy if the same lines follow
    each other at a smaller (id, place), in this document or another; all is judged on
    the texts as they come in.  Winnowing selects the smallest line hash of each ``min_run`` lines, so
    two runs of as many equal lines share a fingerprint.  Positions of a fingerprint are joined to its first one and extended both ways
    while the lines before and after are the same (by 64-bit hashes of each line); windows that its surroundings there don't explain are
    joined to the first place of the same window.  A run is the union of what neighbouring fingerprints reach.  A shorter run that repeats stays,
    but for lines of ``single_words`` words or more, if that is given: each is a run by itself, in documents of one line too.
    Copies are counted and their first place found by aggregation, and very frequent fingerprints and windows are joined by
    broadcasts of a bounded number, so a line that is in very many documents is never in one task.

    Null texts stay null, empty ones empty; a null id comes last in order; rows
    alike in id and text share their fate and don't delete each other; no document is
    dropped, though all its lines may go.  Very long texts take time and memory in
    proportion to their lines.  ``counts`` adds ``n_lines`` and ``n_removed``, in place of columns of that name.
    """
    gone = repeated_lines(docs, min_run=min_run, single_words=single_words, id_col=id_col, text_col=text_col).select(F.col("id").alias("_gone_id"), F.col("row").alias("_gone_row"), F.col("gone").alias("_gone"))
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    text, of = F.col(f"`{text_col}`"), lambda c: F.col("_doc").getField(c)  # noqa: E731  all columns in one, so that names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), row_key(id_col, text_col).alias("_row_key"))
    rows = rows.join(gone.hint("shuffle_hash"), (F.col("_row_key") == F.col("_gone_row")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left")
    rows = held(rows, "_lines", F.split("_text", "\n", -1))
    text, lines = F.col("_text"), F.col("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i))
    less = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    more = [F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed")] if counts else []
    return rows.select(*[less.alias(c) if c == text_col else of(c).alias(c) for c in names], *more)
