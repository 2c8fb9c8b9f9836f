"""Removal of line runs that repeat an earlier run, over all documents.

The lines of all documents, in the order (doc_id, text hash, position), form one sequence of line ids with a
break after each document. Prefix doubling ranks every suffix by its first 1, 2, 4, ... lines: a round pairs
each suffix's rank with the rank 2^k lines on, sorts the distinct pairs by range and numbers them in that
order, so ranks are the suffix array's order by prefix. Suffixes with a prefix of their own leave at once;
what stays in one rank is an interval of the array with a common prefix of 2^k lines.

A run is a stretch of consecutive lines with at least ``min_words`` words; a line is deleted if it lies in a
run that also starts at an earlier place. Each such run is a union of minimal runs, those that just reach
``min_words`` words from their first line on or from their last line back: two overlapping power-of-two
prefixes name a minimal run exactly, the smallest place with that name is its first copy, and all later
places lose their lines. Lines without a word do not count as lines of a run; they go where a run spans them.

Null or empty text has no lines to lose. Documents whose lines all go are dropped by ``dedup_documents``
with ``drop_empty``; rows that are equal in id and text are one document and share a result. A null id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquery.llm.common import WORD, cut_lineage, once
from mediaquery.session import forget

_NONE = -(1 << 63)
_DOC = ("d", "t")


def _keys(id_col: str, text: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")]


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Worded lines: (d, t, pos, a, b, w); two hashes with different seeds stand for the line."""
    rows = docs.select(*_keys(id_col, text), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.select(*_DOC, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.regexp_count("line", F.lit(WORD)).alias("w")).where("w > 0")


def _ranked(keys: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Distinct keys with numbers in key order: equal keys were merged before the range sort, so no range is hot."""
    return cut_lineage(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(rank, F.monotonically_increasing_id()))


def _repeated(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, first, last): line ranges of minimal runs that also start at an earlier place."""
    lines = cut_lineage(_lines(docs, id_col, text))
    ranks = _ranked(_repeated(lines, ["a", "b"]), ["a", "b"], "r0")
    active = lines.join(ranks, ["a", "b"]).drop("a", "b").dropDuplicates([*_DOC, "pos"])
    # stretches of repeated lines: consecutive among the worded lines of the document
    placed = _stretches(lines, active)
    sized = _minimal(placed, min_words)
    runs = cut_lineage(sized)
    longest = runs.agg(F.max(F.greatest("fwd", "bwd")).alias("m")).first()["m"] or 0
    names = _names(runs, longest)
    first = names.groupBy("m", "x", "y").agg(F.min(F.struct(*_DOC, "i")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = names.join(first, ["m", "x", "y"]).where(F.struct(*_DOC, "i") > F.col("head"))
    return late.select(*_DOC, "first", "last").distinct()


def _stretches(lines: DataFrame, active: DataFrame) -> DataFrame:
    """Active lines with a stretch number and their index among it; a stretch ends where a unique line stands."""
    touched = active.select(*_DOC).distinct()
    marks = lines.join(touched, [*_DOC]).select(*_DOC, "pos").dropDuplicates([*_DOC, "pos"])
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    both = marks.join(active, [*_DOC, "pos"], "left").withColumn("g", F.sum(F.col("r0").isNull().cast("int")).over(doc))
    own = Window.partitionBy(*_DOC, "g").orderBy("pos")
    return both.where("r0 is not null").withColumn("i", F.row_number().over(own)).select(*_DOC, "g", "i", "pos", "w", "r0")


def _minimal(df: DataFrame, min_words: int) -> DataFrame:
    """fwd, bwd: lines of the minimal run from, or back from, each line (null: too few words); ends: line numbers."""
    own = Window.partitionBy(*_DOC, "g").orderBy("i")
    ahead, back = own.rowsBetween(0, min_words - 1), own.rowsBetween(-(min_words - 1), 0)

    def steps(words):
        sums = F.aggregate(words, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n")),
                           lambda a, w: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + w).alias("s"), (a["n"] + 1).alias("n"))))
        return F.when(sums["s"] >= min_words, sums["n"])

    df = df.withColumns({"fw": F.collect_list("w").over(ahead), "fp": F.collect_list("pos").over(ahead), "bw": F.collect_list("w").over(back), "bp": F.collect_list("pos").over(back)})
    df = once(df, fwd=steps(F.col("fw")), bwd=steps(F.reverse(F.col("bw"))))
    return df.select(*_DOC, "g", "i", "pos", "r0", "fwd", "bwd", F.get("fp", F.col("fwd") - 1).alias("fend"), F.get(F.reverse("bp"), F.col("bwd") - 1).alias("bstart"))


def _names(runs: DataFrame, longest: int) -> DataFrame:
    """Minimal runs (d, t, i, first, last, m) with their name (m, x, y): ranks of the 2^j-line prefixes at both ends."""
    ahead = runs.where("fwd is not null").select(*_DOC, "g", "i", F.col("fwd").alias("m"), F.col("pos").alias("first"), F.col("fend").alias("last"))
    back = runs.where("bwd is not null").select(*_DOC, "g", (F.col("i") - F.col("bwd") + 1).alias("i"), F.col("bwd").alias("m"), F.col("bstart").alias("first"), F.col("pos").alias("last"))
    todo = ahead.unionByName(back).distinct()
    level = runs.select(*_DOC, "g", "i", F.col("r0").alias("r"))
    done, k = None, 0
    while True:
        size = 1 << k
        own = todo.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        at = [*_DOC, "g"]
        head = own.join(level.withColumnRenamed("r", "x"), [*at, "i"])
        if k:
            tail = level.select(*at, F.col("i").alias("j"), F.col("r").alias("y"))
            named = head.withColumn("j", F.col("i") + F.col("m") - size).join(tail, [*at, "j"]).drop("j")
        else:
            named = head.withColumn("y", F.col("x"))
        named = named.select(*_DOC, "i", "g", "m", "first", "last", "x", "y")
        done = named if done is None else done.unionByName(named)
        if 2 * size > longest:
            break
        pairs = cut_lineage(level.join(level.select(*at, (F.col("i") - size).alias("i"), F.col("r").alias("s")), [*at, "i"]))
        ranks = _ranked(_repeated(pairs, ["r", "s"]), ["r", "s"], "q")
        level = cut_lineage(pairs.join(ranks, ["r", "s"]).select(*at, "i", F.col("q").alias("r")))
        forget(pairs)
        k += 1
    # a place inside the document: its stretch and index; later stretches lie further on
    return done.withColumn("i", F.struct("g", "i")).drop("g")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``text`` without deleted lines, plus ``n_lines`` and ``n_deleted``; null text stays null.

    Columns of the input that are called like the two counts, in any case, give way to them.
    """
    runs = repeated_runs(docs, min_words, id_col, text)
    gone = runs.select(*_DOC, F.explode(F.sequence("first", "last")).alias("pos")).groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), *_keys(id_col, text))
    joined = whole.join(gone, [*_DOC], "left").select("_row", "_text", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    df = once(joined, _lines=F.split(F.col("_text"), "\n"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x + 1))
    ends = F.concat("_gone", F.array(F.size("_lines")))
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    kept = F.flatten(F.transform(spans, lambda z: F.slice(F.col("_lines"), z["s"] + 1, z["e"] - z["s"])))
    new = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n"))
    cols = [new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    return df.select(*cols, F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_deleted"))


def dedup_documents(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their remaining text in the input's columns; those that lost lines and have no word left go."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    out = dedup_lines(plain, min_words, "_id", "_text")
    left = out.where((F.col("n_deleted") == 0) | F.col("_text").rlike(WORD))
    cols = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return left.select(*cols)
