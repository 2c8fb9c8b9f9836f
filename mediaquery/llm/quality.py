"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed rule.
Policies are versioned masks over the bits, so a new policy or an ablation needs no second look at a text.

Null text has no words (``few_words`` fails). Repeated rows give repeated ledger rows. An empty table gives
an empty ledger. Extra columns are not carried; join the ledger by its id where they are needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.llm.common import GAP, once

#: Rules in bit order: name and failure condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("stutter", "5 * n_stutter > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines", "stutter"),
}


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Distinct hashes prove that no window repeats, which settles most texts; the others sort their windows
    as strings, so that a hash collision cannot count.
    """
    def covered(p: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(5))))
        return F.when(F.size(p) > 0, F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(0)

    def repeated(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k)["w"] == F.get(s, k - 1)["w"]) | (F.get(s, k)["w"] == F.get(s, k + 1)["w"]))
        return F.sort_array(F.transform(at, lambda k: F.get(s, k)["i"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("w"), i.alias("i")))
    # one-element arrays bind a value to a lambda variable, so it is computed once
    exact = F.transform(F.array(F.sort_array(windows)), lambda s: F.transform(F.array(repeated(s)), covered)[0])[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input plus one column per measurement."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = once(docs, _words=F.filter(F.split(body, GAP), lambda w: w != ""),
              _lines=F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != ""), _body=body)
    none = F.array().cast("array<bigint>")
    df = once(df, _hashes=F.when(F.size("_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(F.slice(F.col("_words"), i + 1, 5)))).otherwise(none))
    df = once(
        df,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=(F.length("_body") - F.length(F.regexp_replace("_body", r"[#*$%&|<>]+", ""))).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_stutter=F.size(F.filter(F.col("_words"), lambda w, i: w == F.get(F.col("_words"), i - 1))).cast("long"),
        n_repeat_words=_repeat_words(F.col("_words"), F.col("_hashes")),
    )
    return df.drop("_words", "_lines", "_body", "_hashes")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stutter", "n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measurements, failed): bit i of ``failed`` is set where rule i fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(0) for name, cond in RULES])
    narrow = docs.select(F.col(id_col), F.col(text).alias("_text"))
    return measure(narrow, "_text").select(id_col, *MEASURES, bits.cast("long").alias("failed"))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def filter_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Rows whose document the policy keeps, in their own columns; clashing names of measurements are safe."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(0) for name, cond in RULES])
    return measure(whole, "_text").where(bits.bitwiseAND(F.lit(mask(policy))) == 0).select("_row.*")


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of the policy: documents it fails, and documents only it rejects."""
    rules = POLICIES[policy]
    held = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    sums = [F.sum((held.bitwiseAND(F.lit(BIT[r])) != 0).cast("long")).alias(f"f_{r}") for r in rules]
    alone = [F.sum((held == BIT[r]).cast("long")).alias(f"o_{r}") for r in rules]
    totals = book.agg(F.count(F.lit(1)).alias("documents"), F.sum((held != 0).cast("long")).alias("rejected"), *sums, *alone)
    rows = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(r).alias("rule"), F.coalesce(F.col(f"f_{r}"), F.lit(0)).alias("failing"), F.coalesce(F.col(f"o_{r}"), F.lit(0)).alias("only_this_rule")) for r in rules])
    return totals.select("documents", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.inline(rows))
