"""Subtitle alignment: chunk weights to ideal cuts to silence boundaries, one script per row."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.functions.text import semantic_chunks, speech_weight

MINIMUM_SEGMENT = 0.45


def _choose(ideal: np.ndarray, silences: np.ndarray, total: float, least: float) -> list[float]:
    usable = np.sort(silences[(silences >= least) & (silences <= total - least)]).tolist()
    chosen, previous = [], 0.0
    for i, want in enumerate(ideal.tolist()):
        latest = total - least * (len(ideal) - i)
        lo, hi = bisect_left(usable, previous + least), bisect_right(usable, latest)
        if lo < hi:
            at = bisect_left(usable, want, lo, hi)
            if at == hi or (at > lo and want - usable[at - 1] <= usable[at] - want):
                at -= 1
            previous = usable[at]
        else:
            previous = max(previous + least, min(want, latest))
        chosen.append(previous)
    return chosen


def nearest_boundaries(ideal: Column, silences: Column, total: Column, least: float = MINIMUM_SEGMENT) -> Column:
    """For each ideal cut the nearest usable silence, in order and with a minimum distance.

    The chain is sequential inside one script; scripts are rows, so Spark spreads them freely.
    """

    @F.pandas_udf("array<double>")
    def choose(cuts: pd.Series, quiet: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([_choose(np.asarray(c, dtype=float), np.asarray(q, dtype=float), float(t), least) for c, q, t in zip(cuts, quiet, length)])

    return choose(ideal, silences, total)


def chunk_cuts(weights: Column, silences: Column, total: Column, least: float = MINIMUM_SEGMENT) -> Column:
    """Cuts between weighted chunks: each chunk's share of the audio length, moved to a silence."""

    @F.pandas_udf("array<double>")
    def cut(parts: pd.Series, quiet: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for w, q, t in zip(parts, quiet, length):
            run = np.cumsum(np.asarray(w, dtype=float))
            ideal = float(t) * run[:-1] / run[-1] if len(run) else run
            out.append(_choose(ideal, np.asarray(q, dtype=float), float(t), least))
        return pd.Series(out)

    return cut(weights, silences, total)


def align_subtitles(scripts: DataFrame) -> DataFrame:
    """Subtitle lines of each script. ``scripts`` has script_id, text, audio_seconds, silences, speaker."""
    chunked = scripts.withColumn("chunks", semantic_chunks(F.col("text")))
    weighed = chunked.withColumn("weights", F.transform("chunks", speech_weight))
    cut = weighed.withColumn("cuts", chunk_cuts(F.col("weights"), F.col("silences"), F.col("audio_seconds")))
    points = F.concat(F.array(F.lit(0.0)), F.col("cuts"), F.array(F.col("audio_seconds")))
    # The outer form keeps the optimizer from testing ``size(chunks) > 0`` below, which would cut every
    # text into chunks a second time.
    lines = cut.select("script_id", F.coalesce("speaker", F.lit("S01")).alias("speaker"), points.alias("p"), F.posexplode_outer("chunks").alias("line", "text"))
    return lines.where(F.col("line").isNotNull()).select("script_id", (F.col("line") + 1).alias("line"), "speaker", "text", F.round(F.get("p", F.col("line")), 3).alias("start"),
                        F.round(F.get("p", F.col("line") + 1), 3).alias("end"))
