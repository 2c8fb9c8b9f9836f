"""Language identification of mixed texts: scripts narrow, words score, Viterbi labels spans.

Letters carry hashed bigrams and trigrams with word boundaries; their log-probabilities per language, counted
over the training texts, add up to a score per word and language. A word's script admits only languages that
use it in training. Viterbi with a penalty for each switch labels every word; the prediction is the language
with most letters, its score their share. The model has a fixed size per language.

Null texts and texts without a letter are ``und`` with score 0, as are all when nothing was learned. Ties go to
the language that sorts first. Repeated rows get equal results. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Nats that a change of language between words costs.
SWITCH = 6.0
#: Languages at most; more are an error, as every task counts a table of them all.
LANGUAGES = 500
#: Words in a padded block of the recursion, about.
BLOCK = 200_000
#: First code points of script ranges (fixed values of the Unicode blocks) and a number for each script.
SCRIPT_STARTS = np.array([0x0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000])
SCRIPT_OF = np.array([1, 0, 2, 3, 0, 4, 5, 0, 6, 7, 8, 9, 0, 1, 0, 10, 0, 11, 0, 9, 0, 11, 0, 11, 0])
SCRIPTS = 12


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all texts' letters in order: bigram bucket, trigram bucket, script; first letters of words; word counts of texts."""
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[points]
    c = np.where(letter, points, 0)
    at = np.nonzero(letter)[0]
    left, mid, right = c[at - 1], c[at], c[at + 1]
    two = (left * 31_337 + mid * 7) % 65_521 % BUCKETS
    three = ((left * 48_611 + mid) * 40_961 + right * 13) % 1_048_573 % BUCKETS
    script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, mid, side="right") - 1]
    begins = np.nonzero(left == 0)[0]
    ends = np.nonzero(points[1:] == 10)[0] + 1  # one line end after each text
    words = np.diff(np.searchsorted(at[begins], ends), prepend=0)
    return two, three, script, begins, words


@dataclass
class Model:
    langs: list[str]
    two: np.ndarray  # (buckets, languages) log-probabilities
    three: np.ndarray
    scripts: np.ndarray  # (scripts, languages): may a word in the script be the language


def learn(train: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Model of the rows with a language and a text; every one is counted."""
    langs = sorted(r["lang"] for r in train.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang")).distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not langs:
        return Model([], *[np.zeros((1, 0))] * 3)
    out = pa.schema([("kind", pa.int32()), ("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
    place = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, len(langs), BUCKETS), dtype=np.int64)
        for batch in batches:
            names = batch.column(1).to_pylist()
            for name in set(names) & set(place):
                texts = [t for t, x in zip(batch.column(0).to_pylist(), names, strict=True) if x == name]
                for k in range(0, len(texts), 256):
                    two, three, script, _, _ = features(texts[k : k + 256])
                    for kind, values in enumerate((two, three, script)):
                        counts[kind, place[name]] += np.bincount(values, minlength=BUCKETS)
        kind, which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[kind, which, bucket])], schema=out)

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").mapInArrow(run, "kind int, lang int, bucket int, n long")
    sums = rows.groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 buckets + scripts rows a language
    table = np.zeros((3, BUCKETS, len(langs)))
    table[sums["kind"], sums["bucket"], sums["lang"]] = sums["n"]
    logs = [np.log((x + 0.5) / (x.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32) for x in table[:2]]
    scripts = table[2, :SCRIPTS]
    return Model(langs, *logs, scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0)))


def viterbi(emission: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels (texts, words) of padded emissions (words, texts, labels); words past a text's length score nothing."""
    steps, n, k = emission.shape
    back = np.zeros((steps, n, k), dtype=np.uint8 if k <= 256 else np.uint16)
    value, own = emission[0].copy(), np.arange(k)
    for t in range(1, steps):
        top = value.argmax(axis=1)
        change = value[np.arange(n), top] - switch
        stay = value >= change[:, None]
        back[t] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, change[:, None]) + emission[t]
    labels = np.zeros((n, steps), dtype=back.dtype)
    now = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        labels[:, t] = now
        now = back[t, np.arange(n), now]
    return labels


def label_words(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: the label of every word, and its letters."""
    two, three, script, begins, counts = features(texts)
    if not len(begins):
        return [(np.zeros(0, np.uint8), np.zeros(0, np.int64))] * len(texts)
    scores = np.add.reduceat(model.two[two] + model.three[three], begins, axis=0)
    fits = model.scripts[script[begins]]
    scores = np.where(fits | ~fits.any(axis=1, keepdims=True), scores, scores - np.float32(1e4))
    letters = np.diff(begins, append=len(two))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out: list = [None] * len(texts)
    order = np.argsort(counts, kind="stable")[::-1]
    at = 0
    while at < len(order):
        width = max(1, int(counts[order[at]]))
        some = order[at : at + max(1, BLOCK // width)]
        emission = np.zeros((width, len(some), scores.shape[1]), dtype=np.float32)
        for k, d in enumerate(some):
            emission[: counts[d], k] = scores[starts[d] : starts[d + 1]]
        labels = viterbi(emission, counts[some], switch)
        for k, d in enumerate(some):
            out[d] = (labels[k, : counts[d]], letters[starts[d] : starts[d + 1]])
        at += len(some)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, n_spans) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                found = label_words(model, part.column(1).to_pylist(), switch) if model.langs else [(np.zeros(0, np.uint8), None)] * part.num_rows
                for labels, letters in found:
                    if not len(labels):
                        rows.append(("und", 0.0, 0))
                        continue
                    share = np.bincount(labels, weights=letters, minlength=len(model.langs))
                    best = int(share.argmax())
                    rows.append((model.langs[best], float(share[best] / share.sum()), int((np.diff(labels) != 0).sum()) + 1))
                names, scores, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(spans, pa.int64())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, n_spans long").withColumnRenamed("id", id_col)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id, first_word, n_words, lang): the labelled spans of every text, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows if model.langs else 0, 512):
                part, rows = batch.slice(k, 512), []
                for key, (labels, _) in zip(part.column(0).to_pylist(), label_words(model, part.column(1).to_pylist(), switch), strict=True):
                    cuts = np.concatenate([[0], np.nonzero(np.diff(labels))[0] + 1, [len(labels)]]) if len(labels) else np.zeros(1, int)
                    rows += [(key, int(a), int(b - a), model.langs[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, first_word long, n_words long, lang string").withColumnRenamed("id", id_col)
