"""Toxicity by a learned lexicon, misspellings included, with scores from the context of each hit.

The lexicon (whole words and word beginnings that mark toxic training texts) is a trie. A word is matched by
the Levenshtein automaton of every entry at once: states are sets of (trie node, edits), made when first needed
and kept, so a word costs one dictionary step per character and most die after a few. Each hit has the
precision of its (entry, edits) on the training texts; its window adds what the words around it and quotation
marks (the entry's own habit of being quoted, where known) say about abuse or mention. Hits that are then more likely
abuse than not combine to 1 - prod(1 - p).

Null and empty texts have no hit and get the base rate. Labels that are null are not learned from; a text with
several labels counts with each. Without training rows or without any entry every score is the base rate.
Repeated rows get the same score. Extra columns are not used.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage, to_batch

#: Words of a hit's window on either side.
WINDOW = 5
#: Labelled training rows at most; more are thinned by hash.
TRAIN_ROWS = 30_000
#: What an entry needs, however many labels there are: toxic texts, log-likelihood ratio against chance (25: about one in
#: two million), and its rate in toxic texts over that in clean ones. Precision, context and quotation do the rest.
LEAST, EVIDENCE, LIFT = 3, 25.0, 3.0
#: Letters of the word beginnings that may become entries; longer ones tell rarer stems apart.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Different words that a beginning needs to count as a stem.
FORMS = 2
_QUOTES = "\"'`“”„‟‘’«»‹›"
_TOKEN = re.compile(r"[^\W_]+")
#: A quotation mark; between two letters it is an apostrophe.
_MARK = re.compile(rf"(?<![^\W_])[{_QUOTES}]|[{_QUOTES}](?![^\W_])")
_MEMO = 400_000


@dataclass
class Model:
    """Fixed-size result of training."""

    entries: list[tuple[str, bool]] = field(default_factory=list)  # term, open: a word may go on after it
    precision: dict[tuple[int, int], float] = field(default_factory=dict)  # (entry, edits)
    context: dict[str, float] = field(default_factory=dict)
    quoted: float = -1.5
    marks: dict[tuple[int, bool], float] = field(default_factory=dict)  # (entry, quoted): weight in place of the general one
    base: float = 0.01


def allowed(term: str, open_: bool) -> int:
    """Edits that an entry tolerates: beginnings and short words none, long words two."""
    return 0 if open_ or len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The product of the entries' trie and their Levenshtein automata, determinised step by step."""

    def __init__(self, entries: list[tuple[str, bool]]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.room = [0]  # edits that some entry below tolerates
        self.closed: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.entries = entries
        for k, (term, open_) in enumerate(entries):
            node, edits = 0, allowed(term, open_)
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.room.append(0)
                node = self.child[node][c]
                self.room[node] = max(self.room[node], edits)
            (self.open if open_ else self.closed)[node] = k
        self.ids: dict = {}
        self.states: list = []
        self.steps: list[dict[str, int]] = []
        self.memo: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)}, None)

    def _state(self, items: set[tuple[int, int]], best) -> int:
        todo = list(items)
        while todo:  # an entry's character that the word leaves out
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e < self.room[nxt] and (nxt, e + 1) not in items:
                    items.add((nxt, e + 1))
                    todo.append((nxt, e + 1))
        for node, e in items:
            if node in self.open and e == 0:  # the longest beginning says most
                best = (self.open[node], 0)
        key = (frozenset(items), best)
        if key not in self.ids:
            ends = [(e, self.closed[n]) for n, e in items if n in self.closed and e <= allowed(*self.entries[self.closed[n]])]
            found = min([*ends, *([(best[1], best[0])] if best else [])], default=None)
            self.ids[key] = len(self.states)
            self.states.append((key[0], best, (found[1], found[0]) if found else None))
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        items, best, _ = self.states[state]
        new: set[tuple[int, int]] = set()
        for node, e in items:
            for ch, nxt in self.child[node].items():
                cost = e if ch == c else e + 1
                if cost <= self.room[nxt]:
                    new.add((nxt, cost))
            if e < self.room[node]:  # a character that the word has on top
                new.add((node, e + 1))
        out = self._state(new, best) if new or best else -1
        self.steps[state][c] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the entry that needs the fewest edits, or None."""
        found = self.memo.get(word, 0)
        if found != 0:
            return found
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        if len(self.states) > 100_000:
            self.ids, self.states, self.steps = {}, [], []
            self.start = self._state({(0, 0)}, None)
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
        found = self.states[state][2] if state >= 0 else None
        self.memo[word] = found
        return found


@dataclass
class Hit:
    entry: int
    edits: int
    quoted: bool
    near: list[str]
    start: int
    end: int


def hits(matcher: Matcher, text: str | None) -> list[Hit]:
    """All matches in a text with their windows."""
    if not text:
        return []
    low = text.lower()
    words = _TOKEN.findall(low)
    good = {w for w in set(words) if matcher.match(w)}
    if not good:
        return []
    spans = [m.span() for m in _TOKEN.finditer(low)]
    out, marks = [], None
    for k, w in enumerate(words):
        if w in good:
            entry, edits = matcher.match(w)
            first, last = max(0, k - WINDOW), min(len(words) - 1, k + WINDOW)
            if marks is None:
                marks = [m.start() for m in _MARK.finditer(low)]
            before, after = bisect.bisect_left(marks, spans[k][0]), bisect.bisect_left(marks, spans[k][1])
            quoted = before > 0 and marks[before - 1] >= spans[first][0] - 1 and after < len(marks) and marks[after] <= spans[last][1]
            out.append(Hit(entry, edits, quoted, words[first:k] + words[k + 1 : last + 1], *spans[k]))
    return out


def score(model: Model, found: list[Hit]) -> float:
    keep = 1.0
    for h in found:
        p = model.precision.get((h.entry, h.edits), 0.0)
        if p <= 0:
            continue
        z = math.log(p / (1 - p)) + model.marks.get((h.entry, h.quoted), model.quoted * h.quoted)
        z += max(-1.0, min(1.0, sum(model.context.get(w, 0.0) for w in h.near)))
        if z < 0:
            continue
        keep *= 1 - 1 / (1 + math.exp(-z))
    return max(model.base, 1 - keep) if keep < 1 else model.base


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, y): labelled texts, thinned by a hash of the id to about ``rows``."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
    n = marked.count()
    share = min(1.0, rows / max(1, n))
    marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * share)) if share < 1 else marked
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(marked, "_id").select("text", "y")


def learn(train: DataFrame) -> Model:
    """The model of (text, y) rows. Words are counted by Spark; only the bounded lexicon comes to the driver."""
    # a text that was copied counts once, and an entry must recur: chance finds words in few toxic texts only
    train = cut_lineage(train.dropDuplicates())
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    model = Model(base=(0.5 + 0.01 * toxic) / (1 + toxic + clean))
    if not toxic:
        return model
    sure = f"t >= {LEAST} and t * {clean}D >= {LIFT} * c * {toxic}D"
    words = train.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counts = cut_lineage(counts.where("t > 0 or length(w) >= 4"))
    # every beginning counts texts at most as often as its words do
    heads = counts.select("w", "t", "c", F.explode(F.filter(F.array(*[F.struct(F.substring("w", 1, n).alias("h"), F.lit(n).alias("n")) for n in BEGINNINGS]), lambda x: F.length(x["h"]) == x["n"])).alias("x"))
    forms = heads.select("w", "t", "c", "x.h").where(sure)
    heads = heads.groupBy("x.h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("forms"), F.max_by("w", F.struct("t", "w")).alias("form"))
    counts, heads = (d.withColumn("g", _evidence(toxic, clean)).withColumn("p", F.expr("t / (t + c)")).where(sure).where(f"g >= {EVIDENCE}") for d in (counts, heads))
    stems = cut_lineage(heads.where(f"forms >= {FORMS}"))
    chosen = counts.select(F.col("w").alias("term"), F.lit(False).alias("open"), "g", "p").unionByName(stems.select(F.col("h").alias("term"), F.lit(True).alias("open"), "g", "p"))
    # a stem tolerates no edits, so its forms are matched as whole words, too; their evidence is the stem's
    chosen = chosen.unionByName(forms.select("w", "h").join(stems.select("h", "g", "p"), "h").select(F.col("w").alias("term"), F.lit(False).alias("open"), "g", "p"))
    chosen = chosen.unionByName(stems.select(F.col("form").alias("term"), F.lit(False).alias("open"), "g", "p")).groupBy("term", "open").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    # every entry stands in ``LEAST`` toxic texts of the sample, so its bound is theirs
    found = chosen.orderBy(F.desc("g"), "term", "open").collect()
    begins = {r["term"]: r["p"] for r in found if r["open"]}
    covered = lambda term, p: any(begins.get(term[:n], -1.0) >= p for n in range(1, len(term)))
    kept = [(r["term"], r["open"]) for r in found if not (r["open"] and covered(r["term"], r["p"]))]
    model.entries = sorted(kept, key=lambda e: e[1])  # of equal edits the whole word comes first
    _weigh(model, train, toxic)
    return model


def _evidence(toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of a term in t toxic and c clean texts against one rate for both."""
    t, c = F.least("t", F.lit(toxic)).cast("double"), F.least("c", F.lit(clean)).cast("double")
    rate = (t + c) / (toxic + clean)
    part = lambda n, want: F.when(n > 0, n * F.log(n / want)).otherwise(0.0)
    return 2 * (part(t, rate * toxic) + part(toxic - t, (1 - rate) * toxic) + part(c, rate * clean) + part(clean - c, (1 - rate) * clean))


def _weigh(model: Model, train: DataFrame, toxic: int) -> None:
    """Precision of hits by entry and edits, and the weights of their context, on the training texts."""
    entries = model.entries
    out = pa.schema([("kind", pa.string()), ("key", pa.string()), ("edits", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            seen: dict[tuple, int] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = hits(matcher, text)
                keys = [("entry", str(h.entry), h.edits, y) for h in found]
                for key in set(keys) | ({("none", "", 0, y)} if not found else set()):
                    seen[key] = seen.get(key, 0) + 1
                for key in [("quoted", str(h.entry), int(h.quoted), y) for h in found] + [("word", w, 0, y) for h in found for w in set(h.near)]:
                    seen[key] = seen.get(key, 0) + 1
            if seen:
                yield to_batch([(*k, n) for k, n in seen.items()], out)

    sums = cut_lineage(train.select("text", "y").mapInArrow(run, "kind string, key string, edits int, y int, n long").groupBy("kind", "key", "edits").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("t"), F.sum(F.expr("if(y = 1, 0, n)")).alias("c")))
    rows = sums.where("kind <> 'word'").collect()  # entries times edits at most
    prior = {0: 0.95, 1: 0.88, 2: 0.8}
    for k, (term, open_) in enumerate(entries):
        for e in range(allowed(term, open_) + 1):
            model.precision[(k, e)] = prior[e]
    none = {"t": 0, "c": 0}
    quoted = {True: dict(none), False: dict(none)}
    own: dict[tuple[int, bool], dict] = {}
    for r in rows:
        if r["kind"] == "entry":
            p = prior[r["edits"]]
            model.precision[(int(r["key"]), r["edits"])] = min(0.999, (r["t"] + 2 * p) / (r["t"] + r["c"] + 2))
        elif r["kind"] == "none":
            model.base = min(0.5, (r["t"] + 0.01) / (r["t"] + r["c"] + 1))
        else:
            own[int(r["key"]), r["edits"] == 1] = {"t": r["t"], "c": r["c"]}
            for x in "tc":
                quoted[r["edits"] == 1][x] += r[x]
    clean_hits, toxic_hits = (sum(q[x] for q in quoted.values()) for x in "ct")
    if clean_hits >= 20 and quoted[True]["t"] + quoted[True]["c"] >= 20:
        model.quoted = max(-3.0, min(3.0, math.log((quoted[True]["t"] + 1) / (toxic_hits + 2)) - math.log((quoted[True]["c"] + 1) / (clean_hits + 2))))
    share = {q: ((quoted[q]["t"] + 1) / (toxic_hits + 2), (quoted[q]["c"] + 1) / (clean_hits + 2)) for q in quoted}
    for k in {k for k, _ in own}:
        t, c = (sum(own.get((k, q), none)[x] for q in (True, False)) for x in "tc")
        if c >= 20:  # few mentions say little about how a term is mentioned
            for q in (True, False):
                n = own.get((k, q), none)
                weight = math.log((n["t"] + 10 * share[q][0]) / (t + 10)) - math.log((n["c"] + 10 * share[q][1]) / (c + 10))
                model.marks[k, q] = max(-3.0, min(3.0, weight))
    if clean_hits >= 20:
        for r in sums.where("kind = 'word' and t + c >= 20").collect():  # twenty hits of the sample each
            weight = math.log((r["t"] + 1) / (toxic_hits + 2)) - math.log((r["c"] + 1) / (clean_hits + 2))
            model.context[r["key"]] = max(-1.0, min(1.0, weight / 2))


def score_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_hits) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.entries)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                found = hits(matcher, value.as_py())
                rows.append((key.as_py(), score(model, found), len(found)))
            yield to_batch(rows, out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, score double, n_hits long").withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows whose text scores below the threshold, in their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.entries)
        for batch in batches:
            keep = [score(model, hits(matcher, x.as_py())) < threshold for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
