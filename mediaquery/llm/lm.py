"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is masked in turn and predicted from the two words on either side: position-wise embeddings add up,
a tanh layer follows, and one softmax per step walks down a tree of words to the token. The summed conditional
log-probabilities score a document.

The vocabulary is a word count over all documents: every word with at least ``root(tokens) / 2`` occurrences
(``LEAST`` at least) is a token of its own, so the vocabulary grows with the corpus and stays within twice that
root. Rarer words share buckets, a quarter as many as words. A bucket's probability is divided by the different
rare words that it holds on average, so a rare or garbled word does not get the probability of its bucket. The
tree has ``BRANCHES`` branches at most and as many levels as the vocabulary needs, frequent words together, so
the work of a token grows with the logarithm of the vocabulary.

Training is data-parallel in numpy: each round every partition runs Adagrad over its own documents from the
shared weights, and the weights are averaged by tokens seen. Documents are dealt to rounds by a hash of their
text, so each trains once, in one of the rounds; the averaging gathers one set of weights per partition and round.

Null, empty and blank texts have no tokens: sum 0 and no mean. Repeated rows count and train as often as they
stand there and get equal scores; of words that tie in frequency the smaller hash comes first. With no tokens at
all the starting weights score. Very long texts are cut into words in pieces. Extra columns are not used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = 16
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 1024
ROUNDS = 2
RATE = 0.4
#: Occurrences that a word of the vocabulary needs, however small the corpus.
LEAST = 3
#: Characters that are cut into words at once.
PIECE = 1 << 20
_BLOCK = 4096
_COUNTED = 1 << 20
_EPS = np.float32(1e-6)
_BLANK = re.compile(r"[\t-\r ]")


def _piece_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(t.replace("\n", " ") for t in texts)
    points = np.frombuffer((" " + joined + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = (points > 32) | (points < 9) | ((points > 13) & (points != 32))
    begins = np.nonzero(inside[1:] & ~inside[:-1])[0] + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # a word's hash sums the mixed hashes of its characters and their places in the word
    stops = np.nonzero(inside[:-1] & ~inside[1:])[0] + 1
    sizes = stops - begins
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
    mixed = points[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed += place.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    words = np.add.reduceat(mixed, heads)
    ends = np.nonzero(points == 10)[0]
    return words, np.diff(np.searchsorted(begins, ends), prepend=0)


def _pieces(text: str) -> list[str]:
    """A text cut at blanks into pieces of ``PIECE`` characters; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = _BLANK.search(text, at + PIECE)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's number of words; words are runs of non-blank characters."""
    texts = [t or "" for t in texts]
    if max(map(len, texts), default=0) <= PIECE:
        return _piece_hashes(texts)
    every, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            words, n = _piece_hashes([piece])
            every.append(words)
            counts[k] += n.sum()
    return np.concatenate(every), counts


@dataclass
class Vocabulary:
    """Words of their own by descending frequency, then buckets of rare words."""

    hashes: np.ndarray  # uint64, ascending
    ids: np.ndarray  # the token of each hash
    buckets: int = LEAST
    rare: float = 1.0  # different rare words per bucket

    @property
    def size(self) -> int:
        return len(self.hashes) + self.buckets

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in order, and each text's number of tokens."""
        words, counts = word_hashes(texts)
        out = (len(self.hashes) + (words >> np.uint64(7)) % np.uint64(self.buckets)).astype(np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = self.ids[at[known]]
        return out, counts


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The vocabulary of all texts, by a word count in Spark; at most twice the root of the tokens comes to the driver."""
    out = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], schema=out)

        for _, texts in _texts(batches, 0):
            held.append(word_hashes(texts)[0])
            n += len(held[-1])
            if n >= _COUNTED:
                yield flush()
                n = 0
        if n:
            yield flush()

    counted = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    try:
        whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
        least = max(LEAST, math.ceil(math.sqrt(whole["tokens"]) / 2))
        found = counted.where(F.col("n") >= least).toPandas()
    finally:
        counted.unpersist()
    words, n = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    ids = np.empty(len(words), np.int32)
    ids[np.lexsort((words, -n))] = np.arange(len(words), dtype=np.int32)
    order = np.argsort(words)
    buckets = len(words) // 4 + LEAST
    return Vocabulary(words[order], ids[order], buckets, max(1.0, (whole["words"] - len(words)) / buckets))


class Network:
    """Weights by name; the last embedding row stands for places outside the text.

    ``node`` holds an embedding and the biases of the branches for every inner node of the tree, level by level.
    """

    def __init__(self, size: int, width: int = WIDTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.width, self.depth, self.base = size, width, 1, 2
        while BRANCHES**self.depth < size:
            self.depth += 1
        while self.base**self.depth < size:
            self.base += 1
        powers = [self.base**k for k in range(self.depth + 1)]
        self.first = [sum(powers[:k]) for k in range(self.depth + 1)]  # first node of each level
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        node = np.concatenate([draw(self.first[-1], width), np.zeros((self.first[-1], self.base), np.float32)], axis=1)
        for level in range(self.depth):  # branches without a word
            start = np.arange(powers[level + 1]).reshape(-1, self.base) * powers[self.depth - 1 - level]
            node[self.first[level] : self.first[level + 1], width:][start >= size] = -30
        self.w = {"embed": draw(len(OFFSETS), size + 1, width), "bias": np.zeros(width, np.float32), "branch": draw(self.depth, width, self.base), "node": node}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.w.items():
            self.w[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def path(self, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(node, branch) of the targets on every level."""
        out, prefix = [], np.zeros_like(target)
        for level in range(self.depth):
            below = target // self.base ** (self.depth - 1 - level)
            out.append((self.first[level] + prefix, below - prefix * self.base))
            prefix = below
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        out = self.w["embed"][0].take(context[0], axis=0, mode="clip")
        for k in range(1, len(OFFSETS)):
            out += self.w["embed"][k].take(context[k], axis=0, mode="clip")
        out += self.w["bias"]
        return np.tanh(out, out=out)

    def bounds(self) -> list[float]:
        """No logit of a level is larger: the hidden layer stays within 1."""
        out = []
        for level in range(self.depth):
            node = self.w["node"][self.first[level] : self.first[level + 1]]
            out.append(float(((1 + np.abs(node[:, : self.width]).max(axis=0)) @ np.abs(self.w["branch"][level])).max() + np.abs(node[:, self.width :]).max()))
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, bounds: list[float]) -> np.ndarray:
        """As ``forward``, without what only training needs."""
        hidden, rows, out = self.hidden(context), np.arange(len(target)), np.zeros(len(target))
        for level, (node, branch) in enumerate(self.path(target)):
            own = self.w["node"].take(node, axis=0) if level else self.w["node"][:1]
            z = (hidden + own[:, : self.width]) @ self.w["branch"][level]
            z += own[:, self.width :]
            out += z[rows, branch] - _log_total(z, bounds[level])
        return out

    def forward(self, context: np.ndarray, target: np.ndarray):
        """context: (offsets, tokens). Log-probabilities of the targets and what the backward pass needs."""
        hidden, rows, logs, steps = self.hidden(context), np.arange(len(target)), 0.0, []
        for level, (node, branch) in enumerate(self.path(target)):
            own = self.w["node"].take(node, axis=0) if level else self.w["node"][:1]
            into = hidden + own[:, : self.width]
            share, log = _softmax(into @ self.w["branch"][level] + own[:, self.width :], branch, rows)
            share[rows, branch] -= 1
            logs = logs + log
            steps.append((node, into, share))
        return logs, hidden, steps


def _log_total(z: np.ndarray, bound: float) -> np.ndarray:
    """Log of the sum of exponentials per row; rows that stay far from overflow need no maximum."""
    if bound < 80:
        return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


def _softmax(z: np.ndarray, target: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not (z.max() < 80 and z.min() > -80):  # else no exponential overflows or vanishes
        z -= z.max(axis=1, keepdims=True)
    picked = z[rows, target]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z /= total[:, None]
    return z, picked - np.log(total)


def _sum_rows(index: np.ndarray, grad: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    # 16-bit keys are sorted by radix
    order = np.argsort(index.astype(np.uint16) if size <= 1 << 16 else index, kind="stable")
    ordered = index[order]
    change = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=change[1:])
    first = np.flatnonzero(change)
    return ordered[first], np.add.reduceat(grad[order], first, axis=0)


class Trainer:
    """Adagrad over batches of one partition."""

    def __init__(self, net: Network) -> None:
        self.net, self.seen = net, 0
        self.power = {k: np.full_like(x, 1e-2) for k, x in net.w.items()}

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[tuple]:
        """(name, place, gradient) of the mean negative log-probability; places are rows of a weight or all of it."""
        net, n = self.net, np.float32(len(target))
        _, hidden, steps = net.forward(context, target)
        back, out = 0.0, []
        for level, (node, into, delta) in enumerate(steps):
            delta /= n
            own = delta @ net.w["branch"][level].T
            back = back + own
            out.append(("branch", level, into.T @ delta))
            both = np.concatenate([own, delta], axis=1)
            out.append(("node", *(_sum_rows(node, both, net.first[-1]) if level else (0, both.sum(axis=0)))))
        back *= 1 - hidden * hidden
        out.append(("bias", ..., back.sum(axis=0)))
        for k in range(len(OFFSETS)):
            rows, sums = _sum_rows(context[k], back, net.size + 1)
            out.append(("embed", (k, rows), sums))
        return out

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for name, at, grad in self.gradients(context, target):
            power = self.power[name][at] + grad * grad
            self.power[name][at] = power
            self.net.w[name][at] -= RATE * grad / np.sqrt(power + _EPS)
        self.seen += len(target)


def windows(ids: np.ndarray, counts: np.ndarray, outside: int) -> np.ndarray:
    """(offsets, tokens) neighbours inside each text."""
    pad = max(map(abs, OFFSETS))
    shift = np.repeat(np.arange(len(counts)) * pad, counts) + pad
    wide = np.full(len(ids) + (len(counts) + 1) * pad, outside, dtype=np.intp)
    place = np.arange(len(ids)) + shift
    wide[place] = ids
    return np.stack([wide.take(place + o) for o in OFFSETS])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of rows whose texts have about ``PIECE`` bytes together, or one longer text."""
    for batch in batches:
        sizes = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)])
        k = 0
        while k < batch.num_rows:
            end = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + PIECE, side="right")))
            part = batch.slice(k, end - k)
            yield part, part.column(column).to_pylist()
            k = end


@dataclass
class Model:
    words: Vocabulary
    flat: np.ndarray

    def network(self) -> Network:
        return Network(self.words.size).load(self.flat)


def train(docs: DataFrame, rounds: int = ROUNDS, text: str = "text") -> Model:
    """Vocabulary and weights after ``rounds`` rounds over all documents."""
    context = docs.sparkSession.sparkContext
    words = vocabulary(docs, text)
    flat = Network(words.size).flat()
    dealt = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).withColumn("turn", F.pmod(F.xxhash64("text"), F.lit(rounds)))
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("weights", pa.binary()), ("seen", pa.float64())])
    for turn in range(rounds):
        shared = context.broadcast(Model(words, flat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, own = shared.value.network(), shared.value.words
            trainer = Trainer(net)
            for _, texts in _texts(batches, 0):
                ids, counts = own.tokens(texts)
                around = windows(ids, counts, net.size)
                for k in range(0, len(ids), BATCH):
                    trainer.step(around[:, k : k + BATCH], ids[k : k + BATCH])
            if trainer.seen:
                result, part = net.flat(), TaskContext.get().partitionId()
                for at in range(0, len(result), _BLOCK):
                    yield pa.RecordBatch.from_pylist([{"block": at // _BLOCK, "part": part, "weights": result[at : at + _BLOCK].tobytes(), "seen": float(trainer.seen)}], schema=schema)

        rows = dealt.where(F.col("turn") == turn).select("text").mapInArrow(run, _WEIGHTS)
        # three levels of at most 64 (for up to 262,144 partitions), so that no task meets the weights of all partitions
        for _ in range(2):
            rows = _averaged(rows.withColumn("part", F.expr("part div 64").cast("int")))
        blocks = _averaged(rows.withColumn("part", F.lit(0))).select("block", "weights").collect()
        flat = flat.copy()
        for r in blocks:  # one set of weights
            part = np.frombuffer(r["weights"], dtype=np.float32)
            flat[r["block"] * _BLOCK : r["block"] * _BLOCK + len(part)] = part
        shared.unpersist()
    return Model(words, flat)


_WEIGHTS = "block int, part int, weights binary, seen double"


def _averaged(rows: DataFrame) -> DataFrame:
    def mean(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_numpy()
        total = sum(np.frombuffer(x.as_py(), dtype=np.float32).astype(np.float64) * s for x, s in zip(table.column("weights"), seen, strict=True))
        out = {"block": [table.column("block")[0].as_py()], "part": [table.column("part")[0].as_py()], "weights": [(total / seen.sum()).astype(np.float32).tobytes()], "seen": [float(seen.sum())]}
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("weights", pa.binary()), ("seen", pa.float64())]))

    return rows.groupBy("block", "part").applyInArrow(mean, _WEIGHTS)


def score_texts(net: Network, words: Vocabulary, texts: list[str | None], bounds: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities and token counts of texts."""
    ids, counts = words.tokens(texts)
    around, logs, bounds = windows(ids, counts, net.size), np.zeros(len(ids)), bounds or net.bounds()
    for k in range(0, len(ids), BATCH):
        logs[k : k + BATCH] = net.log_probabilities(around[:, k : k + BATCH], ids[k : k + BATCH], bounds)
    logs[ids >= len(words.hashes)] -= math.log(words.rare)
    ends = np.cumsum(counts)
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    return sums[ends] - sums[ends - counts], counts


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, pll, pll_per_token) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("pll", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = shared.value.network(), shared.value.words
        bounds = net.bounds()
        for part, texts in _texts(batches, 1):
            sums, counts = score_texts(net, words, texts, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())], schema=out)

    done = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_tokens long, pll double")
    return done.withColumn("pll_per_token", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))).withColumnRenamed("id", id_col)
