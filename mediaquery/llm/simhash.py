"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints collapse to one. A tile holds fingerprints whose words (``words`` equal slices) have the same
population counts; two fingerprints within the radius have counts whose differences sum to the radius at most, so
only such tile pairs meet, by an equi-join on the neighbouring counts. Inside a pair numpy's exclusive-or and bit
counts compare all fingerprints, and only a spanning forest of the links leaves the task, never all pairs of a group.

A text without words has fingerprint zero and links like any other; null text is empty. Repeated rows share a
fingerprint. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaquery.llm.common import cut_lineage
from mediaquery.llm.components import connected_components
from mediaquery.session import forget

SEED = 42
#: Fingerprints in a tile, about.
TILE = 512
#: Shingles of all texts of a tile of ``near_duplicates``, about; bounds what an exact check of the tile holds.
TILE_SHINGLES = 1_000_000
#: Differing bits of 256 within which texts of similarity 0.8 are candidates. A bit differs with probability 3/16 at most
#: (4 shingles of 5; 0.161 from 12 of 15 on), so a link of 4 in 5 shingles is lost once in two million, any other once in
#: 10^9 (exact binomial tails); of unrelated pairs one in 10^9 is a candidate, a tile pair in a thousand has one.
RADIUS = 80


def shingle_hashes(raw: bytes, n: int) -> np.ndarray:
    """XXH64 of every n-word shingle of the text with A-Z lower-cased; fewer words: of all of them; none: empty."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, x: a + 1 + x))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[min(n, len(words)) - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(shingle_hashes(x.as_py() or b"", shingle)) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("raw")).mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def _counts(words: int) -> Column:
    width = 64 // words
    part = lambda k: F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.bit_count(part(k)).cast("int") for k in range(words)])


def _steps(words: int, radius: int) -> list[list[int]]:
    """One of each pair of opposite count differences within the radius, and zero."""
    near = [x for x in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, x)) <= radius]
    return [list(x) for x in near if x >= (0,) * words]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or, if ``same``, within) arrays of fingerprints."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    label = np.arange(len(a) + (0 if same else len(b)))
    other = j if same else j + len(a)
    kept: list[tuple[int, int]] = []
    while True:  # a node takes the smallest label next to it; labels then point at roots
        x, y = label[i], label[other]
        open_ = x != y
        if not open_.any():
            return kept
        i, j, other, x, y = i[open_], j[open_], other[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        kept += [(int(a[p]), int(b[q])) for p, q in zip(i[first], j[first], strict=True)]
        label[high[first]] = low[first]
        while (label != label[label]).any():
            label = label[label]


def links(marks: DataFrame, radius: int = 3, words: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints of column ``fp`` that connect what is within the radius."""
    keyed = marks.select("fp", _counts(words).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    tiles = cut_lineage(keyed.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.array(*map(F.lit, x)) for x in _steps(words, radius)])
    visits = tiles.select("fps", "part", F.col("key").alias("own"), F.explode(steps).alias("step")).select("fps", "part", "own", F.zip_with("own", "step", lambda x, y: x + y).alias("key"))
    home = tiles.select("key", F.col("part").alias("home_part"), F.col("fps").alias("home"))
    met = visits.join(home, "key").where((F.col("own") != F.col("key")) | (F.col("part") <= F.col("home_part")))
    met = met.select("fps", "home", ((F.col("own") == F.col("key")) & (F.col("part") == F.col("home_part"))).alias("same"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, same in zip(*batch.columns, strict=True):
                found += forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius, same.as_py())
            if found:
                pair = np.array(found, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=out)

    return met.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, radius: int = 3, shingle: int = 3, words: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of fingerprints, its own for a lone document."""
    marks = cut_lineage(fingerprints(docs, shingle, id_col, text))
    heads = cut_lineage(marks.groupBy("fp").agg(F.min(id_col).alias("head")))
    found = connected_components(links(heads, radius, words))
    joined = heads.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("head").alias("component_id"))
    return marks.join(joined.join(least, "component").select("fp", "component_id"), "fp")


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit fingerprints of distinct shingles; later words come from hashes mixed again."""
    out = np.zeros(words, np.uint64)
    for k in range(words):
        out[k] = fingerprint(hashes)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
    return out


def _within(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and differing bits of all links between two tiles of wide fingerprints."""
    gap = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        gap += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    i, j = np.nonzero(gap <= radius)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j, gap[i, j]


def closest_forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and differing bits of a spanning forest of the links between two tiles, nearest links first."""
    i, j, far = _within(a, b, radius, same)
    label = np.arange(len(a) + (0 if same else len(b)))
    other, keep = (j if same else j + len(a)), []
    while len(i):  # every tree takes its nearest link outwards; ties by place, so no cycles
        x, y = label[i], label[other]
        out = x != y
        i, j, other, far, x, y = i[out], j[out], other[out], far[out], x[out], y[out]
        if not len(i):
            break
        rank = np.lexsort((other, i, far))
        i, j, other, far, x, y = i[rank], j[rank], other[rank], far[rank], x[rank], y[rank]
        _, first = np.unique(np.stack([x, y], 1).ravel(), return_index=True)
        use = np.unique(first // 2)
        keep.append(np.stack([i[use], j[use], far[use]], 1))
        low, high = np.minimum(x[use], y[use]), np.maximum(x[use], y[use])
        while True:  # merge the trees that the chosen links join
            before = label.copy()
            l, h = label[low], label[high]
            np.minimum.at(label, l, h)
            np.minimum.at(label, h, l)
            label = label[label]
            while (label != label[label]).any():
                label = label[label]
            if (label == before).all():
                break
    found = np.concatenate(keep) if keep else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def _similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Have two sorted arrays of distinct shingle hashes at least this Jaccard similarity?"""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b, ...) of keys with ``good``: are their texts' shingle sets at least so similar."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    near = pairs.join(texts.select(F.col("key").alias("a"), F.col("raw").alias("ra")), "a").join(texts.select(F.col("key").alias("b"), F.col("raw").alias("rb")), "b").select("a", "b", *rest, "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            good = [_similar(*(np.unique(shingle_hashes(t.as_py(), shingle)) for t in two), similarity) for two in zip(batch.column(n), batch.column(n + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(good, pa.bool_())], names=[*batch.schema.names[:n], "good"])

    return near.mapInArrow(run, T.StructType([*near.schema.fields[:-2], T.StructField("good", T.BooleanType())]))


def late_links(marks: np.ndarray, label: list, hashes: list, left: np.ndarray, right: np.ndarray, radius: int, similarity: float, same: bool) -> list[tuple[int, int]]:
    """Links of rows ``left`` to rows ``right`` that join different labels, each checked exactly, nearest first."""
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    i, j, far = _within(marks[left], marks[right], radius, same)
    order, found = np.argsort(far, kind="stable"), []
    for p, q in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
        x, y = find(label[p]), find(label[q])
        if x != y and _similar(hashes[p], hashes[q], similarity):
            root[x] = y
            found.append((p, q))
    return found


def _labelled(rows: DataFrame, col: str, known: DataFrame, name: str) -> DataFrame:
    """``name``: the component of ``col``, itself for a lone key."""
    found = known.select(F.col("node").alias(col), F.col("component").alias(name))
    return rows.join(found, col, "left").withColumn(name, F.coalesce(name, col))


def _tile_components(links: DataFrame) -> DataFrame:
    """(node, component) by links (a, b, at) inside tiles; a tile's links are a forest, fewer than its rows."""
    grouped = links.groupBy("at").agg(F.collect_list(F.struct("a", "b")).alias("links")).select("links")
    out = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column(0):
                nodes, ends = np.unique(np.stack([pairs.values.field(c).to_numpy() for c in "ab"]), return_inverse=True)
                a, b = ends.reshape(2, -1)
                label = np.arange(len(nodes))
                while (label[a] != label[b]).any():
                    low = np.minimum(label[a], label[b])
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], schema=out)

    return cut_lineage(grouped.mapInArrow(run, "node long, component long"))


def _between(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs of a tile pair that join two components so far, one for each two components, the nearest."""
    both = _labelled(_labelled(pairs, "a", known, "la"), "b", known, "lb").where("la <> lb")
    best = both.groupBy("at", F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high")).agg(F.min(F.struct("far", "a", "b")).alias("x"))
    return best.select("x.a", "x.b", "at")


def _tile_sides(batch: pa.RecordBatch, words: int) -> Iterator[tuple]:
    """(at, same, rows, marks, left, right) of each collected tile pair; a tile that meets itself has its rows once."""
    for at, group, same in zip(*batch.columns, strict=True):
        same = same.as_py()
        rows = list({(0 if same else r["side"], r["key"]): r for r in group.as_py()}.values())
        side, every = np.array([r["side"] for r in rows]), np.arange(len(rows))
        wide = np.array([r["marks"] for r in rows], dtype=np.int64).view(np.uint64).reshape(-1, words)
        yield at, same, rows, wide, (every if same else every[side == 0]), (every if same else every[side == 1])


def _links_behind_failures(failed: DataFrame, pairs: DataFrame, marks: DataFrame, texts: DataFrame, known: DataFrame, radius: int, words: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that were left out because a nearer link, which then failed its check, closed a cycle.

    Both ends of such a link lie on the forest of a tile pair with a failure. These fingerprints alone meet again, by
    tile pair; texts with a candidate in another component follow, and every candidate that joins two components so
    far is checked in the task. Failures never leave it.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("key")), F.struct(F.lit(1).alias("side"), F.col("b").alias("key")))
    ends = pairs.join(failed, "at", "left_semi").select("at", F.explode(sides).alias("x")).select("at", "x.*").distinct()
    rows = _labelled(ends, "key", known, "label")
    mixed = rows.groupBy("at").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("at")
    rows = rows.join(mixed, "at", "left_semi").join(marks.select("key", "marks"), "key")
    tiles = rows.groupBy("at").agg(F.collect_list(F.struct("side", "key", "label", "marks")).alias("rows")).select("at", "rows", F.col("at.same").alias("same"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, same, tile, wide, left, right in _tile_sides(batch, words):
                i, j, _ = _within(wide[left], wide[right], radius, same)
                _, label = np.unique(np.array([r["label"] for r in tile], dtype=np.int64), return_inverse=True)
                apart = label[left[i]] != label[right[j]]
                kept = [tile[k] for k in np.unique(np.r_[left[i[apart]], right[j[apart]]])]
                if kept:
                    cols = [pa.array([r[c] for r in kept], t) for c, t in (("side", pa.int32()), ("key", pa.int64()), ("label", pa.int64()), ("marks", pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(kept), at.type), *cols], names=["at", "side", "key", "label", "marks"])

    fields = [T.StructField("at", tiles.schema["at"].dataType), T.StructField("side", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("label", T.LongType()), T.StructField("marks", T.ArrayType(T.LongType()))]
    left_open = cut_lineage(tiles.mapInArrow(open_rows, T.StructType(fields))).join(texts, "key")
    tiles = left_open.groupBy("at").agg(F.collect_list(F.struct("side", "key", "label", "marks", "raw")).alias("rows")).select("at", "rows", F.col("at.same").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, same, tile, wide, left, right in _tile_sides(batch, words):
                hashes = [np.unique(shingle_hashes(r["raw"], shingle)) for r in tile]
                found = late_links(wide, [r["label"] for r in tile], hashes, left, right, radius, similarity, same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([tile[p]["key"] for p, _ in found], pa.int64()), pa.array([tile[q]["key"] for _, q in found], pa.int64())], schema=out)

    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) by links of texts whose ``shingle``-word sets have Jaccard ``similarity`` or more.

    ``words`` 64-bit fingerprints within ``radius`` bits give candidates; what the radius can lose is stated at
    ``RADIUS``, which holds for the default similarity and four words. At this similarity sizes of the sets
    differ by a factor of 1/similarity at most, so tiles are cut by size and only near sizes meet, besides the
    population counts that skip pairs of tiles. A tile pair passes on its nearest spanning forest; the exact
    check of those links follows on the texts, inside tiles first, and where one fails the links that it hid are
    checked too. Equal texts are one text from the start; texts without words are equal.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")).withColumn("key", F.xxhash64("raw"))
    members = cut_lineage(keyed.select("id", "key"))
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("marks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hashes], pa.int64()), pa.array([wide_fingerprint(h, words).view(np.int64) for h in hashes], pa.list_(pa.int64()))], schema=out)

    marks = keyed.select("key", "raw").mapInArrow(run, "key long, n long, marks array<long>")
    marks = cut_lineage(marks.groupBy("key").agg(F.first("n").alias("n"), F.first("marks").alias("marks")))
    reach = 4
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) * reach / float(-np.log(similarity)) + 1e-9).cast("int")
    sized = marks.withColumn("size", size)
    parts = sized.groupBy("size").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (2 * TILE), F.sum("n") / TILE_SHINGLES, F.lit(1))).cast("int").alias("parts"))
    tile_table = cut_lineage(sized.join(parts, "size").groupBy("size", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("key", "marks")).alias("rows")))
    tiles = tile_table.select("size", "part", F.struct(F.col("rows.key").alias("keys"), F.flatten("rows.marks").alias("marks")).alias("tile"))
    visits = tiles.select("tile", "part", "size", F.explode(F.sequence("size", F.col("size") + reach)).alias("at"))
    home = tiles.select(F.col("size").alias("at"), F.col("part").alias("home_part"), F.col("tile").alias("home"))
    met = visits.join(home, "at").where((F.col("size") != F.col("at")) | (F.col("part") <= F.col("home_part")))
    same = ((F.col("size") == F.col("at")) & (F.col("part") == F.col("home_part"))).alias("same")
    met = met.select("tile", "home", F.struct("size", "part", F.col("at").alias("home_size"), "home_part", same).alias("at"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (a, b) in enumerate(zip(*batch.columns[:2], strict=True)):
                at = batch.column(2).slice(k, 1)
                (ka, ma), (kb, mb) = ((x["keys"].values.to_numpy(), x["marks"].values.to_numpy().view(np.uint64).reshape(-1, words)) for x in (a, b))
                pa_, pb = (np.bitwise_count(m).sum(1) for m in (ma, mb))
                if pa_.min() > pb.max() + radius or pb.min() > pa_.max() + radius:
                    continue
                i, j, far = closest_forest(ma, mb, radius, at[0].as_py()["same"])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ka[i]), pa.array(kb[j]), at.take(pa.array(np.zeros(len(i), np.int64))), pa.array(far.astype(np.int32))], names=["a", "b", "at", "far"])

    pair_schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), met.schema["at"], T.StructField("far", T.IntegerType())])
    pairs = cut_lineage(met.mapInArrow(compare, pair_schema))
    forget(tile_table)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = keyed.select("key", "raw").join(needed, "key", "left_semi").groupBy("key").agg(F.first("raw").alias("raw"))
    texts = cut_lineage(texts)
    # links inside tiles are checked first; between tiles one for each two components is then enough, so that a
    # large group does not send its texts through every tile pair
    inner = cut_lineage(_checked(pairs.where("at.same").select("a", "b", "at"), texts, shingle, similarity))
    cross = _between(pairs.where("not at.same"), _tile_components(inner.where("good")))
    checked = inner.unionByName(cut_lineage(_checked(cross, texts, shingle, similarity)))
    good = checked.where("good").select("a", "b")
    failed = checked.where(~F.col("good")).select("at").distinct()
    known = cut_lineage(connected_components(good))
    more = cut_lineage(_links_behind_failures(failed, pairs, marks, texts, known, radius, words, shingle, similarity))
    for table in (pairs, texts, inner):
        forget(table)
    # the late links join components as nodes of a smaller graph
    joins = _labelled(_labelled(more, "a", known, "la"), "b", known, "lb").select("la", "lb")
    late = connected_components(joins, "la", "lb").withColumnsRenamed({"node": "label", "component": "joined"})
    nodes = known.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").withColumn("component", F.col("node")))
    linked = nodes.withColumnRenamed("component", "label").join(late, "label", "left").select("node", F.coalesce("joined", "label").alias("component"))
    heads = members.groupBy("key").agg(F.min("id").alias("head")).join(linked.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    return members.join(heads.join(least, "component").select("key", "component_id"), "key").select(F.col("id").alias(id_col), "component_id")
