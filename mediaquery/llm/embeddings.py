"""Near-duplicate embeddings within a label by NN-descent.

Equal vectors collapse to one representative. Every representative keeps a short list of near neighbours, started
from windows over random-projection orders and refined by joins: around each vector its list and the lists it is
in meet, members are compared, and better neighbours enter. When few entries change, list edges over the
threshold (checked in double precision) give components. A list full of links may have lost some, and a link that
both its ends' lists lost has two such ends: their lists double among themselves, and what stays full is compared in
exact blocks, which join components. Links are counted over all members of a component, in exact blocks too. An audit
compares a bounded set of queries with all vectors; too few of their links found means more orders and another
descent, and after the last try exact blocks of all vectors.

Search compares vectors as bytes; only exact cosines count as links. Vectors that are null, empty, zero or hold
null or non-finite values, and rows without a label, link with nothing and are their own component. Repeated
rows count as vectors of their own. Empty tables give no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquery.llm.common import cut_lineage
from mediaquery.llm.components import connected_components, stars

#: Length of a neighbour list while the descent runs.
NEIGHBOURS = 8
#: Random orders to start from, vectors compared around a place in an order.
ORDERS, SPAN = 4, 48
#: Members of a join group or of an exact block.
GROUP, BLOCK = 48, 256
#: Cosines of bytes are off by far less. Lists full of links double up to LONGEST while they are more than FEW.
MARGIN, LONGEST, FEW = 0.05, 64, 8_192
#: Audited queries, wanted share of their links, and tries.
QUERIES, RECALL, TRIES = 512, 0.95, 4
_BITS = 48
_TRIPLE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float32())])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.rint(rows / np.abs(rows).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _cosines(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), dtype=np.int8).reshape(len(packed), -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def usable(df: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that can link."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)).where(~bad & F.exists(v, lambda x: x != 0))


def representatives(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(rep, copies, label, vec): one row per distinct vector of a label; rep is the smallest id."""
    v = F.transform(F.col(vec).cast("array<double>"), lambda x: x + 0.0)
    return df.groupBy(F.col(label).alias("label"), v.alias("vec")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))


def _packed(reps: DataFrame) -> DataFrame:
    """(rep, label, dim, q): vectors as bytes; other dimensions of a label never meet."""
    out = pa.schema([("rep", pa.int64()), ("label", pa.string()), ("q", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [_bytes(np.asarray(x.values.to_numpy(), dtype=float)[None])[0].tobytes() for x in batch.column(2)]
            names = [f"{len(x)}:{y}" for x, y in zip(q, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(q, pa.binary())], schema=out)

    return reps.select(F.col("rep").cast("long").alias("rep"), F.col("label").cast("string").alias("label"), "vec").mapInArrow(run, "rep long, label string, q binary")


def _best(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Per member its k most similar others, above its floor."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    s = np.take_along_axis(sims, top, axis=1)
    good = s > (-1.5 if floor is None else floor[:, None])
    return np.repeat(ids, k).reshape(-1, k)[good], ids[top][good], s[good]


def _triples(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], schema=_TRIPLE)


def start_lists(packed: DataFrame, orders: range, k: int = NEIGHBOURS) -> DataFrame:
    """(u, v, s) from windows over the orders: sign codes of random projections, sorted by range."""
    coded = pa.schema([("label", pa.string()), ("turn", pa.int32()), ("code", pa.int64()), ("rep", pa.int64()), ("q", pa.binary())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows, q = batch.column(0), batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in q])
            for dim in np.unique(sizes):
                mine = np.nonzero(sizes == dim)[0]
                x = np.frombuffer(b"".join(q[i] for i in mine), dtype=np.int8).reshape(-1, dim).astype(np.float32)
                for turn in orders:
                    if (turn, dim) not in planes:
                        planes[turn, dim] = np.random.default_rng(1000 + turn).normal(size=(dim, _BITS)).astype(np.float32)
                    code = ((x @ planes[turn, dim]) > 0) @ (1 << np.arange(_BITS, dtype=np.int64)[::-1])
                    at = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(at), pa.array(np.full(len(mine), turn), pa.int32()), pa.array(code), rows.take(at), batch.column(2).take(at)], schema=coded)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, packs = None, [], []

        def flush():
            if len(ids) > 1:
                yield _triples(*_best(np.array(ids), _cosines(packs), k))

        for batch in batches:
            for label, turn, _, rep, q in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (label, turn) or len(ids) >= SPAN:
                    yield from flush()
                    keep = SPAN // 2 if key == (label, turn) else 0  # windows overlap by half
                    ids, packs = (ids[-keep:], packs[-keep:]) if keep else ([], [])
                    key = (label, turn)
                ids.append(rep)
                packs.append(q)
        yield from flush()

    by = ["label", "turn", "code", "rep"]
    ordered = packed.mapInArrow(codes, "label string, turn int, code long, rep long, q binary").repartitionByRange(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(near, "u long, v long, s float")


def _shorten(triples: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return triples.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")


def descend(packed: DataFrame, lists: DataFrame, k: int = NEIGHBOURS, rounds: int = 6, settled: float = 0.02) -> DataFrame:
    """Refined lists: rounds of neighbours-of-neighbours joins until few entries change."""
    lists = cut_lineage(_shorten(lists, k))
    for _ in range(rounds):
        floor = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(-1.5)).alias("floor"))
        known = packed.select(F.col("rep").alias("m"), "q").join(floor.select(F.col("u").alias("m"), "floor"), "m")
        around = lists.select(F.col("u").alias("w"), F.col("v").alias("m")).unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("m"))).distinct()
        # a vector that is in very many lists meets them in groups, so none is left out
        parts = around.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
        members = around.join(parts, "w").select("w", "m", F.pmod(F.xxhash64("m"), F.col("parts")).alias("part")).join(known, "m")
        groups = members.groupBy("w", "part").agg(F.collect_list(F.struct("m", "floor", "q")).alias("x")).where(F.size("x") > 1)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for ids, floors, packs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    out.append(_best(np.array(ids), _cosines(packs), k, np.array(floors)))
                if out:
                    yield _triples(*[np.concatenate(c) for c in zip(*out, strict=True)])

        found = groups.select("x.m", "x.floor", "x.q").mapInArrow(meet, "u long, v long, s float")
        new = cut_lineage(_shorten(found.unionByName(lists), k))
        changed, total = new.join(lists, ["u", "v"], "left_anti").count(), new.count()
        lists = new
        if changed <= settled * total:
            break
    return lists


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u): vectors whose list is full and ends in what may be a link, so further links may be missing."""
    ends = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    return cut_lineage(ends.where((F.col("n") >= k) & (F.col("s") >= threshold - MARGIN)).select("u"))


def enlarge(packed: DataFrame, lists: DataFrame, orders: range, threshold: float, few: int = FEW, most: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Lists with longer ones for saturated vectors, and the vectors (u) that stay saturated.

    The list of a vector that is not saturated holds all its links, so longer lists are searched among saturated ones only.
    """
    k = NEIGHBOURS
    full = _saturated(lists, k, threshold)
    while k < most and full.count() > few:
        k *= 2
        some = cut_lineage(packed.join(full.withColumnRenamed("u", "rep"), "rep"))
        known = lists.join(full, "u").join(full.withColumnRenamed("u", "v"), "v").select("u", "v", "s")
        longer = descend(some, start_lists(some, orders, k).unionByName(known), k)
        lists = cut_lineage(lists.unionByName(longer))
        full = _saturated(longer, k, threshold)
    return lists, full


def _edges(lists: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """List entries whose exact cosine reaches the threshold; bytes are off by far less than the margin."""
    near = lists.where(F.col("s") >= threshold - MARGIN).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    with_a = near.join(reps.select(F.col("rep").alias("a"), F.col("vec").alias("x")), "a")
    both = with_a.join(reps.select(F.col("rep").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                good.append(p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def join_components(reps: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``groups`` with components joined where two of ``reps`` link, all compared in exact blocks."""
    home = groups.select(F.col("node").alias("rep"), "component")
    known = reps.select("rep", F.concat_ws(":", F.size("vec"), F.col("label").cast("string")).alias("key"), "vec").join(home, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = known.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    # dealt by block, or a label's blocks would stay in the one task that the join by key leaves them in
    cut = known.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).repartition("key", "part")
    blocks = cut_lineage(cut.groupBy("key", "parts", "part").agg(F.collect_list(F.struct("component", "vec")).alias("x")).select("key", "parts", "part", F.col("x.component").alias("c"), F.flatten("x.vec").alias("v")))
    left = blocks.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
    right = blocks.select("key", F.col("part").alias("other"), F.col("c").alias("c2"), F.col("v").alias("v2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, va, b, vb in zip(*batch.columns, strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                x, y = (_unit(v.values.to_numpy().reshape(len(c), -1)) for c, v in ((a, va), (b, vb)))
                i, j = np.nonzero((x @ y.T >= threshold) & (a[:, None] != b[None, :]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in stars(a[i], b[j])], names=["a", "b"])

    found = cut_lineage(left.join(right, ["key", "other"]).select("c", "v", "c2", "v2").mapInArrow(run, "a long, b long"))
    if found.isEmpty():
        return groups
    return cut_lineage(connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)))


def audit_recall(reps: DataFrame, groups: DataFrame, threshold: float, queries: int = QUERIES) -> float:
    """Share of true links of a bounded, hashed set of queries whose ends are in one component (a superset of links found)."""
    asked = reps.orderBy(F.xxhash64("rep"), "rep").limit(queries).select("rep", F.col("label").cast("string").alias("label"), "vec").collect()
    by: dict[tuple, tuple] = {}
    for key in {(r["label"], len(r["vec"])) for r in asked}:
        own = [r for r in asked if (r["label"], len(r["vec"])) == key]
        by[key] = np.array([r["rep"] for r in own]), _unit(np.array([r["vec"] for r in own]))
    shared = reps.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, label, vec in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (label, len(vec)) in shared.value:
                    ids, x = shared.value[label, len(vec)]
                    hit = ids[(x @ _unit(np.array([vec]))[0] >= threshold) & (ids != rep)]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(np.full(len(hit), rep))], names=["a", "b"])

    true = reps.select(F.col("rep").cast("long"), F.col("label").cast("string"), "vec").mapInArrow(run, "a long, b long")
    side = lambda n: groups.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    got = true.join(side("a"), "a", "left").join(side("b"), "b", "left").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("hit")).first()
    return 1.0 if not got["n"] else (got["hit"] or 0) / got["n"]


def _link_counts(reps: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): vectors linked with each representative, from exact blocks inside components; no pair leaves a task."""
    inside = groups.select(F.col("node").alias("rep"), "component").join(reps.select("rep", "copies", "vec"), "rep")
    parts = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cut = inside.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = cut_lineage(cut.groupBy("component", "parts", "part").agg(F.collect_list(F.struct("rep", "copies", "vec")).alias("x")).select("component", "parts", "part", F.col("x.rep").alias("ids"), F.col("x.copies").alias("n"), F.flatten("x.vec").alias("v")))
    left = blocks.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).drop("parts")
    right = blocks.select("component", F.col("part").alias("other"), *[F.col(c).alias(c + "2") for c in ("ids", "n", "v")])
    met = left.join(right, ["component", "other"]).select("ids", "n", "v", "ids2", "n2", "v2", (F.col("part") == F.col("other")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = [], []
            for a, na, va, b, nb, vb, same in zip(*batch.columns, strict=True):
                x, y = (_unit(v.values.to_numpy().reshape(len(i.values), -1)) for i, v in ((a, va), (b, vb)))
                linked = x @ y.T >= threshold
                if same.as_py():
                    np.fill_diagonal(linked, False)
                ids.append(a.values.to_numpy())
                sums.append(linked @ nb.values.to_numpy())
                if not same.as_py():
                    ids.append(b.values.to_numpy())
                    sums.append(na.values.to_numpy() @ linked)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums).astype(np.int64))], names=["rep", "links"])

    return met.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    able = usable(rows, "vec", "label")
    reps = cut_lineage(representatives(able, "id", "vec", "label"))
    packed = cut_lineage(_packed(reps))
    lists = None
    for attempt in range(TRIES):
        orders = range(attempt * ORDERS, (attempt + 1) * ORDERS)
        begin = start_lists(packed, orders)
        lists = descend(packed, begin if lists is None else begin.unionByName(lists))
        lists, full = enlarge(packed, lists, orders, threshold)
        groups = cut_lineage(connected_components(_edges(lists, reps, threshold)))
        groups = join_components(reps.join(full.withColumnRenamed("u", "rep"), "rep"), groups, threshold)
        if audit_recall(reps, groups, threshold) >= RECALL:
            break
    else:  # lists still miss too much
        groups = join_components(reps, groups, threshold)
    found = reps.select("rep", "copies", "label", "vec").join(_link_counts(reps, groups, threshold), "rep", "left").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    same = F.transform(F.col("vec").cast("array<double>"), lambda x: x + 0.0)
    keyed = able.select("id", "label", same.alias("vec")).select("id", "label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    heads = found.select("label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.join(heads, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    rest = rows.join(linked.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
