"""Approximate nearest neighbours by NN-descent: a neighbour graph from joins of neighbours of neighbours, searched greedily.

Equal vectors are one node (with the k + 1 smallest ids as members; no result needs more). The graph starts from
TREES sorted orders: the signs of random projections, read as a number, bring near vectors together, and each block of
an order is compared within itself (equal signs are ordered by one more projection). Then ROUNDS joins: every node gathers its neighbours and its nearest reverse
neighbours with their vectors, and introduces them to each other; a pair is passed on if one of the two is new to the
node and if it beats what an end already holds. Each node keeps NEIGHBOURS edges. Vectors travel centred and in single
precision there, and distances are computed in double; every node that a walk meets is measured on the original vectors.

A query walks the graph from its own node, if it is one, and from a fixed number of entry nodes: each step expands the
EXPAND nearest nodes not expanded yet among its BEAM nearest, until none is left.

All steps are joins on node or query keys; a task streams over the sorted groups of its partition and holds one
batch. Every row of the table is a node; recall is measured against brute force in the tests and the README.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, neither does a
null vec_id; vectors are compared with those of the same dimension, each dimension that has queries has a graph of its
own; fewer candidates than k give fewer rows; ties go to the smaller vec_id; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import discard, materialize, small_batches, table

TOP = 10
NEIGHBOURS = 32
TREES = 8
BLOCK = 128
#: Neighbours that a node takes from its block of one order.
FROM_BLOCK = 12
#: Rounds end early when less than CALM of the edges are new.
ROUNDS = 7
CALM = 0.01
#: Of the neighbours that a node introduces to one of them, so many go on (the nearest).
INTRODUCED = 10
BEAM = 256
EXPAND = 24
ENTRIES = 16
STEPS = 16


def usable(vec: str = "embedding") -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def nodes_of(vectors: DataFrame, dim: int, k: int = TOP, vec: str = "embedding") -> DataFrame:
    """(node, v, members): distinct vectors of a dimension, the smallest vec_id naming each, members sorted."""
    rows = vectors.where(usable(vec) & (F.size(vec) == dim)).select("vec_id", F.transform(vec, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_nth") <= k + 1)
    return rows.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("node"), "v", "members")


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _singles(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of single-precision numbers as double precision."""
    return np.stack([np.frombuffer(x, np.float32) for x in column.to_pylist()]).astype(np.float64)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows, infinite on the diagonal."""
    x = x - x.mean(0)
    sq = (x * x).sum(1)
    dist = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(dist, np.inf)
    return dist


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key; only the last, open group is carried on."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        if not now.num_rows:
            continue
        keys = now.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


class Sketch:
    """Single-precision vectors, centred and scaled, and projection codes for sorted orders."""

    def __init__(self, nodes: DataFrame, trees: int = TREES) -> None:
        top = nodes.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("top"), F.count(F.lit(1)).alias("n")).first()
        some = nodes.orderBy(F.xxhash64("node"), "node").limit(1000).select("v").collect()  # a fixed number of vectors
        self.centre = np.array([r.v for r in some]).mean(0) if some else np.zeros(1)
        self.scale = 1.0 / (top.top or 1.0)
        self.bits = int(min(62, max(8, np.ceil(np.log2(max(2, top.n))) + 4)))
        self.trees = trees

    def of(self, rows: DataFrame) -> DataFrame:
        """(node, h, codes, fine) of rows (node, v)."""
        centre, scale, bits, trees = self.centre, self.scale, self.bits, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(11).normal(size=(trees, bits, len(centre)))
            last = np.random.default_rng(12).normal(size=(trees, len(centre)))
            weigh = 1 << np.arange(bits, dtype=np.int64)[::-1]
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("v"))
                    codes = np.stack([((x - centre) @ p.T > 0) @ weigh for p in planes], 1)
                    fine = (x - centre) @ last.T
                    h = ((x - centre) * scale).astype(np.float32)
                    yield pa.record_batch([batch.column("node"), pa.array([r.tobytes() for r in h], pa.binary()), pa.array(list(codes), pa.list_(pa.int64())), pa.array(list(fine), pa.list_(pa.float64()))], ["node", "h", "codes", "fine"])

        return rows.select("node", "v").mapInArrow(run, "node long, h binary, codes array<long>, fine array<double>")


_EDGES = "u long, v long, d float"
_HITS = "query_id long, rank int, vec_id long, score double"


def _edges(u: list, v: list, d: list) -> pa.RecordBatch:
    cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
    return pa.record_batch([pa.array(cat(u, np.int64)), pa.array(cat(v, np.int64)), pa.array(cat(d, np.float32))], ["u", "v", "d"])


def first_graph(sketches: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(u, v, d): the nearest found within blocks of the sorted orders."""
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sketches.select("node", "h", F.posexplode(F.arrays_zip("codes", "fine")).alias("tree", "at"))
    rows = rows.select("node", "h", "tree", F.col("at.codes").alias("code"), F.col("at.fine").alias("fine"))
    rows = rows.repartitionByRange(n, "tree", "code", "fine", "node").sortWithinPartitions("tree", "code", "fine", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("node").to_numpy(), None
            if not len(ids):
                continue
            x = _singles(batch.column("h"))
            u, v, d = [], [], []
            for at in np.array_split(np.arange(len(ids)), max(1, round(len(ids) / block))):
                k = min(FROM_BLOCK, neighbours, len(at) - 1)
                if k < 1:
                    continue
                dist = _squares(x[at])
                near = np.argpartition(dist, k - 1, 1)[:, :k]
                u.append(np.repeat(ids[at], k))
                v.append(ids[at][near].ravel())
                d.append(np.take_along_axis(dist, near, 1).ravel())
            yield _edges(u, v, d)

    return rows.mapInArrow(run, _EDGES)


def _nearest(edges: DataFrame, neighbours: int, by: str = "u", tie: str = "v") -> DataFrame:
    return edges.withColumn("_nth", F.row_number().over(W.partitionBy(by).orderBy("d", tie))).where(F.col("_nth") <= neighbours).drop("_nth")


def introduce(sketches: DataFrame, graph: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(u, v, d): pairs of neighbours of a common node that beat the farthest edge of u."""
    worst = graph.groupBy(F.col("u").alias("node")).agg(F.when(F.count(F.lit(1)) >= neighbours, F.max("d")).otherwise(F.lit(float("inf")).cast("float")).alias("worst"))
    known = sketches.select("node", "h").join(worst, "node", "left").select(F.col("node").alias("w"), "h", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
    back = _nearest(graph, neighbours, "v", "u").select(F.col("v").alias("u"), F.col("u").alias("w"), "new")
    around = graph.select("u", F.col("v").alias("w"), "new").union(back).groupBy("u", "w").agg(F.max("new").alias("new"))
    lively = around.join(known, "w")
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lively = lively.repartition(n, "u").sortWithinPartitions("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "u"):
            keys, ids, worst_ = (group.column(c).to_numpy() for c in ("u", "w", "worst"))
            new, x = group.column("new").to_numpy().astype(bool), _singles(group.column("h"))
            u, v, d = [], [], []
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                fresh = new[a:b]
                k = min(INTRODUCED, b - a - 1)
                if k < 1 or not fresh.any():
                    continue
                dist = _squares(x[a:b])
                dist[~(fresh[:, None] | fresh[None, :])] = np.inf
                near = np.argpartition(dist, k - 1, 1)[:, :k]
                got = np.take_along_axis(dist, near, 1)
                i, j = np.nonzero(got < worst_[a:b, None])
                u.append(ids[a:b][i])
                v.append(ids[a:b][near[i, j]])
                d.append(got[i, j])
            yield _edges(u, v, d)

    return lively.mapInArrow(run, _EDGES)


def build_graph(sketches: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, d, new): about `neighbours` nearest of each node."""
    first = first_graph(sketches, neighbours).groupBy("u", "v").agg(F.min("d").alias("d"))
    graph = materialize(_nearest(first, neighbours).withColumn("new", F.lit(True)), "graph")
    for _ in range(rounds):
        met = introduce(sketches, graph, neighbours).withColumn("new", F.lit(True))
        both = graph.withColumn("new", F.lit(False)).union(met).groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        old, graph = graph, materialize(_nearest(both, neighbours), "graph")
        discard(old)
        if (graph.agg(F.avg(F.col("new").cast("double"))).first()[0] or 0.0) < CALM:
            break
    return graph


def _near(pairs: DataFrame, sketches: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, node) plus d, the squared distance in single precision, by which the walk is steered."""
    full = pairs.join(sketches.select("node", "h"), "node").join(queries.select("query_id", F.col("h").alias("q")), "query_id").select("query_id", "node", "h", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = ((_singles(batch.column("h")) - _singles(batch.column("q"))) ** 2).sum(1)
                yield pa.record_batch([batch.column("query_id"), batch.column("node"), pa.array(d.astype(np.float32))], ["query_id", "node", "d"])

    return full.mapInArrow(run, "query_id long, node long, d float")


def _measured(pairs: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, node) plus score, the Euclidean distance of the original vectors in double precision."""
    full = pairs.join(nodes.select("node", "v"), "node").join(queries.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "node", "v", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(((_matrix(batch.column("v")) - _matrix(batch.column("q"))) ** 2).sum(1))
                yield pa.record_batch([batch.column("query_id"), batch.column("node"), pa.array(d)], ["query_id", "node", "score"])

    return full.mapInArrow(run, "query_id long, node long, score double")


def search(sketches: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query_id, node, d): all nodes that each query (query_id, h, own: its node or null) has met on its walk."""
    out = graph.select("u", "v")
    back = _nearest(graph, NEIGHBOURS, "v", "u").select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = materialize(out.union(back).groupBy("u").agg(F.collect_set("v").alias("to")), "links")  # at most 2 * NEIGHBOURS
    entries = [r.node for r in sketches.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    start = queries.select("query_id", F.explode(F.array(*(F.lit(e).cast("long") for e in entries))).alias("node"))
    own = queries.where("own is not null").select("query_id", F.col("own").alias("node"))
    seen = materialize(_near(start.union(own).distinct(), sketches, queries).withColumn("expanded", F.lit(False)), "seen")
    by = W.partitionBy("query_id").orderBy("d", "node")
    for _ in range(STEPS):
        held = seen.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= beam)
        front = held.where(~F.col("expanded")).withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= EXPAND).select("query_id", "node")
        front = materialize(front, "front")
        if front.isEmpty():
            break
        met = front.join(links, front.node == links.u).select("query_id", F.explode("to").alias("node")).distinct()
        met = met.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        told = _near(met, sketches, queries).withColumn("expanded", F.lit(False))
        mark = front.withColumn("now", F.lit(True))
        kept = seen.join(mark, ["query_id", "node"], "left").select("query_id", "node", "d", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        old, seen = seen, materialize(kept.union(told), "seen")
        discard(old)
        discard(front)
    return seen.select("query_id", "node", "d")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (query_id, v array<double>)."""
    out = vectors.sparkSession.createDataFrame([], _HITS)
    queries = queries.where("v is not null")
    for dim in sorted(r.dim for r in queries.select(F.size("v").alias("dim")).distinct().collect()):  # one row a dimension
        out = out.union(_within(vectors, queries.where(F.size("v") == dim), dim, k, vec))
    return out


def _within(vectors: DataFrame, queries: DataFrame, dim: int, k: int, vec: str) -> DataFrame:
    """nearest() among the vectors of one dimension."""
    nodes = materialize(nodes_of(vectors, dim, k, vec), "nodes")
    if nodes.isEmpty():
        return vectors.sparkSession.createDataFrame([], _HITS)
    small_batches(nodes.sparkSession, rows=BLOCK * 60, size=16 << 20)
    sketch = Sketch(nodes)
    sketches = materialize(sketch.of(nodes), "sketches")
    graph = build_graph(sketches)
    asked = sketch.of(queries.select(F.col("query_id").alias("node"), "v")).select(F.col("node").alias("query_id"), "h")
    own = queries.join(nodes.select(F.col("node").alias("own"), "v"), "v", "left").select("query_id", "own")
    met = search(sketches, graph, materialize(asked.join(own, "query_id"), "asked"))
    found = _measured(met.select("query_id", "node"), nodes, queries)
    near = found.withColumn("_nth", F.row_number().over(W.partitionBy("query_id").orderBy("score", "node"))).where(F.col("_nth") <= k + 1)
    each = near.join(nodes.select("node", "members"), "node").select("query_id", F.explode("members").alias("vec_id"), "score")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = each.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(usable() & (F.col("vec_id") % 100 == 0))
    queries = materialize(asked.select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), "queries")
    return nearest(vectors, queries)
