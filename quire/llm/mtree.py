"""Exact top-k by inner product with M-trees: paged metric nodes, covering radii, parent distances, best-first search.

Vectors become integers, floor(SCALE * x), and scores are exact integers. Inner product is no metric; with M the largest
norm, a vector v lifted to (v, sqrt(M^2 - |v|^2)) and a query lifted to (q, 0) are at the squared distance
|q|^2 + M^2 - 2 q.v, so the nearest lifted vectors have the highest scores.

The vectors are dealt into trees of about TREE rows: by their nearest pivot (a bounded sample), and within a crowded
pivot by hash. Each tree is built in one task and written as pages: routing objects with covering radius and distance to
the parent, and leaf entries with distance to their routing object. A query first searches the tree of its own
pivot. The score of its k-th best there bounds all other trees: a tree whose root ball cannot reach that score is not
visited at all, the others are searched best-first, subtrees and entries being passed over where
|d(q, parent) - d(parent, entry)| - radius shows, without a distance computation, that they cannot reach the bound.

Queries meet trees by tree and block of about BLOCK queries, so a task holds one tree and one block. Of equal vectors
only the k + 1 with the smallest ids are candidates; no query's result needs more.

Edge cases: null vectors, vectors with null or non-finite components and empty vectors take no part; vectors are
compared with those of the same dimension; a null vec_id takes no part; ties go to the smaller vec_id; fewer
candidates than k give fewer rows; an empty table gives none. Components are taken to be below 2^20, so that scores fit
64 bits. Repeated vec_ids are separate candidates, except that a query never returns its own id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize, small_batches, table

SCALE = 1024
TOP = 10
TREE = 8192
BLOCK = 1024
LEAF = 48
FANOUT = 16
#: Pivots that deal vectors out to trees; a fixed number of vectors is broadcast, whatever the table's size.
PIVOTS = 64
#: Relative slack of all bounds, far above what rounding does to a distance.
SLACK = 1e-9


def usable(vec: str = "embedding") -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v as array<long>."""
    return vectors.where(usable(vec)).select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Tree:
    """An M-tree over integer vectors in the lifted space. Pages are plain arrays, so that a node is a row of a table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift2: int) -> None:
        self.ids, self.v, self.lift2 = ids, vectors, lift2
        self.norm2 = (vectors * vectors).sum(1)
        self.extra = np.sqrt(np.maximum(lift2 - self.norm2, 0).astype(float))
        self.pages: list[dict] = []
        if len(ids):
            root = self._central(np.arange(len(ids)))
            self.root = root
            self.top, self.radius = self._build(np.arange(len(ids)), root)

    def _distance(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances between stored vectors. The lifted component is real, so this is rounded; SLACK covers that."""
        d = self.norm2[i] + self.norm2[rows] - 2 * (self.v[rows] @ self.v[i])
        return np.sqrt(np.maximum(d, 0) + (self.extra[rows] - self.extra[i]) ** 2)

    def _central(self, rows: np.ndarray) -> int:
        middle = self.v[rows].mean(0)
        return int(rows[np.argmin(((self.v[rows] - middle) ** 2).sum(1))])

    def _build(self, rows: np.ndarray, centre: int) -> tuple[int, float]:
        """Page number and covering radius of the subtree over rows, seen from its routing object."""
        to_centre = self._distance(centre, rows)
        if len(rows) <= LEAF or to_centre.max() == 0:
            order = np.argsort(to_centre, kind="stable")
            self.pages.append({"leaf": True, "rows": rows[order], "parent": to_centre[order]})
            return len(self.pages) - 1, float(to_centre.max())
        seeds = [int(rows[np.argmax(to_centre)])]
        nearest = self._distance(seeds[0], rows)
        owner = np.zeros(len(rows), np.int64)
        for k in range(1, min(FANOUT, 1 + len(rows) // LEAF)):
            seeds.append(int(rows[np.argmax(nearest)]))
            d = self._distance(seeds[-1], rows)
            owner = np.where(d < nearest, k, owner)
            nearest = np.minimum(nearest, d)
        objects, children, radii = [], [], []
        for k in range(len(seeds)):
            part = rows[owner == k]
            if len(part):
                mid = self._central(part) if len(part) < len(rows) else seeds[k]
                child, radius = self._build(part, mid)
                objects.append(mid)
                children.append(child)
                radii.append(radius)
        objects = np.array(objects)
        self.pages.append({"leaf": False, "rows": objects, "children": np.array(children), "radius": np.array(radii), "parent": self._distance(centre, objects)})
        return len(self.pages) - 1, float(to_centre.max())

    def search(self, q: np.ndarray, own: int, k: int, bound: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, vec_id), and how many scores were computed. bound: scores below it are of no use."""
        base = int((q * q).sum()) + self.lift2
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst on top
        far = np.sqrt(max(0, base - 2 * bound)) * (1 + SLACK) + SLACK if bound is not None else np.inf
        dq = float(np.sqrt(max(0, base - 2 * int(q @ self.v[self.root]))))
        computed = 1
        queue = [(max(0.0, dq - self.radius), self.top, dq)]
        while queue:
            low, number, dq = heapq.heappop(queue)
            if low > far:
                break
            page = self.pages[number]
            reach = page.get("radius", 0.0)
            near = np.flatnonzero(np.abs(dq - page["parent"]) - reach <= far)
            rows = page["rows"][near]
            scores = self.v[rows] @ q
            computed += len(rows)
            if page["leaf"]:
                for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if i == own or (bound is not None and s < bound):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    far = min(far, np.sqrt(max(0, base - 2 * best[0][0])) * (1 + SLACK) + SLACK)
            else:
                d = np.sqrt(np.maximum(base - 2 * scores, 0).astype(float))
                lows = np.maximum(0.0, d - page["radius"][near])
                for j in np.flatnonzero(lows <= far):
                    heapq.heappush(queue, (float(lows[j]), int(page["children"][near[j]]), float(d[j])))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


_PAGES = "tree long, page int, leaf boolean, top boolean, reach double, lift2 long, ids binary, v binary, children binary, radius binary, parent binary"


def _to_pages(tree: int, t: Tree) -> pd.DataFrame:
    rows = []
    for n, p in enumerate(t.pages):
        radius = p.get("radius", np.zeros(0))
        rows.append((tree, n, p["leaf"], n == t.top, t.radius, t.lift2, t.ids[p["rows"]].tobytes(), t.v[p["rows"]].tobytes(), p.get("children", np.zeros(0, np.int64)).tobytes(), radius.tobytes(), p["parent"].tobytes()))
    root = (tree, -1, False, False, t.radius, t.lift2, t.ids[[t.root]].tobytes(), t.v[[t.root]].tobytes(), b"", b"", b"")
    return pd.DataFrame([*rows, root], columns=[c.split()[0] for c in _PAGES.split(", ")])


def _from_pages(pages: pd.DataFrame) -> Tree:
    pages = pages.sort_values("page")
    root, pages = pages.iloc[0], pages.iloc[1:]
    dim = len(root.v) // 8
    t = Tree(np.zeros(0, np.int64), np.zeros((0, dim), np.int64), int(root.lift2))
    ids, vectors, n = [], [], 0
    for p in pages.itertuples():
        own = np.frombuffer(p.ids, np.int64)
        ids.append(own)
        vectors.append(np.frombuffer(p.v, np.int64).reshape(len(own), dim))
        page = {"leaf": p.leaf, "rows": np.arange(n, n + len(own)), "parent": np.frombuffer(p.parent)}
        if not p.leaf:
            page |= {"children": np.frombuffer(p.children, np.int64), "radius": np.frombuffer(p.radius)}
        else:
            page["radius"] = 0.0
        t.pages.append(page)
        n += len(own)
        if p.top:
            t.top, t.radius = p.page, p.reach
    t.ids, t.v = np.concatenate([*ids, np.frombuffer(root.ids, np.int64)]), np.concatenate([*vectors, np.frombuffer(root.v, np.int64).reshape(1, dim)])
    t.root = n
    return t


def distinct_vectors(vectors: DataFrame, k: int = TOP) -> DataFrame:
    """vectors (vec_id, v), of equal ones only the k + 1 with the smallest ids."""
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")


def _assign(vectors: DataFrame, pivots: list[tuple[int, np.ndarray]]) -> DataFrame:
    """vectors plus pivot: the number of the nearest pivot of the same dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, p in shared.value:
            by_dim.setdefault(len(p), []).append((n, p))
        stacked = {d: (np.array([n for n, _ in ps]), np.stack([p for _, p in ps])) for d, ps in by_dim.items()}
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                numbers, ps = stacked.get(len(v), (None, None))
                out.append(-len(v) if numbers is None else int(numbers[np.argmin(((ps - np.array(v)) ** 2).sum(1))]))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "pivot"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{kinds}, pivot long")


def build(vectors: DataFrame, lift2: int, k: int = TOP) -> tuple[DataFrame, DataFrame, list]:
    """(pages, homes, pivots): all trees as pages; homes: (pivot, parts), how many trees a pivot's vectors make."""
    small_batches(vectors.sparkSession)
    distinct = materialize(distinct_vectors(vectors, k), "vectors")
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # a fixed number of rows
    pivots = [(n, np.array(r.v, np.int64)) for n, r in enumerate(sample)]
    placed = materialize(_assign(distinct, pivots), "placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("parts"))
    sizes = materialize(sizes, "parts")
    tree = F.xxhash64("pivot", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    keyed = placed.join(F.broadcast(sizes), "pivot").withColumn("tree", tree).select("tree", "vec_id", "v")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return _to_pages(key[0], Tree(rows.vec_id.to_numpy(np.int64), np.array(rows.v.tolist(), np.int64), lift2))

    return materialize(keyed.groupBy("tree").applyInPandas(grow, _PAGES), "pages"), sizes, pivots


_HITS = "query_id long, vec_id long, score long, computed long"


def _search(k: int):
    def run(_key: tuple, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            t = _from_pages(pages)
            for q in queries.itertuples():
                v = np.array(q.v, np.int64)
                if len(v) == t.v.shape[1]:
                    hits, computed = t.search(v, q.query_id, k, None if pd.isna(q.bound) else int(q.bound))
                    out += [(q.query_id, i, s, computed) for s, i in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "computed"]).astype("int64")

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of queries (query_id, v) with vectors (vec_id, v)."""
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    lift2 = vectors.agg(F.max(norm2)).first()[0]
    if lift2 is None:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    pages, parts, pivots = build(vectors, int(lift2), k)
    asked = materialize(_assign(queries, pivots), "asked")
    # first the tree of the query's own pivot
    home = asked.join(F.broadcast(parts), "pivot").withColumn("tree", F.xxhash64("pivot", F.pmod(F.xxhash64("query_id"), F.col("parts"))))
    home = home.withColumns({"bound": F.lit(None).cast("long"), "block": F.pmod(F.xxhash64("query_id", F.lit(1)), F.ceil(F.count(F.lit(1)).over(W.partitionBy("tree")) / BLOCK))})
    first = _met(pages, home, k)
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    # then all trees whose root ball reaches the bound
    roots = pages.where("page = -1").select("tree", "reach", "lift2", F.col("v").alias("root"))
    asked = asked.drop("pivot").join(bounds, "query_id", "left").join(home.select("query_id", F.col("tree").alias("home")), "query_id", "left")
    rest = _reached(asked, roots)
    rest = rest.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.ceil(F.count(F.lit(1)).over(W.partitionBy("tree")) / BLOCK)))
    second = _met(pages, rest, k)
    return _best(first.union(second).select("query_id", "vec_id", "score"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(pages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of asked (query_id, v, bound, tree, block): each tree is sent to each block of queries that visits it."""
    asked = materialize(asked.select("tree", "block", "query_id", "v", "bound"), "asked")
    blocks = asked.select(F.col("tree").alias("to"), F.col("block").alias("of")).distinct().toDF("tree", "block")
    sent = pages.join(blocks, "tree")
    return materialize(sent.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(_search(k), _HITS), "hits")


def _reached(asked: DataFrame, roots: DataFrame) -> DataFrame:
    """asked once for each tree other than its home that may hold a score of its bound or more.

    Trees' roots go round in directory blocks of BLOCK roots: a block of queries is set against each, in one task.
    """
    n_roots = roots.count()
    roots = roots.withColumn("part", F.pmod(F.col("tree"), F.lit(max(1, -(-n_roots // BLOCK)))))
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n_roots // BLOCK)) - 1).cast("long"))
    dealt_ = asked.withColumn("part", F.explode(every))
    dealt_ = dealt_.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK)))))
    dealt_ = materialize(dealt_, "dealt")
    blocks = dealt_.select(F.col("part").alias("to"), F.col("block").alias("of")).distinct().toDF("part", "block")
    sent = roots.join(blocks, "part")

    def run(_key: tuple, queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(near):
            centres = [np.frombuffer(r, np.int64) for r in near.root]
            for q in queries.itertuples():
                v = np.array(q.v, np.int64)
                base = int((v * v).sum())
                for tree, reach, lift2, c in zip(near.tree, near.reach, near.lift2, centres, strict=True):
                    if len(c) != len(v) or tree == q.home:
                        continue
                    if not pd.isna(q.bound):
                        d = np.sqrt(max(0, base + int(lift2) - 2 * int(c @ v)))
                        far = np.sqrt(max(0, base + int(lift2) - 2 * int(q.bound)))
                        if d - reach > far * (1 + SLACK) + SLACK:
                            continue
                    out.append((tree, q.query_id, q.v, q.bound))
        return pd.DataFrame(out, columns=["tree", "query_id", "v", "bound"]).astype({"bound": "Int64"})

    groups = dealt_.groupBy("part", "block").cogroup(sent.groupBy("part", "block"))
    return groups.applyInPandas(run, "tree long, query_id long, v array<long>, bound long")


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")), "quantised")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "v")
    return top_k(vectors, queries)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
