"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, windows, recursion.

Documents are sets of word shingles. 1 - Jaccard is a metric, and so is the size of the symmetric difference. Two sets
within the threshold differ in at most r shingles, r growing with the smaller size. The join goes down in levels:

1. Equal sets fall together by a 128-bit digest; one node stands for each class of them.
2. Most documents are far from everything. A shingle that no other node has is lone, and the share of its lone
   shingles bounds a document's distance to all others from below. A first pass counts lone shingles within a fixed part of the hash
   space (SAMPLE times as large as the share of shingles that may be lone), so that it counts a bound of the bound; what
   remains is counted again on whole sets, twice. For each shingle the smallest and the largest node are summed up;
   where they are equal it is lone. No shingle, however common, is ever gathered or joined with itself.
   Regions of the subspaces. Sizes form bands (distance to the empty set, a first pivot), and a document near the edge
   of a band is also placed in the band below: the window that the triangle inequality asks for. In a band, the
   shingles' hashes are dealt into m segments, m about twice r. Distances add up over segments, so of m segments at least m - r are
   at distance 0: the two documents lie in the Voronoi cell of the same segment content, m - r times. Pivots that were
   sampled documents cannot serve here: nearly all documents are at distance exactly 1 from any of them, every window
   would take in every region. Cells are ordered by their size, and of its
   cells a document leaves the m - r - 1 fullest: two documents that agree on m - r cells still meet in one.
3. Inside a cell, the pivot is the member that shares most cells with others, a hub; cells with one pivot make one
   region around it. Here, among documents that share content, distances to documents tell something:
   * A region of at most LEAF members and LEAF_ITEMS shingles is joined by one task, in memory: members are dealt to the
     nearest of some far-apart pivots among them (exact Jaccard distances); a member also goes to the region of every other
     pivot that the triangle inequality leaves open (no more than twice the threshold farther than its own, and within
     the region's covering radius plus the threshold); regions are divided in turn. Where distances are too alike for that to
     divide anything, blocks of TILE members are compared by a product of their 0/1 matrices.
   * A larger region is told its members' distances to the pivot and the differences E. Members within the threshold
     join the pivot's component. Seen from the pivot, x and y differ by the difference of E(x) and E(y), and the triangle
     inequality bounds how much of them must be common: (|E(x)| + |E(y)| - r) / 2 items. So the region is dealt again
     into cells by the rarest items of the differences, as many as that bound asks for. Members near the pivot are
     linked already, so only cells with a far member go on, if their members belong to more than one component.
   Each level takes a pivot out of a region, so the recursion ends.

Results come as a row for each document with the class or component it is in. Nothing is collected, no group of unbounded size is
held in memory, and all tables between rounds are written to the shared folder.

Edge cases: a null or empty text has an empty set, is linked with nothing and is its own component; with fewer words
than a shingle takes, the whole sequence is the one shingle; rows that share a doc_id are one document in
join_components(), linked with whatever any of their texts is linked with; rows without a doc_id have no component
(null); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import components, discard, materialize, small_batches, table
from .words import mix, shingle_sets

#: The first pass counts among so many times the shingles that may be lone.
SAMPLE = 1.6
#: Segments beyond r, as a multiple of r.
SECOND = 1.2
#: Regions of at most so many members, with at most so many shingles (8 bytes each), are joined within one task.
LEAF = 4096
LEAF_ITEMS = 1 << 22
#: Members compared at once by a matrix product, and tokens in one such matrix.
TILE = 256
COLUMNS = 4096
#: Pivots of a division within a task; regions that keep more than this share of the members are not divided again.
PIVOTS = 12
SHRINKS = 0.6
#: Ids of candidates up to this many (at most 48 bytes each) are broadcast to the scan of texts; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
_U = np.uint64


def differ_most(n: int, num: int, den: int) -> int:
    """The largest symmetric difference of sets within the threshold, n being the smaller size."""
    return (den - num) * n // num


class Bands:
    """Size bands and their numbers of segments for a threshold of num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = next(n for n in range(1, 10**6) if differ_most(n, num, den)) if num < den else 1 << 62
        self.edges = [self.low]

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, r) for a set of n: its own band, and the one below if a smaller partner may lie there."""
        while self.edges[-1] <= n:
            e = self.edges[-1]
            self.edges.append(max(e + 1, -(-e * 3 // 2), -(-e * self.den // self.num)))
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        out = []
        for band in (own, own - 1):
            if band >= 0 and (band == own or n * self.num <= (self.edges[own] - 1) * self.den):
                out.append((band, differ_most(self.edges[band + 1] - 1, self.num, self.den)))
        return out


def cell_keys(found: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """For each band of a set: (how many of its fullest cells it may still leave, keys of its cells).

    Empty segments count as the fullest cells of all and are left first.
    """
    out = []
    for band, r in bands.of(len(found)):
        m = r + 2 + int(np.ceil(SECOND * r))
        segment = ((found >> _U(32)) % _U(m)).astype(np.int64)
        content = np.zeros(m, _U)
        with np.errstate(over="ignore"):
            np.add.at(content, segment, mix(found ^ _U(0x5851F42D4C957F2D)))
            size = np.bincount(segment, minlength=m)
            key = mix(content + mix(np.arange(m).astype(_U) + _U(band << 32)) + size.astype(_U))
        leave = m - r - 1
        gone = np.flatnonzero(size == 0)[::-1][:leave]
        out.append((leave - len(gone), np.delete(key, gone)))
    return out


def _by_batch(f, kinds: str):
    """A mapInArrow function from f(batch), which gives the columns."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch(f(batch), names)

    return run


def _lists(arrays: list[np.ndarray], empty=np.zeros(0, np.int64)) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([empty, *arrays]))


def _digest(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(found).sum(dtype=_U).view(np.int64)), int(mix(found ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U).view(np.int64))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, items): size and digest of each document's set, and its shingles in a fixed part of the hash space. Texts are read once."""
    small_batches(docs.sparkSession)
    part = _U(min(1 << 20, int(SAMPLE * (den - num) / den * (1 << 20)) + 1))

    def columns(batch: pa.RecordBatch) -> list:
        sets = list(shingle_sets(batch.column("text"), k))
        d = [_digest(s) for s in sets]
        sizes = pa.array(np.array([len(s) for s in sets], np.int64))
        some = [s[(s >> _U(24)) % _U(1 << 20) < part].view(np.int64) for s in sets]
        return [batch.column("doc_id"), sizes, *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1)), _lists(some)]

    kinds = "doc_id long, n_shingles long, d1 long, d2 long, items array<long>"
    return docs.select("doc_id", "text").mapInArrow(_by_batch(columns, kinds), kinds)


def digested(docs: DataFrame, k: int) -> DataFrame:
    """All columns of docs plus _d1, _d2, the digest of the row's set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [_digest(s) for s in shingle_sets(batch.column("text"), k)]
            yield pa.record_batch([*batch.columns, *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1))], [*batch.schema.names, "_d1", "_d2"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", _d1 long, _d2 long")


def classes_of(rows: DataFrame) -> DataFrame:
    """(node, doc, d1, d2, n): one row a class of equal sets, doc its smallest doc_id. Rows without words or doc_id have none."""
    known = rows.where("n_shingles > 0 and doc_id is not null")
    one = known.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc"))
    # numbered as it is written, and only ever read from there
    return materialize(one.select(F.monotonically_increasing_id().alias("node"), "doc", "d1", "d2", "n"), "classes")


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are counted to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def crowded(items: DataFrame, num: int, den: int) -> DataFrame:
    """(node): those of items (node, n, items) of whose n shingles no more are lone than a partner within the threshold may lack.

    One shuffle of (item, smallest node, largest node), summed before it; a common item is one row from each task.
    """
    each = items.select("node", F.explode("items").alias("item"))
    lone = each.groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    far = lone.join(items.select("node", "n"), "node").where(F.col("lone") * den > (den - num) * F.col("n"))
    return items.select("node").join(far.select("node"), "node", "left_anti").distinct()


def sets_of(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(node, items): the sets of the classes in named (node, doc, d1, d2)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(_few(named.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")

    def columns(batch: pa.RecordBatch) -> list:
        found = list(shingle_sets(batch.column("text"), k))
        d = [_digest(s) for s in found]
        return [batch.column("doc_id"), *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1)), _lists([s.view(np.int64) for s in found])]

    kinds = "doc long, d1 long, d2 long, items array<long>"
    found = texts.mapInArrow(_by_batch(columns, kinds), kinds).join(_few(named.select("node", "doc", "d1", "d2")), ["doc", "d1", "d2"])
    return found.groupBy("node").agg(F.first("items").alias("items"))  # a row may be there twice


def cells_of(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, cells, ends, leave) of sets (node, items): all cells, band after band, where each band's end, and how many of its fullest each may leave."""
    small_batches(sets.sparkSession)
    none = np.zeros(0, np.int32)

    def columns(batch: pa.RecordBatch) -> list:
        items, bands = batch.column("items"), Bands(num, den)
        flat, at = items.values.to_numpy().view(_U), items.offsets.to_numpy()
        cells, ends, leave = [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            keys = cell_keys(flat[a:b], bands)
            cells.append(np.concatenate([np.zeros(0, _U), *(k for _, k in keys)]).view(np.int64))
            ends.append(np.cumsum([len(k) for _, k in keys]).astype(np.int32))
            leave.append(np.array([left for left, _ in keys], np.int32))
        return [batch.column("node"), _lists(cells), _lists(ends, none), _lists(leave, none)]

    kinds = "node long, cells array<long>, ends array<int>, leave array<int>"
    return sets.mapInArrow(_by_batch(columns, kinds), kinds)


def first_cells(cells: DataFrame) -> DataFrame:
    """(key, x, hub): the cells of cells, as from cells_of(), in which two may meet; each document leaves its fullest."""
    each = cells.select(F.col("node").alias("x"), "ends", "leave", F.posexplode("cells").alias("at", "key"))
    band = F.when(F.col("at") < F.col("ends")[0], 0).otherwise(1)
    each = each.select("x", band.alias("band"), F.col("leave")[band].alias("leave"), "key")
    full = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = W.partitionBy("x", "band")
    fullest = F.row_number().over(own.orderBy(F.desc("n"), F.desc("key")))
    kept = each.join(full, "key").select("key", "x", "leave", fullest.alias("nth"), F.sum("n").over(own).alias("hub"))
    return kept.where("nth > leave").select("key", "x", "hub")


def regions_of(cells: DataFrame) -> DataFrame:
    """(region, p, x, root): cells (region, key, x, hub, root) with one pivot as one region around it, p, the member with the largest hub.

    Cells of one component, seen by the roots of their members, are left out."""
    hub = F.max(F.struct("hub", (-F.col("x")).alias("x"))).alias("top")
    pivots = cells.groupBy("region", "key").agg(hub, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    pivots = pivots.select("region", "key", (-F.col("top.x")).alias("p"))
    members = cells.join(pivots, ["region", "key"])
    return members.select(F.xxhash64("region", "p").alias("region"), "p", "x", "root").distinct()


def candidates(docs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, num: int, den: int, tag: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """(cells, sets): the first cells (region, key, x, hub, root) and the sets of the nodes in them."""
    named = reps.select("node", F.col("doc").alias("doc_id"), "d1", "d2")
    some = rows.join(_few(named), ["doc_id", "d1", "d2"]).select("node", F.col("n_shingles").alias("n"), "items")
    alive = materialize(crowded(some, num, den), tag)
    sets = materialize(sets_of(docs, reps.join(_few(alive), "node"), k), tag)
    for _ in range(2):
        whole = sets.select("node", F.size("items").alias("n"), "items")
        alive = materialize(crowded(whole, num, den), tag)  # counted and joined, so not to be worked out twice
        old, sets = sets, materialize(sets.join(_few(alive), "node", "left_semi"), tag)
        discard(old)
        discard(alive)
    kept = first_cells(materialize(cells_of(sets, num, den), tag))
    cells = kept.select(F.lit(0).cast("long").alias("region"), "key", "x", "hub", F.col("x").alias("root"))
    return materialize(cells, tag), sets


# Joining a region within one task.


class _Sets:
    """Sets of one region as tokens: what only one set holds is no token, but counts in its size."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[token] > 1
        self.tokens = len(times)
        self.token = token[keep].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), self.size)[keep], minlength=len(sets)))])
        self.num, self.den = num, den

    def _tokens(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.start[of + 1] - self.start[of]
        row = np.repeat(np.arange(len(of)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[of], n)
        return row, self.token[at]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items each of a has in common with each of b."""
        (ra, ta), (rb, tb) = self._tokens(a), self._tokens(b)
        in_a, in_b = np.zeros((2, self.tokens), bool)
        in_a[ta] = in_b[tb] = True
        if len(b) == 1:
            return np.bincount(ra, in_b[ta], len(a)).astype(np.int64)[:, None]
        both = in_a & in_b
        column = np.cumsum(both) - 1
        sides = []
        for r, t, n in ((ra, ta, len(a)), (rb, tb, len(b))):
            there = both[t]
            sides.append((r[there], column[t[there]], n))
        out = np.zeros((len(a), len(b)), np.int64)
        total = int(both.sum())
        for at in range(0, total, COLUMNS):
            dense, width = [], min(COLUMNS, total - at)
            for r, c, n in sides:
                now = (c >= at) & (c < at + width)
                m = np.zeros((n, width), np.float32)
                m[r[now], c[now] - at] = 1
                dense.append(m)
            out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members of a and b within the threshold."""
        common = self.shared(a, b)
        all_ = self.size[a][:, None] + self.size[b][None, :] - common
        i, j = np.nonzero(self.den * common >= self.num * all_)
        i, j = a[i], b[j]
        return i[i != j], j[i != j]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.shared(a, b)
        return 1 - common / (self.size[a][:, None] + self.size[b][None, :] - common)


def near_pairs(sets: _Sets, own: np.ndarray, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the threshold that hold a member of own and one of own or guests; some come twice.

    Pivots of own make Voronoi regions of own and guests; a member visits the regions of the later pivots that the triangle inequality leaves open to it.
    """
    everyone = np.concatenate([own, guests])
    reach = (sets.den - sets.num) / sets.den + 1e-9
    if len(own) > TILE:
        rows = np.arange(len(everyone))
        away = sets.distance(everyone, own[:1])
        pivots = [0]
        while len(pivots) < PIVOTS:
            far = int(away[: len(own)].min(1).argmax())
            if away[far].min() == 0:
                break
            pivots.append(far)
            away = np.hstack([away, sets.distance(everyone, own[far : far + 1])])
        home = away.argmin(1)
        to_own = away[rows, home]
        for p in range(len(pivots)):
            at_home = home == p
            mine = np.flatnonzero(at_home[: len(own)])
            guest = np.flatnonzero(at_home[len(own) :]) + len(own)
            radius = max(to_own[at_home], default=0.0)
            window = (home > p) & (away[:, p] <= to_own + 2 * reach) & (away[:, p] <= radius + reach)
            # pairs of an own and an own or guest, one of them at home here
            inner, outer = everyone[mine], everyone[np.concatenate([guest, np.flatnonzero(window)])]
            visitors = np.flatnonzero(window[: len(own)])
            if len(inner) + len(outer) <= SHRINKS * len(everyone):
                yield from near_pairs(sets, inner, outer)
            else:
                yield from _tiles(sets, inner, np.concatenate([inner, outer]))
            if len(guest) and len(visitors):
                yield from _tiles(sets, everyone[guest], everyone[visitors])
    else:
        yield from _tiles(sets, own, everyone)


def _tiles(sets: _Sets, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            yield sets.near(a[i : i + TILE], b[j : j + TILE])


def _top(up: list[int], a: int) -> int:
    while up[a] != a:
        up[a] = up[up[a]]
        a = up[a]
    return a


def _leaf_links(sets: list[np.ndarray], x: list[int], root: list[int], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of the members; fewer than there are members. Members of one root are joined already."""
    first: dict[int, int] = {}
    up = [first.setdefault(r, i) for i, r in enumerate(root)]
    found = _Sets(sets, num, den)
    for a, b in near_pairs(found, np.arange(len(sets)), np.zeros(0, np.int64)):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            s, t = _top(up, i), _top(up, j)
            if s != t:
                up[max(s, t)] = min(s, t)
                yield x[i], x[j]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Columns of the rows of one key, of batches sorted by it; arrays of items as NumPy."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "items"}
        items = batch.column("items")
        flat, ends = items.values.to_numpy(), items.offsets.to_numpy()
        columns["items"] = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in range(batch.num_rows):
            if held and held[key][0] != columns[key][i]:
                yield held
                held = {}
            for c, v in columns.items():
                held.setdefault(c, []).append(v[i])
    if held:
        yield held


def _by_region(rows: DataFrame, key: str = "region") -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key)


def leaf_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) from members (region, x, root) of small regions: links whose components are those of all links within the regions."""
    small_batches(sets.sparkSession)
    rows = _by_region(members.select("region", "x", "root").join(sets.withColumnRenamed("node", "x"), "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "region"):
            pairs = list(_leaf_links(g["items"], g["x"], g["root"], num, den))
            if pairs:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


# Larger regions: distances to the pivot, and cells of the differences.


def measured(regions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """regions (.., p, x) plus near, size (of x) and e, the items that x or p has alone."""
    left = regions.join(sets.select(F.col("node").alias("x"), F.col("items").alias("xs")), "x")
    both = left.join(sets.select(F.col("node").alias("p"), F.col("items").alias("ps")), "p")
    e = F.concat(F.array_except("xs", "ps"), F.array_except("ps", "xs"))
    both = both.select(*regions.columns, F.size("xs").alias("size"), F.size("ps").alias("p_size"), e.alias("e"))
    # twice the shared items are both sizes less the difference, twice the union is both sizes and the difference
    near = F.lit(den) * (F.col("size") + F.col("p_size") - F.size("e")) >= F.lit(num) * (F.col("size") + F.col("p_size") + F.size("e"))
    return both.withColumn("near", near).drop("p_size")


def _dealt_again(told: DataFrame, num: int, den: int) -> DataFrame:
    """(region, key, x, hub, root): told (region, x, root, near, size, e) as cells by the rarest items of the differences.

    need: how many items of its difference x shares at least with any partner that is not, like x, near the pivot. Items
    that no far member has, or one member alone, count, but make no cell. Where nothing need be shared, a common cell takes x in.
    """
    far = told.where("not near").groupBy("region").agg(F.min(F.size("e")).alias("far"))
    r = f"floor({den - num} * size / {num})"
    need = f"cast(ceil(if(near, far + size(e) - {r}, size(e) + greatest(0, size(e) - {r}) - {r}) / 2) as int)"
    rows = told.join(far, "region").select("region", "x", "root", "near", F.expr(need).alias("need"), "e")
    any_ = rows.where("need <= 0").select("region", F.xxhash64("region").alias("key"), "x", "root", F.lit(0).cast("long").alias("hub"))
    items = materialize(rows.select("region", "x", "root", "near", "need", F.explode("e").alias("item")), "items")
    full = items.groupBy("region", "item").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("far")).where("n > 1 and far > 0")
    items = items.join(full, ["region", "item"])
    own = W.partitionBy("region", "x")
    rarest = F.row_number().over(own.orderBy("n", "item"))
    items = items.select("region", "x", "root", "need", "item", "n", rarest.alias("nth"), F.count(F.lit(1)).over(own).alias("met"))
    kept = items.where("need <= 0 or nth <= met - need + 1")
    hub = F.sum("n").over(own)
    return kept.select("region", F.xxhash64("region", "item").alias("key"), "x", "root", hub.alias("hub")).unionByName(any_)


def links(docs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links between nodes whose components are those of all links."""
    tag = "jaccard"
    cells, sets = candidates(docs, rows, reps, k, num, den, tag)
    sizes = sets.select(F.col("node").alias("x"), F.size("items").alias("size"))
    found = []
    while not cells.isEmpty():
        members = materialize(regions_of(cells), tag)
        discard(cells)
        sums = members.join(sizes, "x").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"))
        sums = materialize(sums, tag)
        small = (F.col("n") <= LEAF) & (F.col("held") <= LEAF_ITEMS)
        found.append(materialize(leaf_links(members.join(sums.where(small), "region", "left_semi"), sets, num, den), tag))
        large = members.join(sums.where(~small), "region", "left_semi").where("x <> p")
        told = materialize(measured(large, sets, num, den), tag)
        near = materialize(told.where("near").select(F.col("p").alias("a"), F.col("x").alias("b")).distinct(), tag)
        found.append(near)
        p_root = members.where("x = p").groupBy("region").agg(F.min("root").alias("p_root"))
        merged = told.where("near").join(p_root, "region").groupBy("x").agg(F.min("p_root").alias("into"))
        told = told.join(merged, "x", "left").withColumn("root", F.least("root", "into")).drop("into", "p")
        cells = materialize(_dealt_again(told, num, den), tag)
    if not found:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# All links and their numbers.


def link_counts(docs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, partner_rows): over all links of a node, the rows of the classes it is linked with.

    Regions over LEAF members go to tasks in blocks, each block meeting each other once. A pair that meets in several
    regions counts in the smallest of them. Only sums leave a task, a row a member.
    """
    cells, sets = candidates(docs, rows, reps, k, num, den)
    members = regions_of(cells).select("region", "x")
    met = materialize(members.groupBy("x").agg(F.array_sort(F.collect_set("region")).alias("met")), "met")
    sized = met.join(sets.select(F.col("node").alias("x"), F.size("items").alias("size")), "x").select("x", "size", F.explode("met").alias("region"))
    blocks = sized.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) * 2 / LEAF), F.ceil(F.sum("size") * 2 / LEAF_ITEMS), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    dealt = sized.join(blocks, "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(task.alias("task"), "region", "x", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"), "own")
    weight = reps.select(F.col("node").alias("x"), "rows")
    full = _by_region(dealt.join(met, "x").join(weight, "x").join(sets.withColumnRenamed("node", "x"), "x"), "task")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "task"):
            own, region = np.array(g["own"]), g["region"][0]
            held = _Sets(g["items"], num, den)
            one, two = np.flatnonzero(own == g["lower"][0]), np.flatnonzero(own == g["upper"][0])
            sums = [0] * len(own)
            for a, b in _tiles(held, one, two):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if next(r for r in g["met"][i] if r in g["met"][j]) == region:
                        sums[i] += g["rows"][j]
                        if g["lower"][0] != g["upper"][0]:
                            sums[j] += g["rows"][i]
            yield pa.record_batch([pa.array(g["x"], pa.int64()), pa.array(sums, pa.int64())], ["node", "partner_rows"])

    return full.mapInArrow(run, "node long, partner_rows long").groupBy("node").agg(F.sum("partner_rows").alias("partner_rows"))


def join_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) for every row of docs: the smallest doc_id with the same set, and the
    number of other rows within the threshold, copies included. Rows without words or doc_id have no links."""
    rows = materialize(signatures(docs, k, num, den), "digests")
    reps = classes_of(rows)
    sizes = rows.where("doc_id is not null").groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    reps = materialize(reps.join(sizes, ["d1", "d2", "n"]), "classes")
    counts = materialize(link_counts(docs, rows, reps, k, num, den), "links")
    named = reps.join(counts, "node", "left").select("d1", "d2", "n", "doc", (F.col("rows") - 1 + F.coalesce("partner_rows", F.lit(0))).alias("links"))
    known = rows.doc_id.isNotNull() & (rows.n_shingles > 0)
    out = rows.join(named, known & (rows.d1 == named.d1) & (rows.d2 == named.d2) & (rows.n_shingles == named.n), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("doc", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


# One row a document.


def _shared_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n) of documents of several texts, each text once."""
    each = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2", F.col("n_shingles").alias("n"))
    several = each.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d")).where("a <> b or c <> d")
    return each.join(several.select("doc_id"), "doc_id", "left_semi").distinct()


def linked_classes(rows: DataFrame, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """(d1, d2, n, node, to_doc, to_node): each class with the first class (by doc_id) of its component."""
    roots = components(edges)
    linked = materialize(reps.join(roots, "node").select("node", "doc", "root"), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("to")).select("root", F.col("to.doc").alias("to_doc"), F.col("to.node").alias("to_node"))
    named = reps.join(linked.join(first, "root").select("node", "to_doc", "to_node"), "node", "left")
    return named.select("d1", "d2", "n", "node", F.coalesce("to_doc", "doc").alias("to_doc"), F.coalesce("to_node", "node").alias("to_node"))


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = materialize(signatures(docs, k, num, den), "digests")
    reps = classes_of(rows)
    edges = links(docs, rows, reps, k, num, den)
    texts = materialize(_shared_ids(rows).join(reps, ["d1", "d2", "n"]).select("doc_id", "node"), "shared")
    if not texts.isEmpty():  # a document links all its texts
        edges = edges.union(texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    named = linked_classes(rows, reps, edges)
    out = rows.join(named, (rows.d1 == named.d1) & (rows.d2 == named.d2) & (rows.n_shingles == named.n), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("to_doc")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component of texts: that of its smallest doc_id (of equal rows, one). Rows without words or doc_id stay.

    A doc_id with several texts keeps each that nothing else stands for."""
    rows = materialize(signatures(docs, k, num, den), "digests")
    reps = classes_of(rows)
    named = linked_classes(rows, reps, links(docs, rows, reps, k, num, den))
    known = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2", F.col("n_shingles").alias("n"))
    told = known.join(named, ["d1", "d2", "n"]).select("doc_id", "d1", "d2", "node", "to_doc", "to_node")
    told = materialize(told.withColumn("stays", (F.col("doc_id") == F.col("to_doc")) & (F.col("node") == F.col("to_node"))), "told")
    twice = materialize(told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    gone = materialize(told.where("not stays").select("doc_id").union(twice).distinct(), "gone")
    kept = docs.join(_few(gone), "doc_id", "left_anti")
    if twice.isEmpty():
        return kept
    several = digested(docs.join(_few(twice), "doc_id", "left_semi"), k)
    wordless = several.where("_d1 = 0 and _d2 = 0").drop("_d1", "_d2")
    which = told.where("stays").select("doc_id", F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct()
    one = W.partitionBy("doc_id", "_d1", "_d2").orderBy(F.xxhash64(*docs.columns))
    first = several.join(which, ["doc_id", "_d1", "_d2"], "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*docs.columns)
    return kept.unionByName(first).unionByName(wordless)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.9 or more."""
    return join_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
