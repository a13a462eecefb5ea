"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A bounded sample of labelled documents (TRAIN_ROWS, by hash of the id, held-out fold never among them) is found by a
broadcast join of its ids; each distinct text counts once. Executors count in how many toxic and other texts each
hashed n-gram occurs; the counts give the log-count ratio r of every bucket. Every bucket whose shares in the two classes
differ significantly stays, however many there are: a z-score of MIN_Z, at which chance alone would bring in about one
of the 2^20 buckets. The sample's texts, as sets of those buckets, come to the driver (bounded by TRAIN_ROWS and the
number of buckets), and a logistic regression is fitted on presence times r. Scoring reads each text once, with one table of weights.

Edge cases: a null or empty text gets the score of a text without features; labels that are null, or of a null
doc_id, are not learned; a doc_id labelled twice, or a text of several, counts as toxic if one label says so; without labels of both kinds
every score is the share of toxic labels (0 without any); long texts are worked on in parts; repeated rows get the
same score; an empty table gives no rows. Extra columns pass through score(), which takes the name of its own column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table, whole_text

ORDERS = (3, 4, 5, 6)
BITS = 20
TRAIN_ROWS = 20_000
MIN_Z = 5.0
SMOOTHING = 1.0
THRESHOLD = 0.3
#: Characters worked on at once, so many that their n-grams stay in the processor's cache; results do not depend on it.
PART = 1 << 15
#: Bytes in a batch that a Python worker gets.
BATCH = 2 << 20
_U = np.uint64


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def _codes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, number of the text) in parts; a text longer than a part goes on, with an overlap, in the next."""
    chars, numbers, n = [], [], 0

    def flush():
        code = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), "<u4")
        return code, np.repeat(np.array(numbers, np.int32), [len(c) for c in chars])

    for k, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), PART):
            piece = text[at : at + PART + max(ORDERS) - 1]
            chars.append(piece)
            numbers.append(k)
            n += len(piece)
            if n >= PART:
                yield flush()
                chars, numbers, n = [], [], 0
    if chars:
        yield flush()


def _buckets(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each character)."""
    space = (code == 32) | ((code >= 9) & (code <= 13))
    with np.errstate(over="ignore"):
        one = (np.where(space, np.uint32(32), code).astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        one ^= one >> _U(29)
        h = one
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * _U(0xD6E8FEB86659FD93) + one[n - 1 :]
            if n in ORDERS:
                yield n, ((h ^ (h >> _U(31))) * _U(0xA0761D6478BD642F) >> _U(64 - BITS)).astype(np.int32)


def presence(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), each pair once, sorted by text; only buckets that are set in `wanted`, if given."""
    pairs, held = [np.zeros(0, np.int64)], 0
    for code, number in _codes(texts):
        for n, bucket in _buckets(code):
            same = number[: len(bucket)] == number[n - 1 :]
            if wanted is not None:
                same &= wanted[bucket]
            at = np.flatnonzero(same)
            pairs.append(np.unique((number[at].astype(np.int64) << BITS) | bucket[at]))
            held += len(pairs[-1])
        if held > 1 << 22:  # parts of a long text mostly repeat each other
            pairs = [np.unique(np.concatenate(pairs))]
            held = len(pairs[0])
    pairs = np.unique(np.concatenate(pairs))
    return (pairs >> BITS).astype(np.int64), (pairs & ((1 << BITS) - 1)).astype(np.int64)


def _groups(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of about PART characters each."""
    at = n = 0
    for k, text in enumerate(texts):
        n += len(text)
        if n >= PART or k == len(texts) - 1:
            yield slice(at, k + 1)
            at, n = k + 1, 0


@dataclass
class Model:
    """bias, and a weight for each chosen bucket; r is already multiplied in."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.buckets] = self.weights
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.buckets] = True
        z = np.full(len(texts), self.bias)
        for part in _groups(texts):
            number, bucket = presence(texts[part], wanted)
            z[part] += np.bincount(number, dense[bucket], part.stop - part.start)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def training_sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most `rows` labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != 2)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_z: float = MIN_Z) -> Model:
    small_batches(docs.sparkSession, size=BATCH)
    chosen = training_sample(labels, rows)
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            toxic, texts = batch.column("toxic").to_numpy(), _texts(batch)
            n += np.bincount(toxic, minlength=2)
            for part in _groups(texts):
                number, bucket = presence(texts[part])
                for k in (0, 1):
                    found, times = np.unique(bucket[toxic[part][number] == k], return_counts=True)
                    seen[k, found] += times.astype(np.int32)
        at = np.flatnonzero(seen.any(0))
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(seen[0][part].astype(np.int64)), pa.array(seen[1][part].astype(np.int64))], ["bucket", "other", "toxic"])
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array(n[:1]), pa.array(n[1:])], ["bucket", "other", "toxic"])

    counts = sample.mapInArrow(count, "bucket int, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "counts")
    totals = counts.where("bucket = -1").first()
    if totals is None or not totals.other or not totals.toxic:
        share = totals.toxic / max(1, totals.toxic + totals.other) if totals else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    n0, n1 = totals.other, totals.toxic
    p, q = F.col("toxic") / n1, F.col("other") / n0
    pooled = (F.col("toxic") + F.col("other") + 1) / (n0 + n1 + 2)
    z = F.abs(p - q) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(1 - 1e-9))) * (1 / n0 + 1 / n1))
    best = counts.where("bucket >= 0").where(z >= min_z).toPandas().sort_values("bucket")  # at most 2^20 rows
    r = np.log((best.toxic + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((best.other + SMOOTHING) / (n0 + 2 * SMOOTHING))
    buckets, r = best.bucket.to_numpy(np.int64), r.to_numpy(float)
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _texts(batch), []
            for part in _groups(texts):
                number, bucket = presence(texts[part], wanted)
                place = np.searchsorted(buckets, bucket).astype(np.int32)
                found += np.split(place, np.searchsorted(number, np.arange(1, part.stop - part.start)))
            yield pa.record_batch([batch.column("toxic"), pa.array([f.tobytes() for f in found], pa.binary())], ["toxic", "found"])

    rows_ = sample.mapInArrow(sets, "toxic int, found binary").toPandas().sort_values(["found", "toxic"])
    found = [np.frombuffer(f, np.int32) for f in rows_.found]
    bias, w = logistic(found, rows_.toxic.to_numpy(float), r)
    return Model(bias, buckets, w * r)


#: Pairs of text and feature worked on at once while fitting.
CHUNK = 1 << 21


def logistic(found: list[np.ndarray], y: np.ndarray, r: np.ndarray, penalty: float = 1e-6, steps: int = 600) -> tuple[float, np.ndarray]:
    """Bias and weights of a ridge-penalised logistic regression on sets of features, each worth r (accelerated gradient)."""
    ends = np.cumsum([0, *map(len, found)])
    cut = [0]
    while cut[-1] < len(found):  # texts of about CHUNK pairs, one at least
        cut.append(max(cut[-1] + 1, int(np.searchsorted(ends, ends[cut[-1]] + CHUNK, "right")) - 1))
    parts = [(a, b, np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1])), np.concatenate(found[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    scale = np.abs(r).max() or 1.0
    r = r / scale

    def forward(w: np.ndarray) -> np.ndarray:
        w = w * r
        return np.concatenate([np.bincount(row, w[col], b - a) for a, b, row, col in parts])

    def back(u: np.ndarray) -> np.ndarray:
        return sum(np.bincount(col, u[a:b][row], len(r)) for a, b, row, col in parts) * r

    # a bound on the curvature by power iteration
    v = np.ones(len(r))
    norm = 1.0
    for _ in range(20):
        u = back(forward(v))
        norm = np.linalg.norm(u) or 1.0
        v = u / norm
    step = 1 / (0.3 * norm / len(y) + 0.3 + penalty)
    w = prev = np.zeros(len(r) + 1)
    for k in range(steps):
        look = w + k / (k + 3) * (w - prev)
        miss = 1 / (1 + np.exp(-np.clip(look[-1] + forward(look[:-1]), -500, 500))) - y
        grad = np.append(back(miss) / len(y) + penalty * look[:-1], miss.mean())
        prev, w = w, look - step * grad
    return float(w[-1]), w[:-1] / scale


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus score; one pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark, size=BATCH)
    shared = spark.sparkContext.broadcast(model)  # at most 2^20 weights
    keep = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(m.scores(texts))], [*keep, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    base = docs.select(*keep)
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("score", DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
