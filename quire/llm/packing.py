"""Best-fit packing of documents into sequences of at most SEQUENCE tokens, by length patterns.

The histogram of lengths (one number a length, whatever the number of documents) goes to the driver. Patterns of up to
three lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often to repeat each so
that the histogram is used up, the repeats are rounded down, and what is left is packed best-fit, longest first, again
on counts alone. The plan has a row for each run of equal places; its size grows with the kinds of sequences, not with the
documents (measured: 0.63 million rows, 15 MB, for 2 million pieces of all lengths, and no more beyond). Pieces get their
place in it by their rank among the pieces of equal length. Ranks come from counts per bucket and length and a row number
within both, so no task holds all the pieces of one length; there are more buckets where there are more pieces. A
full piece is a sequence of its own and needs no rank.

Texts are tokenised once; the pieces (no ids, only their checksum) are written to the shared folder. Edge cases: a null
or empty text is the end token alone; a text over SEQUENCE tokens is cut, its first piece being the shorter one;
repeated rows are packed each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize, small_batches, table

SEQUENCE = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Buckets of documents that ranks are counted in: one for so many pieces, within these bounds.
PER_BUCKET = 1 << 20
BUCKETS = 64
MOST_BUCKETS = 1024
ITERATIONS = 300


@lru_cache(2)
def tokenizer(path: str):
    """texts -> lists of ids, for a byte-level BPE file of the tokenizers library.

    The file's vocabulary also runs under tiktoken, four times as fast and with the same ids (ranks are ids, and the
    splitting expression is the same) for texts that hold none of the file's added tokens. Those that do, and any that
    the library fails on, go to the file's own tokenizer.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    try:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(own.to_str())
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return slow
        letters = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]: i for i in range(128)}
        for i in range(128, 2048):
            for byte, letter in zip(chr(i).encode(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0], strict=True):
                letters[letter] = byte
        rest = sorted({c for t in spec["model"]["vocab"] for c in t} - set(letters) - {c for t in spec["added_tokens"] for c in t["content"]})
        letters |= dict(zip(rest, sorted(set(range(256)) - set(letters.values())), strict=False))
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        trial = "It's a trial, n'est-ce pas?  \n\n\tÄpfel 日本 1234   🙂 <|x|> x"
        if fast.encode_ordinary(trial) != slow(trial):
            return slow
    except (ImportError, KeyError, ValueError):
        return slow

    added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")

    def quick(text: str) -> list[int]:
        if added.search(text):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError):
            raise
        except BaseException:  # the library's panics, on texts too long for its expressions, derive from BaseException alone
            return slow(text)

    return quick


def cuts(length: int, most: int = SEQUENCE) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or as many full ones as there are behind a first, shorter one."""
    first = (length - 1) % most + 1
    yield 0, first
    for start in range(first, length, most):
        yield start, most


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, bucket int"


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row a piece, with the checksum of its ids. bucket, a hash, deals documents out for later counting."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        names = [f.split()[0] for f in _PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc, ids = doc.as_py(), np.array([*encode(text.as_py() or ""), end], "<u4")
                bucket = zlib.crc32(b"%d" % (doc or 0) + ids[:64].tobytes()) & 0x7FFFFFFF
                for k, (start, n) in enumerate(cuts(len(ids), most)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), bucket))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def patterns(lengths: np.ndarray, most: int = SEQUENCE) -> np.ndarray:
    """Triples a >= b >= c of present lengths (0: none) that add up to exactly `most`."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, most + 1), np.arange(0, most + 1), indexing="ij"))
    c = most - a - b
    good = (a >= b) & (b >= c) & (c >= 0) & there[a] & ((b == 0) | there[np.minimum(b, most)])
    a, b, c = a[good], b[good], c[good]
    good = (c == 0) | there[c]
    return np.stack([a[good], b[good], c[good]], 1)


def fit_repeats(histogram: np.ndarray, triples: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeats x that bring the lengths used by the patterns near the histogram in the least-squares sense.

    Accelerated projected gradient on |A x - h|^2; A holds how often a pattern has a length and is applied by index. Lengths
    are weighed by themselves: what is left of a long one costs a sequence.
    """
    most = len(histogram) - 1
    used = triples.T
    real = [(u > 0).astype(float) for u in used]
    weight = np.arange(most + 1) / most + 0.05

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(u, x * r, most + 1) for u, r in zip(used, real, strict=True))

    def back(y: np.ndarray) -> np.ndarray:
        return sum(y[u] * r for u, r in zip(used, real, strict=True))

    degree = np.maximum(forward(np.ones(len(triples))), 1)
    h = histogram.astype(float)
    step = 1 / (9 * (weight[used] * np.sqrt(degree)[used] * real).max(0) ** 2 / 3 + 1e-9)
    x = np.zeros(len(triples))
    y, t = x, 1.0
    for _ in range(iterations):
        new = np.maximum(0, y - step * back(weight**2 * (forward(y) - h)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): lengths that share a sequence, and how many sequences look so. Uses the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    triples = patterns(np.flatnonzero(left), most)
    if len(triples):
        x = fit_repeats(left, triples)
        order = np.argsort(-x, kind="stable")
        for i in order[x[order] >= 0.5]:
            shape = [int(v) for v in triples[i] if v]
            need = {v: shape.count(v) for v in shape}
            n = min([int(np.ceil(x[i] - 0.5)), *(int(left[v]) // k for v, k in need.items())])
            if n > 0:
                out.append((tuple(shape), n))
                for v, k in need.items():
                    left[v] -= n * k
    return out + _best_fit(left, most)


def _best_fit(left: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that has room; runs of equal sequences move as one."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                shape, have = next(iter(room[r].items()))
                take = min(n, have)
                if take == have:
                    del room[r][shape]
                    if not room[r]:
                        del room[r]
                else:
                    room[r][shape] = have - take
                shape, rest = (*shape, length), r - length
            else:
                # as many of this length as one sequence holds, whole sequences first
                each = min(n, most // length)
                take, shape, rest = n // each, (length,) * each, most - length * each
                n -= take * (each - 1)
            at = room.setdefault(rest, {})
            at[shape] = at.get(shape, 0) + take
            n -= take
    return [(shape, n) for at in room.values() for shape, n in at.items()]


def places(the_plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): the ranks from there on take one place in each sequence on."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for shape, n in the_plan:
        offset = 0
        for length in shape:
            out.setdefault(length, []).append((rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """cut (rows with length, bucket and an order given by doc_id, piece, ids_crc32) plus sequence_id and offset."""
    spark = cut.sparkSession
    full = cut.where(F.col("length") == most).drop("bucket")
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    cut = cut.where(F.col("length") < most)
    buckets = min(MOST_BUCKETS, max(BUCKETS, cut.count() // PER_BUCKET))
    cut = cut.withColumn("bucket", F.col("bucket") % buckets)
    counts = materialize(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(most + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `most` rows
        histogram[length] = n
    where = spark.sparkContext.broadcast(places(plan(histogram, most)))  # bounded by the kinds of sequences
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(first), ["length", "bucket"])  # at most `most` times MOST_BUCKETS rows
    ranked = ranked.withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = where.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    start = rows[int(length[at[0]])]
                    k = np.searchsorted(start[:, 0], rank[at], "right") - 1
                    sequence[at] = start[k, 1] + rank[at] - start[k, 0]
                    offset[at] = start[k, 2]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long").unionByName(full)


def vocabulary_path(name: str = VOCABULARY) -> str:
    from public_tokenizers import path

    return str(path(name))


def pack_documents(docs: DataFrame, path: str | None = None, most: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = materialize(pieces(docs, path or vocabulary_path(), most), "pieces")
    return pack(cut, most)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
