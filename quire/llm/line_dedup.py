"""Line deduplication over all documents, without moving texts to find the repeats.

Each document's distinct long lines become 128-bit hashes. A first sum by hash and a bucket of the document spreads a
line that a third of all documents hold; its partial rows are then range-partitioned by hash, sorted by hash,
document and position, and streamed: the first row of a hash carries the place that keeps the line. Only lines found
in enough documents go on. Decisions come back as one run-length bitmap per document (kept, dropped, kept, ... run
lengths over its lines), and a text is cut by its bitmap: where it lies, the bitmaps being broadcast, as long as their
counted bytes are few; beyond that, texts and bitmaps meet by a shuffle.

Edge cases: a null or empty text is one empty line; lines shorter than MIN_CHARS code points (after stripping) never
go; a line within one document alone never goes, however often it repeats there; a null doc_id counts as no document
and its lines are kept; rows that share a doc_id count as one document, and each is cut by its own lines (they are told
apart by a hash of the text); an empty table gives no rows. Extra columns, one named `runs` too, pass through dedup_lines().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import ASCII_SPACE, lower_ascii, materialize, table, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
#: Hash rows are summed in so many buckets of documents before those of one hash meet.
SALT = 64
#: Repeated lines up to this many (24 bytes each) are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 500_000
#: Bitmaps of up to so many bytes in all (8 a run and 24 a row) are broadcast.
BROADCAST_BYTES = 16 << 20


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(ASCII_SPACE)))


def text_mark(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64(text)


def long_line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of every line whose stripped form has min_chars code points or more; mark is that of the row's text."""
    whole = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text(text).alias("text"))
    lines = whole.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.length("line") >= min_chars).select("doc_id", "mark", "pos", F.trim("line", F.lit(ASCII_SPACE)).alias("line"))
    key = lower_ascii(F.col("line"))
    lines = lines.where(F.length("line") >= min_chars)
    return lines.select("doc_id", "mark", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), F.reverse(key)).alias("h2"))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, keep_doc): the lines found in min_docs documents or more, with the largest doc_id that holds each."""
    salted = hashes.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("salt"), "doc_id").agg(F.min("pos").alias("pos"))
    part = salted.groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "pos")).alias("last"))
    spark = hashes.sparkSession
    ranged = part.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1", "h2")
    ranged = ranged.select("h1", "h2", "n", F.col("last.doc_id").alias("doc_id"), F.col("last.pos").alias("pos"))
    first = W.partitionBy("h1", "h2").orderBy(F.desc("doc_id"), "pos")
    streamed = ranged.select("h1", "h2", "doc_id", F.row_number().over(first).alias("nth"), F.sum("n").over(W.partitionBy("h1", "h2")).alias("docs"))
    return streamed.where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", F.col("doc_id").alias("keep_doc"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, pos) of the lines to drop, of each row by its own text."""
    hashes = materialize(long_line_hashes(docs, min_chars), "lines")
    repeats = materialize(repeated_lines(hashes, min_docs), "repeats")
    small = repeats.count() <= BROADCAST_ROWS
    found = hashes.join(F.broadcast(repeats) if small else repeats, ["h1", "h2"])
    return found.where(F.col("doc_id") != F.col("keep_doc")).select("doc_id", "mark", "pos")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, mark, runs): run lengths, kept lines first, up to the last dropped line; what follows is kept.

    One row a document with drops; a document's positions are at most its lines, so a row is no larger than the text it is about.
    """
    at = dropped.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    edge = "filter(transform(at, (p, i) -> struct(p, i > 0 and at[i - 1] = p - 1 as open, i < size(at) - 1 and at[i + 1] = p + 1 as goes)), x -> not (x.open and x.goes))"
    ends = f"flatten(transform({edge}, x -> if(x.open, array(x.p + 1), if(x.goes, array(x.p), array(x.p, x.p + 1)))))"
    cuts = at.select("doc_id", "mark", F.expr(ends).alias("cuts"))
    return cuts.select("doc_id", "mark", F.expr("transform(cuts, (c, i) -> if(i = 0, c, c - cuts[i - 1]))").alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The kept lines of a text, joined by newlines. Linear in the text."""
    lines = F.split(text, "\n", -1)
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat((i % 2) == 0, n)))
    both = F.arrays_zip(lines.alias("line"), flags.alias("keep"))
    kept = F.filter(both, lambda x: F.coalesce(x["keep"], F.lit(True)))
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def with_bitmaps(docs: DataFrame, into: str = "runs", **how) -> DataFrame:
    """docs with one more column, the bitmap of each row (null: every line stays)."""
    found = materialize(bitmaps(dropped_lines(docs, **how)), "bitmaps")
    held = found.agg((F.count(F.lit(1)) * 24 + F.coalesce(F.sum(F.size("runs")), F.lit(0)) * 8).alias("bytes")).first().bytes
    found = found.select(F.col("doc_id").alias("_doc"), "mark", F.col("runs").alias(into))
    found = F.broadcast(found) if held <= BROADCAST_BYTES else found
    on = (docs["doc_id"] == F.col("_doc")) & (text_mark(whole_text(docs["text"])) == F.col("mark"))
    return docs.join(found, on, "left").select(*(docs[c] for c in docs.columns), into)


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the repeated lines cut from text; all other columns as they were."""
    into = next(n for n in map("_runs{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    cut = with_bitmaps(docs, into, **how).withColumn("text", kept_text(F.col("text"), F.col(into)))
    return cut.select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns: keep_runs, the bitmap as comma-joined run lengths (kept first)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    cut = with_bitmaps(docs)
    n_dropped = F.coalesce(F.expr("aggregate(filter(runs, (n, i) -> i % 2 = 1), 0L, (a, n) -> a + n)"), F.lit(0))
    return cut.select(
        "doc_id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("runs")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.array_join(F.transform("runs", lambda n: n.cast("string")), ","), F.lit("")).alias("keep_runs"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), r AS (
  SELECT k, max(doc_id) AS keep_doc FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.k IS NOT NULL AND k.doc_id <> r.keep_doc AS gone FROM k LEFT JOIN r ON k.k = r.k
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
), e AS (
  SELECT doc_id, pos, gone, gone <> coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS cut FROM m
), f AS (
  SELECT doc_id, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS run, pos FROM (
    SELECT doc_id, pos FROM e WHERE cut
    UNION ALL SELECT doc_id, max(pos) + 1 FROM e GROUP BY doc_id HAVING arg_max(gone, pos))
), s AS (
  SELECT doc_id, string_agg(CAST(run AS VARCHAR), ',' ORDER BY pos) AS keep_runs FROM f GROUP BY doc_id
)
SELECT g.*, coalesce(s.keep_runs, '') AS keep_runs FROM g LEFT JOIN s USING (doc_id)
"""
