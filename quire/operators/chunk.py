"""Sentences packed into bounded chunks, with overlap, page attribution and the weakest provenance.

A chunk that starts at sentence i ends at a place that depends on i alone, and so does the start of the next chunk: the
chunks are the orbit of 0 under next(i). Ends come from one RANGE window over running lengths; the orbit is a fold over
the sentences of a group (a page, or a document where chunks may cross pages). Groups are formed by one shuffle on the
document; ids, windows and folds all use that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize, sentences
from ..model import ChunkConfig


def sentence_rows(blocks: DataFrame) -> DataFrame:
    """One row a sentence: doc, source, page_seq, page, block_pos, block, origin, confidence, pos, s, n (code points)."""
    kept = blocks.select("doc", "source", "page_seq", "page", "block_pos", "block", "origin", "confidence", F.posexplode(sentences(normalize("text"))).alias("pos", "s"))
    return kept.withColumn("n", F.length("s"))


_INTS = "cast(array() as array<int>)"


def _orbit(cfg: ChunkConfig) -> str:
    """SQL for the array of chunk starts of a group `a`. Starts gather in blocks of 256, so that long groups stay linear."""
    len_ = "(if(x.e < size(a), a[x.e].c, total) - x.c - 1)"
    page_ends = f"({len_} >= {cfg.target} and a[x.e].turns)" if cfg.cross_page else "false"
    k = f"least({cfg.overlap_sentences}, x.e - x.i)"
    regular = f"if(x.e < size(a) and {k} > 0 and x.e - x.i > {k} and a[x.e].n <= {cfg.max_chars} and not {page_ends}, x.e - {k}, x.e)"
    step = f"if(x.n > {cfg.max_chars}, x.i + 1, {regular})"
    full = "size(z.last) >= 256"
    return f"""aggregate(a, named_struct('at', 0, 'full', cast(array() as array<array<int>>), 'last', {_INTS}),
        (z, x) -> if(x.i <> z.at, z, named_struct('at', {step},
            'full', if({full}, array_append(z.full, z.last), z.full),
            'last', array_append(if({full}, {_INTS}, z.last), x.i))),
        z -> flatten(array_append(z.full, z.last)))"""


def _emitted(cfg: ChunkConfig) -> str:
    """SQL for the array of chunks, from the starts."""
    size = max(cfg.max_chars, 1)
    one = "named_struct('piece', {piece}, 'hard_split', {hard}, 'text', {text}, 'page_start', {lo}, 'page_end', {hi}, 'blocks', {refs}, 'rank', {rank}, 'confidence', {conf}, 'step', x.i)"
    hard = one.format(piece="p", hard="true", text=f"substring(x.s, p * {size} + 1, {size})", lo="x.page", hi="x.page", refs="array(named_struct('page', x.page, 'block', x.block))", rank="x.rank", conf="if(x.rank = 2, x.confidence, null)")
    refs = "transform(array(transform(g, y -> named_struct('page', y.page, 'block', y.block))), r -> filter(r, (v, k) -> k = 0 or r[k - 1] <> v))[0]"
    soft = one.format(
        piece="0", hard="false", text="array_join(transform(g, y -> y.s), ' ')", lo="array_min(transform(g, y -> y.page))", hi="array_max(transform(g, y -> y.page))",
        refs=refs, rank="array_max(transform(g, y -> y.rank))", conf="array_min(transform(g, y -> if(y.rank = 2, y.confidence, null)))",
    )
    return f"""flatten(transform(transform(starts, i -> a[i]), x -> if(x.n > {cfg.max_chars},
        transform(sequence(0, cast(ceil(x.n / {size}) as int) - 1), p -> {hard}),
        transform(array(slice(a, x.i + 1, x.e - x.i)), g -> {soft}))))"""


def chunk(blocks: DataFrame, cfg: ChunkConfig = ChunkConfig(), keyed: bool = False) -> DataFrame:
    """doc, source, id, page_start, page_end, blocks, text, origin, confidence, hard_split; ids from 0 in each doc.

    keyed: the rows of a doc already lie in one partition (blocks was repartitioned by doc), so no shuffle is needed.
    """
    rows = sentence_rows(blocks if keyed else blocks.repartition("doc"))
    group = ["doc"] if cfg.cross_page else ["doc", "page_seq"]
    order = W.partitionBy(*group).orderBy("page_seq", "block_pos", "pos")
    rows = rows.withColumns({
        "i": F.row_number().over(order) - 1,
        "c": F.coalesce(F.sum(F.col("n") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"),
        "turns": F.coalesce(F.lag("page_seq").over(order) != F.col("page_seq"), F.lit(False)),
    })
    whole = W.partitionBy(*group)
    rows = rows.withColumns({"total": F.sum(F.col("n") + 1).over(whole).cast("int"), "many": F.count(F.lit(1)).over(whole).cast("int")})
    ahead = F.max("i").over(whole.orderBy("c").rangeBetween(0, cfg.target + 1))
    end = F.when(F.col("total") <= F.col("c") + cfg.target + 1, F.col("many")).otherwise(ahead)
    rank = F.when(F.col("origin") == "ocr", 2).when(F.col("origin") == "synthesized", 1).otherwise(0)
    rows = rows.withColumns({"e": F.greatest(F.col("i") + 1, end), "rank": rank})
    item = F.struct("i", "c", "e", "n", "turns", "s", "page", "block", "rank", "confidence")
    first = [F.min("page_seq").alias("seq")] if cfg.cross_page else [F.first("page_seq").alias("seq")]
    groups = rows.groupBy(*group).agg(F.first("source").alias("source"), *first, F.first("total").alias("total"), F.sort_array(F.collect_list(item)).alias("a"))
    groups = groups.withColumn("starts", F.expr(_orbit(cfg))).select("doc", "source", "seq", F.explode(F.expr(_emitted(cfg))).alias("k"))
    ordinal = F.row_number().over(W.partitionBy("doc").orderBy("seq", "k.step", "k.piece")) - 1
    origin = F.element_at(F.array(F.lit("native"), F.lit("synthesized"), F.lit("ocr")), F.col("k.rank") + 1)
    return groups.select(
        "doc", "source", ordinal.cast("long").alias("id"), "k.page_start", "k.page_end", "k.blocks", "k.text", origin.alias("origin"), "k.confidence", "k.hard_split"
    )


def weakest(origin: str = "origin", confidence: str = "confidence") -> tuple:
    """Aggregates for the weakest of several origins, and the least confidence of those that were recognised."""
    rank = F.max(F.when(F.col(origin) == "ocr", 2).when(F.col(origin) == "synthesized", 1).otherwise(0))
    names = F.array(F.lit("native"), F.lit("synthesized"), F.lit("ocr"))
    return F.element_at(names, rank + 1).alias(origin), F.min(F.when(F.col(origin) == "ocr", F.col(confidence))).alias(confidence)
