"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target number of tokens, and its repetition rate is target over
size. A document is emitted floor(rate) times, and once more if a number in [0, 1) hashed from its id and the seed
lies under the fraction. Decisions depend on the id and the seed alone, so reruns and lost tasks give the same mix.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a source without tokens has
target 0 and emits nothing; a null doc_id is seeded by the empty string; repeated rows share one decision; an empty
table gives an empty mix. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize, table, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "quire-mix"


def word_count(col: str | Column = "text") -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(whole_text(col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def unit_hash(col: str | Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row a source.

    Targets split share * all tokens by weight, at most `most` times a source's size. Raising a common level until the
    budget is spent (sources reach their caps in the order of cap over weight) gives where resharing the excess ends:
    the level that the remaining budget allows rises as long as sources are capped below it, and falls after that.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    whole = W.partitionBy()
    caps = caps.withColumns({"budget": F.sum("source_size").over(whole) * F.lit(share), "all_weight": F.sum("weight").over(whole), "ratio": F.col("cap") / F.col("weight")})
    upto = whole.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    caps = caps.withColumns({"caps_before": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    caps = caps.withColumn("level", (F.col("budget") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before")))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    caps = caps.withColumn("water", level)
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    return caps.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """sized (a table with its tokens in `size`) with source_size, target and n_copies.

    The join on source is by broadcast when the sources take at most 1 MB; beyond that it is left to the planner.
    """
    targets = materialize(source_targets(sized.select("source", "size"), **how), "targets")
    small = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 40), F.lit(0))).first()[0] <= 1 << 20
    targets = targets.withColumnRenamed("source", "_source")
    sized = sized.drop("source_size", "target", "n_copies")
    joined = sized.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("_rate", rate)
    more = unit_hash("doc_id", seed) < F.col("_rate") - F.floor("_rate")
    return joined.withColumn("n_copies", F.floor("_rate").cast("int") + more.cast("int")).drop("_rate")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as it is taken."""
    every = F.sequence(F.lit(1), F.col("n_copies"))
    taken = copies(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count().alias("size")), **how)
    return taken.where("n_copies > 0").select("row", F.explode(every)).select("row.*")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns: n_copies."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "words")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s
), c AS (
  SELECT *, source_size * 2 AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget,
         CAST(sum(weight) OVER () AS BIGINT) AS all_weight, (source_size * 2)::DOUBLE / weight AS ratio FROM w
), b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM c
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (budget - caps_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM b
), t AS (
  SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l
), g AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, water * weight) END AS target FROM t
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('quire-mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), n AS (
  SELECT *, CAST(floor(rate) AS INT) + CAST(u < rate - floor(rate) AS INT) AS n_copies FROM r
)
SELECT doc_id, size, source_size, target, size * n_copies AS taken, n_copies FROM n
"""
