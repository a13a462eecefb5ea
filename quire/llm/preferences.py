"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt; what follows in either
conversation is its completion. A mask lists the spans, in code points of prompt plus completion, that a model is
trained on: the texts and end marks of the completion's assistant turns. Everything runs in SQL functions with one
shuffle; a task holds the turns of one pair at a time, which is the unit of the result.

The table of conversations names no pairs: conv_id 2n is the chosen and 2n + 1 the rejected one of pair n.

Edge cases: a null text is empty, a null role is `unknown`; a null conv_id takes no part; turns are ordered by turn
(null last), role and text, and equal rows count once; of a pair with one conversation the other side is null and
nothing is common; equal conversations are all prompt, with empty completions and masks; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

TRAINED = "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def paired(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side (0: chosen, 1: rejected), from neighbouring conv_ids."""
    return turns.where("conv_id is not null").withColumns({"pair_id": F.floor(F.col("conv_id") / 2), "side": F.pmod("conv_id", F.lit(2)).cast("int")})


def preferences(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """turns (pair_id, side, conv_id, turn, role, text) to one row a pair."""
    said = F.struct(
        F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    side = lambda k: F.when(F.col("side") == k, said)
    pairs = turns.groupBy("pair_id").agg(
        F.array_sort(F.collect_set(side(0))).alias("a"), F.array_sort(F.collect_set(side(1))).alias("b"),
        F.min(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"), F.min(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
    )
    same = "transform(slice(a, 1, least(size(a), size(b))), (x, i) -> x.role = b[i].role and x.text = b[i].text)"
    pairs = pairs.withColumn("same", F.expr(same)).withColumn("n_common", F.expr("cast(if(array_contains(same, false), array_position(same, false) - 1, size(same)) as int)"))
    drawn = f"concat('{OPEN}', x.role, '{CLOSE}', x.text, '{END}')".replace("\n", "\\n")
    pairs = pairs.withColumn("prompt", F.expr(f"array_join(transform(slice(a, 1, n_common), x -> {drawn}), '')"))
    for name, turns_ in (("chosen", "a"), ("rejected", "b")):
        tail = f"slice({turns_}, n_common + 1, greatest(size({turns_}) - n_common, 0))"
        spans = f"""aggregate({tail}, named_struct('at', length(prompt), 'out', cast(array() as array<string>)), (s, x) -> named_struct(
            'at', s.at + length({drawn}),
            'out', if(x.role = '{trained}', array_append(s.out, concat(s.at + {len(OPEN + CLOSE)} + length(x.role), ':', s.at + length({drawn}))), s.out)), s -> array_join(s.out, ','))"""
        there = F.col(f"{name}_id").isNotNull()
        pairs = pairs.withColumns({name: F.when(there, F.expr(f"array_join(transform({tail}, x -> {drawn}), '')")), f"{name}_mask": F.when(there, F.expr(spans))})
    return pairs.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(paired(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS drawn FROM t
), p AS (
  SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM n GROUP BY pair_id
), d AS (
  SELECT a.pair_id, min(a.k) AS k FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k AND (a.role <> b.role OR a.text <> b.text) GROUP BY a.pair_id
), c AS (
  SELECT p.*, coalesce(d.k - 1, least(na, nb)) AS n_common FROM p LEFT JOIN d USING (pair_id)
), s AS (
  SELECT n.*, c.n_common, coalesce(sum(length(drawn)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n JOIN c USING (pair_id)
), g AS (
  SELECT conv_id, coalesce(string_agg(drawn, '' ORDER BY k) FILTER (k <= n_common), '') AS prompt, coalesce(string_agg(drawn, '' ORDER BY k) FILTER (k > n_common), '') AS rest,
         coalesce(string_agg(CAST(CAST(before + 5 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(before + length(drawn) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (k > n_common AND role = 'assistant'), '') AS mask
  FROM s GROUP BY conv_id
)
SELECT c.pair_id, c.chosen_id, c.rejected_id, CAST(c.n_common AS BIGINT) AS n_common, coalesce(a.prompt, '') AS prompt, a.rest AS chosen, b.rest AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM c LEFT JOIN g a ON a.conv_id = c.chosen_id LEFT JOIN g b ON b.conv_id = c.rejected_id
"""
