"""Positioned text runs merged into lines: gaps and islands over each page's reading order.

Tolerances are fixed values, in multiples of run heights, compared in single precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SPACE, normalize

SAME_LINE = 0.5
WORD_GAP = 0.2


def merge_runs(segments: DataFrame) -> DataFrame:
    """segments (doc, page, seq, text, x0..y1) to doc, page, block, kind, text, bbox; blocks count from 0 in each page.

    A run continues the line of the run before it (blank runs do not count) if their middles are near, it does not go
    back to the left, and neither is vertical writing. A space goes between them if either has one at that edge, or if
    the gap is wide for the lower of the two.
    """
    f = lambda v: F.lit(v).cast("float")
    rows = segments.withColumn("t", normalize("text")).where(F.length("t") > 0)
    rows = rows.withColumns({"h": F.col("y1") - F.col("y0"), "mid": (F.col("y0") + F.col("y1")) / f(2.0), "opens": F.col("text").rlike(f"^[{SPACE}]"), "closes": F.col("text").rlike(f"[{SPACE}]$")})
    rows = rows.withColumn("vertical", (F.length("t") >= 3) & (F.col("h") > (F.col("x1") - F.col("x0")) * f(2.0)))
    order = W.partitionBy("doc", "page").orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("h", "mid", "x0", "x1", "closes", "vertical")}
    rows = rows.withColumns({f"p_{c}": v for c, v in before.items()})
    near = F.abs(F.col("p_mid") - F.col("mid")).cast("float") <= F.greatest("p_h", "h") * f(SAME_LINE)
    goes_on = F.coalesce(near & (F.col("x0") >= F.col("p_x0")) & ~F.col("vertical") & ~F.col("p_vertical"), F.lit(False))
    wide = (F.col("x0") - F.col("p_x1")).cast("float") > F.least("p_h", "h") * f(WORD_GAP)
    rows = rows.withColumn("goes_on", goes_on).withColumn("piece", F.when(goes_on & (F.col("p_closes") | F.col("opens") | wide), F.concat(F.lit(" "), "t")).otherwise(F.col("t")))
    rows = rows.withColumn("block", F.sum((~F.col("goes_on")).cast("int")).over(order) - 1)
    lines = rows.groupBy("doc", "page", "block").agg(
        F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return lines.select("doc", "page", F.col("block").cast("int").alias("block"), F.lit("line").alias("kind"), text.alias("text"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))
