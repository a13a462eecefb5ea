"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import discard, materialize, shared_dir, table_path  # noqa: F401

#: White space of the contracts: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII strings take the fast built-in."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers get, in rows and bytes, unless the session sets less.

    Also lets workers find this package where the driver found it.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(spark.conf.get(key).rstrip("b"))
            if now <= 0 or now > most:
                spark.conf.set(key, str(most))
        except Exception:  # noqa: BLE001  the setting is not known or not in plain bytes here
            pass


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every end of edges (a long, b long); root is the smallest node of the component.

    Each round, every node joins its smallest neighbour, the links are contracted and loops dropped; nodes that
    are no local minimum vanish, so the rounds grow with the logarithm of the number of links. Nothing is collected.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    roots = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), tag)
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("up"))
        parent = materialize(parent, tag)
        upper = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent2 = materialize(parent.join(upper, "up").select("node", "top"), tag)
        new_roots = roots.join(parent2.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new_roots = materialize(new_roots, tag)
        new_links = (
            links.join(parent2.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a")
            .join(parent2.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        new_links = materialize(new_links, tag)
        for old in (links, roots, parent, parent2):
            discard(old)
        links, roots = new_links, new_roots
    discard(links)
    return roots
