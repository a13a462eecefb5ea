"""JSON lines out of blocks and chunks, in a defined order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_json() -> Column:
    """Keys in declaration order; a confidence that is null is left out."""
    return F.to_json(F.struct("id", "source", "page_start", "page_end", "blocks", "text", "origin", "confidence", "hard_split"))


def block_json() -> Column:
    """Keys in alphabetical order; absent ones are left out."""
    confidence = F.col("confidence").cast("double").alias("confidence")
    return F.to_json(F.struct("bbox", "col", confidence, F.col("block").alias("id"), "kind", "level", "origin", "page", "row", "source", "text"))


def ordered_lines(df: DataFrame, line: Column, *order: str | Column) -> Iterator[str]:
    """Lines in order, fetched a partition at a time."""
    keys = {f"k{n}": F.col(o) if isinstance(o, str) else o for n, o in enumerate(order)}
    lines = df.select(line.alias("line"), *(c.alias(k) for k, c in keys.items()))
    for row in lines.orderBy(*keys).select("line").toLocalIterator():
        yield row.line


def write_lines(df: DataFrame, line: Column, folder: str) -> None:
    """Lines as text files, one partition's documents each: the scalable sink, without a global order."""
    df.select(line.alias("value")).write.text(folder)
