"""Chunking of documents as they arrive: a stream of block tables, each batch chunked like a table of its own.

A document must arrive whole (all its blocks in one file or micro-batch), as extraction delivers it. Writes are keyed by
batch, so a batch that is retried replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import ChunkConfig
from ..operators.chunk import chunk


def read_blocks(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunk_stream(blocks: DataFrame, out: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Chunk what is there and stop (available-now trigger); run again for what has come since."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
