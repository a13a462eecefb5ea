"""Driver tables seen as documents: blocks of single-page and of multi-page documents, and snapshots of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page, each of its lines a block."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("source"), F.posexplode(F.split("text", "\n")).alias("block_pos", "text"))
    return docs.select("doc", "source", F.lit(0).alias("page_seq"), F.lit(1).alias("page"), "block_pos", F.col("block_pos").alias("block"), "text", F.lit("native").alias("origin"), F.lit(None).cast("float").alias("confidence"))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a document, each turn a page of one block; provenance goes round by turn."""
    turns = read(spark, sf_dir, "conversations")
    kind = F.col("turn") % 3
    return turns.select(
        F.col("conv_id").cast("string").alias("doc"), F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("page_seq"), (F.col("turn") + 1).cast("int").alias("page"),
        F.lit(0).alias("block_pos"), F.lit(0).alias("block"), "text",
        F.when(kind == 0, "native").when(kind == 1, "synthesized").otherwise("ocr").alias("origin"),
        F.when(kind == 2, (0.5 + (F.col("conv_id") % 5) / 10.0).cast("float")).alias("confidence"),
    )


PATH = "concat('d', doc_id % 7, case when doc_id % 2 = 0 then '/sub' else '' end, '/f', doc_id, '.docx')"


def stored_snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, paths) as an earlier run left them: all documents but each ninth; contents with an id divisible by 11 failed."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 9 <> 0")
    paths = docs.selectExpr(f"{PATH} as rel_path", "sha2(text, 256) as content_hash", "doc_id * 1000 as mtime_ns", "cast(octet_length(text) as long) as byte_size", "doc_id")
    files = paths.groupBy("content_hash").agg(F.when(F.min(F.col("doc_id") % 11) == 0, "failed").otherwise("indexed").alias("status"), F.min("byte_size").alias("byte_size"))
    return files, paths.drop("doc_id")


def walked_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing now: each 13th document gone, each 5th touched, each 10th edited."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 13 <> 0")
    text = "case when doc_id % 10 = 0 then concat(text, ' edited') else text end"
    return docs.selectExpr(f"{PATH} as rel_path", f"cast(octet_length({text}) as long) as byte_size", "doc_id * 1000 + case when doc_id % 5 = 0 then 1 else 0 end as mtime_ns", f"sha2({text}, 256) as content_hash")
