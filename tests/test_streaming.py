from quire.model import ChunkConfig
from quire.operators.chunk import chunk
from quire.plans.blocks import document_blocks
from quire.streaming.incremental import chunk_stream, read_blocks

from helpers import DATA


def test_stream_equals_batch(spark, tmp_path):
    blocks = document_blocks(spark, f"{DATA}/sf0.001")
    schema = "doc string, source string, page_seq int, page int, block_pos int, block int, text string, origin string, confidence float"
    half = blocks.where("cast(doc as int) % 2 = 0")
    half.coalesce(1).write.parquet(f"{tmp_path}/in")
    for rows in (None, blocks.where("cast(doc as int) % 2 = 1")):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chunk_stream(read_blocks(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc", "id", "text").orderBy("doc", "id").collect()
    assert got == chunk(blocks, ChunkConfig()).select("doc", "id", "text").orderBy("doc", "id").collect()
