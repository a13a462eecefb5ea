import pytest

from quire.llm import mixing


def test_targets(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    # a, the null source and c reach their caps or their shares; the rest goes by weight
    assert got["a"] == 20 and got["d"] == 0 and got[None] == 200
    assert sum(got.values()) == pytest.approx(1.5 * 2110)
    assert got["b"] == pytest.approx(2 * got["c"]) or got["b"] == 2000


def test_mix(spark, small):
    docs = spark.read.parquet(small[0] + "/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.n_copies for r in mixing.op5_mix(spark, small[0]).collect() if r.n_copies}
    assert counts == want and max(counts.values()) <= 2
    assert mixing.op5_mix(spark, small[0]).orderBy("doc_id").collect() == mixing.op5_mix(spark, small[0]).orderBy("doc_id").collect()
