import math
import random

import numpy as np
import pytest

from brute import nearest, top_k
from helpers import DATA
from quire.llm import mtree, nndescent

KIND = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    rows = {k: (middle[k % 6] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist() for k in range(n)}
    for k in range(50, 90):  # copies, some of them queries
        rows[k if k % 2 else 2 * k] = rows[7]
    rows[100] = rows[200] = rows[7]
    return rows


def store(spark, rows, path):
    odd = [(9001, None, 0), (9002, [], 0), (9003, [1.0, None] + [0.0] * 10, 0), (9004, [math.nan] * 12, 0), (9005, [math.inf] + [0.0] * 11, 0), (None, [1.0] * 12, 0), (9100, [1.0, 2.0], 0)]
    spark.createDataFrame([(k, v, 1) for k, v in rows.items()] + odd, KIND).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("tree", [60, 8192])
def test_mtree_is_exact(spark, tmp_path, monkeypatch, tree):
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rows = vectors()
    got: dict = {}
    for r in mtree.op1_mtree(spark, store(spark, rows, tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = top_k(rows, [k for k in rows if k % 100 == 0], 10)
    assert got == want


def test_tree_prunes_and_bounds_hold():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 3000
    v = np.concatenate([c + rng.normal(size=(100, 8)) * 40 for c in centres]).astype(np.int64)
    t = mtree.Tree(np.arange(len(v)), v, int((v * v).sum(1).max()))
    hits, computed = t.search(v[5], 5, 10)
    s = v @ v[5]
    order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != 5][:10]
    assert hits == [(int(s[i]), int(i)) for i in order] and computed < len(v) / 3
    bounded, less = t.search(v[5], 5, 10, hits[-1][0])
    assert bounded == hits and less <= computed
    pages = mtree._from_pages(mtree._to_pages(1, t))
    assert pages.search(v[5], 5, 10)[0] == hits


def test_nn_descent(spark, tmp_path):
    rows = vectors() | {8000: [0.0] * 12}
    got: dict = {}
    for r in nndescent.op6_nn_descent(spark, store(spark, rows, tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    rows.pop(8000)
    want = nearest(rows, [k for k in rows if k % 100 == 0], 10)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert right >= 0.95 * 10 * len(want)
    for q, hits in got.items():
        assert hits == sorted(hits)
        for d, i in hits:
            assert d == pytest.approx(float(np.sqrt(((np.array(rows[q]) - np.array(rows[i])) ** 2).sum())), abs=1e-12)
    assert got[100] == want[100]  # copies: ties by id


def test_recall_on_generated_table(spark, duck):
    table = duck("sf0.1").sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = nearest(dict(table), [k for k, _ in table if k % 100 == 0], 10)
    got: dict = {}
    for r in nndescent.op6_nn_descent(spark, f"{DATA}/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    assert right >= 0.95 * 10 * len(want)


def test_few_rows(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.op1_mtree(spark, str(tmp_path)).orderBy("rank").collect()] == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 0)]
    assert [(r.rank, r.vec_id, r.score) for r in nndescent.op6_nn_descent(spark, str(tmp_path)).orderBy("rank").collect()] == [(1, 2, 0.0), (2, 1, math.sqrt(2))]
    random.seed(0)


def test_nn_descent_tells_near_copies_apart(spark, tmp_path):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(900, 16)) + 3
    table[::3] = table[0] + rng.normal(size=(300, 16)) * 1e-5
    rows = {k: v.astype(np.float32).tolist() for k, v in enumerate(table)}
    write = [(k, v, 1) for k, v in rows.items()]
    spark.createDataFrame(write, KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict = {}
    for r in nndescent.op6_nn_descent(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(rows, [0, 300, 600], 10)  # the queries among the near copies
    right = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    print("recall among near copies", right / 30)
    assert right >= 0.95 * 10 * len(want)


def test_nn_descent_searches_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = {k: rng.normal(size=5 if k % 300 in (0, 1, 2) else 12).astype(np.float32).tolist() for k in range(600)}
    rows |= {1000: [1.0, 2.0], 1001: rows[300], 1100: [3.0, 4.0, 5.0]}  # alone in their dimensions; a copy of a query
    write = [(k, v, 1) for k, v in rows.items()]
    spark.createDataFrame(write, KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict = {}
    for r in nndescent.op6_nn_descent(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((pytest.approx(r.score, abs=1e-12), r.vec_id))
    for dim in (5, 12):
        same = {k: v for k, v in rows.items() if len(v) == dim}
        want = nearest(same, [k for k in same if k % 100 == 0], 10)
        assert all(len(got[q]) == min(10, len(same) - 1) for q in want)
        right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert right >= 0.95 * sum(map(len, want.values()))
    assert set(got) == {k for k in rows if k % 100 == 0} - {1000, 1100}
    assert [i for _, i in got[0]] == [i for _, i in nearest({k: v for k, v in rows.items() if len(v) == 5}, [0], 10)[0]]
    other = spark.createDataFrame([(7, [1.0] * 3), (8, None), (9, [1.0] * 4)], "query_id long, v array<double>")
    table = spark.createDataFrame(write, KIND)
    assert [(r.query_id, r.vec_id) for r in nndescent.nearest(table, other).collect()] == [(7, 1100)]  # nothing has four components
