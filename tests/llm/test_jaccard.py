import random

import numpy as np
import pyarrow as pa
import pytest

from brute import components, shingles
from quire.llm import jaccard
from quire.llm.words import shingle_sets


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, **how).collect()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(spark, small, k, num, den):
    rows = [(r[0], r[1]) for r in small[1]]
    assert got(spark, rows, k=k, num=num, den=den) == components(rows, k, num, den)


def test_dense_family(spark, monkeypatch):
    """Many near copies at all distances from a base: regions are divided several times."""
    monkeypatch.setattr(jaccard, "LEAF", 2)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(100)] = f"e{rng.randint(0, 40)}"
        rows.append((k * 7 % 151, " ".join(w)))
    for num in (90, 80):
        assert got(spark, rows, k=3, num=num, den=100) == components(rows, 3, num, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b\tc D e\nf"), (None, "a b c d e f"), (3, None), (4, ""), (5, "solo"), (6, "SOLO"), (7, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(df, 3, 90, 100).collect()), key=str)
    assert out == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (None, 4, None), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7)], key=str)
    kept = jaccard.keep_one(df, 3, 90, 100).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, None, 3, 4, 5, 7], key=str)


def test_shingle_sets_sizes():
    texts = ["", None, "one", "x y", "A b\tc d\x0b\x0ce", "ünï CODE " * 3, "w " * 10, "a" * (3 << 20) + " b c"]
    for k in (3, 5):
        assert [len(s) for s in shingle_sets(pa.array(texts), k)] == [len(shingles(t, k)) for t in texts]
    a, b = shingle_sets(pa.array(["p q R s", "x p q r s"]), 3)
    assert len(np.intersect1d(a, b)) == 2


@pytest.mark.parametrize("num", [90, 80])
def test_no_link_is_lost(spark, num):
    """One base, many different near copies of it, and copies of some."""
    rng = random.Random(6)
    rows = []
    for k in range(120):
        w = [f"w{i}" for i in range(90)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = f"e{rng.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, rows[k][1].upper()) for k in range(9)] + [(900, None), (901, "alone in here")]
    sets = {i: frozenset(shingles(t, 3)) for i, t in rows}
    near = lambda a, b: bool(a) and len(a & b) * 100 >= num * len(a | b)
    want = {i: (min([j for j in sets if sets[j] == s], default=i) if s else i, sum(near(s, o) for j, o in sets.items() if j != i)) for i, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_links(df, 3, num, 100).collect()} == want
    assert sum(n for _, n in want.values()) > 2 * len(rows)


def test_texts_that_share_a_doc_id(spark):
    """Each text keeps its links; the document is linked with whatever one of them is linked with."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (3, a + " more"), (7, b + " more"), (8, "alone"), (9, "x y z u v w"), (9, "other words here in this one"), (9, None), (9, "other words here in this one")]
    assert got(spark, rows, k=3, num=90, den=100) == {5: (58, 3), 3: (59, 3), 7: (59, 3), 8: (1, 8), 9: (0, 9)} | {9: got(spark, rows, k=3, num=90, den=100)[9]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(df, 3, 90, 100).collect())
    assert kept == sorted([(3, a + " more"), (5, b), (8, "alone"), (9, ""), (9, "other words here in this one"), (9, "x y z u v w")])


@pytest.mark.parametrize(("tile", "pivots"), [(4, 3), (16, 12), (256, 12)])
def test_regions_within_a_task(monkeypatch, tile, pivots):
    """Voronoi division in memory finds every pair that brute force finds."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rng = random.Random(tile)
    sets = []
    for family in range(6):
        base = [rng.randrange(1 << 60) for _ in range(rng.choice([5, 40, 90]))]
        for _ in range(25):
            s = set(base)
            for _ in range(rng.randint(0, 8)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(50) + 1000 * family)
            sets.append(np.array(sorted(s), np.int64))
    for num in (80, 90):
        held = jaccard._Sets(sets, num, 100)
        found = {(min(i, j), max(i, j)) for a, b in jaccard.near_pairs(held, np.arange(len(sets)), np.zeros(0, np.int64)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        plain = [set(s.tolist()) for s in sets]
        want = {(i, j) for j in range(len(plain)) for i in range(j) if 100 * len(plain[i] & plain[j]) >= num * len(plain[i] | plain[j])}
        assert found == want and want


def test_many_links_in_blocks(spark, small, monkeypatch):
    """Regions over LEAF go to tasks in blocks and count the same links."""
    df = spark.createDataFrame([(r[0], r[1]) for r in small[1]], "doc_id long, text string")
    count = lambda: sorted(map(tuple, jaccard.join_links(df, 3, 80, 100).collect()))
    whole = count()
    monkeypatch.setattr(jaccard, "LEAF", 6)
    assert count() == whole and sum(r[3] for r in whole) > 100
