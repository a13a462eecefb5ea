import random
import zlib

import numpy as np

from helpers import DATA
from quire.llm import toxicity


def test_held_out_accuracy(spark, duck):
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, f"{DATA}/sf0.1").collect()}
    labels = duck("sf0.1").sql("SELECT doc_id, toxic FROM labels").fetchall()
    held = [(got[d].predicted, t) for d, t in labels if got[d].held_out]
    assert len(held) > 500
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.9
    assert sum(p for p, t in held if not t) / len(held) < 0.01
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["calm", "river", "stone", "cloud", "grass"])
    rows = [(k, " ".join([word() for _ in range(20)] + (["vilething"] if k % 3 == 0 else [])), "x") for k in range(300)] + [(1000, None, None), (1001, "", "y"), (None, "vilething", "z"), (1002, "calm " * 200_000 + "vilething", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 0, 1), (5, 0, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[3] > 0.5 > got[1] and got[1002] > 0.5 and got[None] > 0.5 and got[1000] == got[1001] < 0.5
    none = toxicity.fit(docs, labels.limit(0))
    assert np.allclose(none.scores(["", "x"]), 0, atol=1e-6)


def test_parts_do_not_change_a_score(monkeypatch):
    model = toxicity.Model(-1.0, np.arange(0, 1 << 20, 50), np.full(len(range(0, 1 << 20, 50)), 0.01))
    text = "abcdefghij klmno " * 300
    whole = model.scores([text, "x", text])
    monkeypatch.setattr(toxicity, "PART", 777)
    assert np.allclose(model.scores([text, "x", text]), whole) and whole[0] == whole[2]


def test_copies_of_a_text_count_once(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdgkm" for b in ("ar", "el", "io") for c in ("ton", "sel", "vik")]
    text = lambda bad: " ".join(rng.choices(words, k=30) + ["vilething"] * bad)
    rows = [(k, text(k % 3 == 0)) for k in range(200)]
    labels = [(k, int(k % 3 == 0)) for k in range(200)]
    fit = lambda docs, known: toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int"))
    kept = next(k for k in range(0, 200, 3) if zlib.crc32(b"%d" % k) % 4 != 2)
    copies = [(1000 + k, rows[kept][1]) for k in range(300)]
    one, many = fit(rows, labels), fit(rows + copies, labels + [(k, 1) for k, _ in copies])
    assert np.array_equal(one.buckets, many.buckets) and np.allclose(one.weights, many.weights)


def test_near_copies_do_not_crowd_out_features(spark):
    """A large group of near copies of one toxic text leaves the n-grams of the others their weight."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdgkm" for b in ("ar", "el", "io") for c in ("ton", "sel", "vik")]
    text = lambda bad: " ".join(rng.choices(words, k=30) + ["vilething"] * bad)
    rows = [(k, text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    long = " ".join(f"{w}{rng.randint(0, 99)}" for w in rng.choices(words, k=400))
    rows += [(1000 + k, f"{long} {rng.choice(words)} {k}", 1) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = model.scores([text(True) for _ in range(40)] + [text(False) for _ in range(40)])
    assert sum(got[:40] >= 0.3) >= 38 and sum(got[40:] >= 0.3) <= 2


def test_counts_and_ratios_against_plain_ones(spark):
    """The buckets kept and their log-count ratios are those that counting texts one by one gives."""
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choices(["calm", "river", "vile"], weights=[4, 4, 2 if k % 2 else 0], k=8)), k % 2) for k in range(120) if zlib.crc32(b"%d" % k) % 4 != 2]
    distinct: dict = {}
    for _, t, bad in texts:
        distinct[t] = max(bad, distinct.get(t, 0))
    seen = np.zeros((2, 1 << toxicity.BITS))
    for t, bad in distinct.items():
        for b in set(toxicity.presence([t])[1].tolist()):
            seen[bad, b] += 1
    n = [sum(v == k for v in distinct.values()) for k in (0, 1)]
    p, q, pooled = seen[1] / n[1], seen[0] / n[0], (seen.sum(0) + 1) / (sum(n) + 2)
    z = np.abs(p - q) / np.sqrt(pooled * (1 - np.minimum(pooled, 1 - 1e-9)) * (1 / n[0] + 1 / n[1]))
    docs, labels = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.buckets) and np.array_equal(model.buckets, np.flatnonzero(z >= toxicity.MIN_Z))
    r = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    found = [np.searchsorted(model.buckets, sorted(set(toxicity.presence([t])[1].tolist()) & set(model.buckets.tolist()))) for t in distinct]
    bias, w = toxicity.logistic(found, np.array(list(distinct.values()), float), r[model.buckets])
    assert np.allclose(model.weights, w * r[model.buckets], atol=1e-6) and abs(model.bias - bias) < 1e-6
