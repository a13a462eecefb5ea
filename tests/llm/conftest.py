import random

import pytest

WORDS = "alpha beta gamma delta omega river stone cloud Tree house été über niño мир 東京 lamp".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


def corpus(seed=1, n=120):
    """(doc_id, text, lang, source, n_chars): prose with exact and near copies, shared lines, nulls, empty and blank texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 12, 40, 90, 200])) for _ in range(n)]
    base = prose(rng, 120)
    for k in range(40):  # near copies at growing distances
        w = base.split()
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    shared = "This line of forty code points and more is shared by many documents"
    texts += [f"{prose(rng, 10)}\n{shared}\n  {shared.upper()} \t\n{prose(rng, 5)}" for _ in range(8)]
    texts += [texts[0], texts[0].upper(), texts[1] + " ", None, "", " \n\t ", "one", "ONE", "one two", "x" * 3000, "\n" * 50, prose(rng, 6000)]
    rng.shuffle(texts)
    sources = ["a", "a", "a", "b", "ü", "c", None]
    return [(k, t, "en", rng.choice(sources), len(t or "")) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """Folder with a small documents table, and its rows."""
    path = tmp_path_factory.mktemp("tables")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """Folder with empty tables."""
    path = tmp_path_factory.mktemp("nothing")
    kinds = {"documents": SCHEMA, "embeddings": "vec_id long, embedding array<float>, label int", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def write(spark, path, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)
