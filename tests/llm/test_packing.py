import json
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quire.llm import packing


def check(rows, texts):
    """Every piece is there, with its ids, and sequences are gapless and full enough."""
    own = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for doc, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cuts(len(ids))):
            want.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return len(by), sum(r.length for r in rows)


def test_query(spark, small):
    folder, rows = small
    got = packing.op8_packing(spark, folder).collect()
    sequences, tokens = check(got, [(r[0], r[1]) for r in rows])
    assert sequences <= -(-tokens // packing.SEQUENCE) + 1


def test_odd_texts(spark, tmp_path):
    texts = [None, "", "a", "a", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|end", " " * 5000, "é🙂日本 " * 3000, "a" * 9000, "\n\t   x y", "don't I'll  WE'VE 12345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack_documents(docs).collect(), list(enumerate(texts)))


def test_full_pieces_alone_and_none(spark):
    docs = spark.createDataFrame([(1, "a b " * 1023 + "a"), (2, "a b " * 1023 + "a")], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert [r.length for r in got] == [2048, 2048] and len({r.sequence_id for r in got}) == 2 and {r.offset for r in got} == {0}
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_cuts():
    assert list(packing.cuts(1)) == [(0, 1)] and list(packing.cuts(2048)) == [(0, 2048)]
    assert list(packing.cuts(2049)) == [(0, 1), (1, 2048)] and list(packing.cuts(5000)) == [(0, 904), (904, 2048), (2952, 2048)]


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(1)
    for lengths in (np.clip(rng.exponential(600, 20_000), 1, 2048).astype(int), np.full(1000, 700), np.array([2048, 1]), np.array([], int)):
        h = np.bincount(lengths, minlength=2049)
        used, n = np.zeros(2049, int), 0
        for shape, k in packing.plan(h):
            assert sum(shape) <= 2048
            n += k
            for v in shape:
                used[v] += k
        assert (used == h).all()
        if len(lengths) > 1000:
            assert n <= 1.002 * lengths.sum() / 2048 + 1


def test_fast_and_file_tokenizer_agree():
    encode = packing.tokenizer(packing.vocabulary_path())
    own = Tokenizer.from_file(packing.vocabulary_path())
    rng = random.Random(4)
    signs = list("ab Zé9'\n\t .,;-_🙂日  \x1c\x00 ")
    for _ in range(500):
        text = "".join(rng.choices(signs, k=rng.randint(0, 60)))
        assert encode(text) == own.encode(text, add_special_tokens=False).ids, json.dumps(text)
