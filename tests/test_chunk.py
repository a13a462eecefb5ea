"""The window-and-fold chunker against a literal packer that takes one sentence at a time."""

import random

import pytest

from quire.model import ChunkConfig
from quire.operators.chunk import chunk
from quire.plans.catalogue import EDGE

SCHEMA = "doc string, source string, page_seq int, page int, block_pos int, block int, text string, origin string, confidence float"


def blocks(pages, doc="d", origin="native", confidence=None):
    return [(doc, doc, k, page, b, b, t, origin, confidence) for k, (page, texts) in enumerate(pages) for b, t in enumerate(texts)]


def run(spark, rows, cfg):
    return chunk(spark.createDataFrame(rows, SCHEMA), cfg).orderBy("doc", "id").collect()


def sentences_of(text):
    out, cur = [], ""
    for w in text.split():
        cur = f"{cur} {w}".strip()
        if w.rstrip("\"')]")[-1:] in (".", "!", "?"):
            out.append(cur)
            cur = ""
    return out + [cur] * bool(cur)


def packed(pages, cfg):
    """Texts, packing greedily from a queue of sentences that is refilled page by page."""
    target, queue, out = min(cfg.target_chars, cfg.max_chars), [], []

    def drain(last):
        while queue:
            if len(queue[0]) > cfg.max_chars:
                s, n = queue.pop(0), max(cfg.max_chars, 1)
                out.extend((s[k : k + n], True) for k in range(0, len(s), n))
                continue
            take, size = 0, -1
            while take < len(queue) and (take == 0 or (size < target and size + 1 + len(queue[take]) <= target)):
                size += 1 + len(queue[take])
                take += 1
            if take == len(queue) and size < target and not last:
                return
            out.append((" ".join(queue[:take]), False))
            tail = queue[:take]
            del queue[:take]
            k = min(cfg.overlap_sentences, take)
            if queue and k and take > k and len(queue[0]) <= cfg.max_chars:
                queue[:0] = tail[-k:]

    for _, texts in pages:
        queue += [s for t in texts for s in sentences_of(t)]
        drain(not cfg.cross_page)
    drain(True)
    return out


@pytest.mark.parametrize("cross", [False, True])
def test_random_documents(spark, cross):
    rng = random.Random(5)
    for target, most, overlap in [(45, 60, 1), (60, 80, 2), (41, 41, 0), (30, 100, 4), (0, 30, 1)]:
        docs, rows = {}, []
        for d in range(25):
            pages = [(p + 1, [" ".join(rng.choice("abc") * rng.randint(1, 40) + rng.choice(".!?") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]) for p in range(rng.randint(1, 4))]
            docs[f"d{d:02d}"] = pages
            rows += blocks(pages, f"d{d:02d}")
        cfg = ChunkConfig(target, most, overlap, cross)
        got: dict = {}
        for r in run(spark, rows, cfg):
            got.setdefault(r.doc, []).append((r.text, r.hard_split))
        for d, pages in docs.items():
            assert got.get(d, []) == packed(pages, cfg), (d, cfg)


@pytest.mark.parametrize(("name", "want"), [
    ("tail", ["A" * 9 + ". " + "B" * 29 + ".", "B" * 29 + ".", "C" * 19 + "."]), ("exhausted", ["X" * 19 + ". " + "Y" * 19 + ".", "Z" * 9 + "."]),
    ("one_page", ["X" * 19 + ". " + "Y" * 19 + ".", "Y" * 19 + ". " + "Z" * 9 + "."]), ("hard", ["Ok one.", "w" * 10, "w" * 10, "wwwww.", "Tail."]),
])
def test_edges(spark, name, want):
    pages, cfg = EDGE[name]
    assert [r.text for r in run(spark, blocks([(p, [t]) for t, p in pages]), cfg)] == want


def test_refs_pages_and_ids(spark):
    got = run(spark, blocks([(1, ["One here. Two here.", "Three."]), (2, ["Four."]), (7, ["Five."])]), ChunkConfig(cross_page=True))
    assert [(r.page_start, r.page_end, [(b.page, b.block) for b in r.blocks]) for r in got] == [(1, 7, [(1, 0), (1, 1), (2, 0), (7, 0)])]
    got = run(spark, blocks([(1, ["One."]), (2, ["Two."]), (7, ["Three."])]), ChunkConfig())
    assert [(r.id, r.page_start, r.page_end) for r in got] == [(0, 1, 1), (1, 2, 2), (2, 7, 7)]


def test_weakest_origin(spark):
    mixed = blocks([(1, ["One."])]) + [("d", "d", 1, 2, 0, 0, "Two.", "ocr", 0.6), ("d", "d", 2, 3, 0, 0, "Three.", "ocr", 0.9), ("d", "d", 3, 4, 0, 0, "Four.", "synthesized", None)]
    got = run(spark, mixed, ChunkConfig(overlap_sentences=0, cross_page=True))
    assert [(r.origin, round(r.confidence, 3)) for r in got] == [("ocr", 0.6)]


def test_nothing_in_nothing_out(spark):
    assert run(spark, blocks([(1, ["", "  \n "])]), ChunkConfig()) == []
    assert run(spark, [], ChunkConfig()) == []


def test_long_group_stays_linear(spark):
    rows = blocks([(1, [" ".join(f"Sentence number {k}." for k in range(20_000))])])
    got = run(spark, rows, ChunkConfig(overlap_sentences=0))
    assert " ".join(r.text for r in got) == rows[0][6]
