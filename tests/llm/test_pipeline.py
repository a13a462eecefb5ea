"""The pipeline against a plain version of its stages; the classifier's decisions are taken as they are."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from brute import components, lower, words
from helpers import DATA
from quire.llm import mixing, toxicity
from quire.llm.shared import materialize, table


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], f"{DATA}/sf0.001"), "test"))
    return out


def rows(df):
    return sorted(df.collect(), key=str)


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], table(spark, f"{DATA}/sf0.001", "labels"))
    want = [r for r in rows(stages[0]) if model.scores([r.text])[0] < 0.3]
    assert rows(stages[1]) == want and 0 < len(want) < stages[0].count()


def test_lines(stages):
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for r in rows(stages[1]):
        for line in r.text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r.doc_id)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    for r in rows(stages[2]):
        before = next(x for x in rows(stages[1]) if x.doc_id == r.doc_id).text
        assert r.text == "\n".join(x for x in before.split("\n") if last.get(key(x), r.doc_id) == r.doc_id)
        assert r.n_chars == len(r.text)


def test_near_copies(stages):
    before = rows(stages[2])
    found = components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert {r.doc_id for r in rows(stages[3])} == {d for d, (n, c) in found.items() if c == d}


def test_mix(spark, stages):
    size = Counter()
    for r in rows(stages[3]):
        size[r.source] += len(words(r.text))
    taken = Counter()
    for r in rows(stages[4]):
        taken[r.source] += len(words(r.text))
    assert stages[4].columns == stages[0].columns
    sized = stages[3].select("source", mixing.word_count().alias("size"))
    targets = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sum(taken.values()) == pytest.approx(sum(targets.values()), rel=0.15)


def test_packing(stages):
    docs = Counter(r.doc_id for r in rows(stages[4]))
    firsts = Counter(r.doc_id for r in rows(stages[5]) if r.piece == 0)
    assert firsts == docs
    at = defaultdict(int)
    for r in sorted(rows(stages[5]), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= sum(at.values()) / 2048 + 2


def test_names():
    assert [re.sub("[^a-z]", "", n.lower()) for n, _ in corpus_pipeline.STAGES] == ["toxicity", "linededup", "ngramjaccardjoin", "mixingsources", "bestfitpacking"]
