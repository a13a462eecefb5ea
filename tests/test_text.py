import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.ocr import mean_confidence
from quire.sources.plain import plain_text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f("v")).collect()]


@pytest.mark.parametrize(("raw", "want"), [
    ("\u201cTea\u201d at the cook\u2019s", "\"Tea\" at the cook's"), ("later\u2026", "later..."), ("\r two\t\ttabs \n\n lines ", "two tabs lines"),
    ("20\u00a0km", "20 km"), ("bell\x07 and\x00end", "bell andend"), ("\t\r\n", ""), ("", ""), ("rec\x1eord", "record"), ("zero\u200bwidth", "zero\u200bwidth"), (None, None),
])
def test_normalize(spark, raw, want):
    assert column(spark, [raw], T.normalize) == [want]
    assert raw is None or plain_text(raw) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .\t\n\x00\x1c\x85\xa0 　“–…é🙂"), max_size=20), min_size=1, max_size=20))
def test_normalize_forms_agree(spark, texts):
    got = column(spark, texts, T.normalize)
    assert got == [plain_text(t) for t in texts]
    assert column(spark, got, T.normalize) == got


@pytest.mark.parametrize(("text", "want"), [
    ("Rain fell! Did it stop? It did.", ["Rain fell!", "Did it stop?", "It did."]), ("Version 2.10.7 ships.", ["Version 2.10.7 ships."]), ('Ana asked, "why?" Nobody knew.', ['Ana asked, "why?"', "Nobody knew."]),
    ("nothing ends this", ["nothing ends this"]), ("", []), ("Go! ? on", ["Go!", "?", "on"]), ("U.S. Navy", ["U.S.", "Navy"]),
])
def test_sentences(spark, text, want):
    assert column(spark, [text], T.sentences) == [want]


def test_hard_split(spark):
    parts = column(spark, ["é" * 500], lambda c: T.hard_split(c, 301))[0]
    assert "".join(parts) == "é" * 500 and max(map(len, parts)) == 301
    assert column(spark, ["abc"], lambda c: T.hard_split(c, 0)) == [["a", "b", "c"]]


def test_ocr_confidence(spark):
    row = lambda conf, word: "\t".join(["5"] * 10 + [conf, word])
    head = "\t".join("abcdefghijkl")
    reports = ["\n".join([head, row("-1", ""), row("64", "stone"), row("36", "bridge")]), head, "\n".join([head, row("x", "w"), "short"])]
    got = column(spark, reports, T.ocr_confidence)
    assert got == pytest.approx([0.5, 0, 0])
    assert [mean_confidence(r) for r in reports] == pytest.approx([0.5, 0, 0])


def test_tokens(spark):
    assert column(spark, ["Éa, naïve-42 Ünder_x"], T.tokens) == [["ea", "naive", "42", "under", "x"]]


def test_paths(spark):
    rows = spark.createDataFrame([("a.docx",), ("a b/q.docx",), ("a/x.docx",), ("b/a.pdf",)], "p string").orderBy(T.path_order("p"))
    assert [r.p for r in rows.collect()] == ["a/x.docx", "a b/q.docx", "a.docx", "b/a.pdf"]
    assert [r[0] for r in rows.select(T.is_supported(F.lit("X.TIF"))).limit(1).collect()] == [True]
