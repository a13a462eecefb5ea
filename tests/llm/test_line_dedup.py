from quire.llm import line_dedup


def test_dedup_lines(spark):
    line = "This line has more than forty code points, it has"
    rows = [(k, f"own {k}\n{line}\nend", k) for k in range(6)] + [(10, f" {line.upper()}\t\n{line}", 0), (None, line, 0), (11, None, 1), (12, "", 2), (13, line[:30], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k in range(6)] == [f"own {k}\nend" for k in range(6)]
    assert got[10] == rows[6][1] and got[None] == line and got[11] is None and got[12] == "" and got[13] == line[:30]
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_four_documents_are_not_enough(spark):
    line = "x" * 40
    docs = spark.createDataFrame([(k, f"{line}\n{line}") for k in range(4)], "doc_id long, text string")
    assert all(r.text == f"{line}\n{line}" for r in line_dedup.dedup_lines(docs).collect())


def test_long_text(spark):
    line = "y" * 50
    docs = spark.createDataFrame([(k, "\n".join([line, "z"] * 20_000)) for k in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == "\n".join(["z"] * 20_000) and got[4].count(line) == 20_000


def test_rows_that_share_a_doc_id(spark, monkeypatch):
    """Each row is cut by its own lines, whether bitmaps are broadcast or shuffled; a column `runs` stays."""
    line = "A line of more than forty code points that many share"
    rows = [(k, f"{line}\nmine {k}", 70 + k) for k in range(6)] + [(0, "alpha row\nprecious unique line that must stay, whatever comes\nomega", 77), (0, f"x\n{line}", 78), (0, f"x\n{line}", 78)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    want = sorted([(k, f"mine {k}", 70 + k) for k in range(5)] + [rows[5], rows[6], (0, "x", 78), (0, "x", 78)])
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect())) == want
