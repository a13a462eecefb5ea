import io
import struct
import zipfile

import pytest

from quire.operators.runs import merge_runs
from quire.plans.catalogue import RUNS
from quire.sources.docx import docx_pages
from quire.sources.errors import ExtractError
from quire.sources.image import image_size
from quire.sources.lines import merge
from quire.sources.listing import listing, supported

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, part: str = "word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str, pr: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text: str) -> str:
    return f"<w:tc>{text}</w:tc>"


def kinds(body: str):
    return [[(b["kind"], b.get("level"), b.get("row"), b.get("col"), b["text"], b["block"]) for b in page] for page in docx_pages(docx(body))]


def test_docx_kinds():
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("Plain") + p("Item", '<w:numPr><w:numId w:val="1"/></w:numPr>') + p("None", '<w:numPr><w:numId w:val="0"/></w:numPr>')
    assert kinds(body) == [[("heading", 1, None, None, "Title", 0), ("paragraph", None, None, None, "Plain", 1), ("list_item", None, None, None, "Item", 2), ("paragraph", None, None, None, "None", 3)]]


def test_docx_tables_nest():
    inner = f"<w:tbl><w:tr>{cell(p('in'))}</w:tr></w:tbl>"
    body = f"<w:tbl><w:tr>{cell(p('a'))}{cell(inner + p('b'))}</w:tr><w:tr>{cell(p('c'))}{cell(p('d'))}</w:tr></w:tbl>"
    assert [(b[2], b[3], b[4]) for b in kinds(body)[0]] == [(0, 0, "a"), (0, 0, "in"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]


def test_docx_sections_and_blanks():
    brk = "<w:sectPr><w:pgSz/></w:sectPr>"
    pages = kinds(p("One") + p("  ") + p("Two", brk) + p("Three") + brk)
    assert [[(b[4], b[5]) for b in page] for page in pages] == [[("One", 0), ("Two", 1)], [("Three", 0)]]
    assert kinds("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>")[0][0][4] == "a b c"


@pytest.mark.parametrize("data", [b"", b"not a zip", docx(p("x"), "other.xml"), docx("<w:p>")])
def test_docx_malformed(data):
    with pytest.raises(ExtractError) as e:
        list(docx_pages(data, "f.docx"))
    assert e.value.kind == "malformed"


def test_runs_forms_agree(spark):
    rows = spark.createDataFrame(RUNS, "doc string, page int, seq int, text string, x0 float, y0 float, x1 float, y1 float")
    got: dict = {}
    for r in merge_runs(rows).orderBy("doc", "block").collect():
        got.setdefault(r.doc, []).append((r.text, tuple(round(v, 3) for v in r.bbox)))
    for doc in {r[0] for r in RUNS}:
        lines = merge([(r[3], *r[4:]) for r in RUNS if r[0] == doc])
        assert got[doc] == [(b["text"], tuple(round(v, 3) for v in b["bbox"].values())) for b in lines]
    texts = {d: [t for t, _ in v] for d, v in got.items()}
    assert texts["pieces"] == ["office"] and texts["wide"] == ["north gate"] and texts["narrow"] == ["1897;"] and texts["rows"] == ["upper", "lower"]
    assert texts["upright"] == ["Harbour", "Street"] and texts["return"] == ["second", "first"] and texts["sizes"] == ["BIG tiny"] and texts["hollow"] == ["pq"]
    assert texts["cross"] == ["kite"] and texts["raised"] == ["m2"] and texts["spaced"] == ["iron age"] and texts["alone"] == ["margin"]


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20)
    assert image_size(png) == (30, 20)
    assert image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)) == (7, 9)
    with pytest.raises(ExtractError):
        image_size(b"nonsense")


def test_listing(spark, tmp_path):
    for name in ("b.docx", "a/x.PDF", "a/deep/y.png", "_hidden.docx", ".dot.docx", "skip.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "link.docx").symlink_to(tmp_path / "b.docx")
    rows = listing(spark, str(tmp_path)).collect()
    assert sorted(r.rel_path for r in rows) == [".dot.docx", "_hidden.docx", "a/deep/y.png", "a/x.PDF", "b.docx"]
    assert all(r.byte_size == 5 and r.mtime_ns == (tmp_path / r.rel_path).stat().st_mtime_ns for r in rows)
    assert supported("x.JPeG") and not supported("pdf")
