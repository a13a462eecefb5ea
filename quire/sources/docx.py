"""Blocks of a DOCX file: paragraphs, headings, list items and table cells of word/document.xml.

Sections are the pages. Text comes from text elements alone; a tab is a space, a break a line end (blank after
normalisation). A section break inside a paragraph ends the page behind that paragraph if the page has blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .errors import ExtractError
from .plain import plain_text

_HEADING = re.compile(r"[Hh]eading\s*\+?(\d+)\s*")


def heading(style: str | None) -> int | None:
    found = _HEADING.fullmatch(style or "")
    return int(found[1]) if found and 1 <= int(found[1]) <= 9 else None


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _val(node: ElementTree.Element) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == "val"), None)


class _Paragraph:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.style: str | None = None
        self.number: str | None = None
        self.breaks = False

    def kind(self, cell: tuple[int, int] | None) -> dict:
        if cell:
            return {"kind": "table_cell", "row": cell[0], "col": cell[1]}
        if self.number not in (None, "0"):
            return {"kind": "list_item"}
        level = heading(self.style)
        return {"kind": "heading", "level": level} if level else {"kind": "paragraph"}


def docx_pages(data: bytes, path: str = "") -> Iterator[list[dict]]:
    """Pages as lists of blocks, read as a stream of XML events."""
    try:
        source = zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")
    except (zipfile.BadZipFile, KeyError, OSError, NotImplementedError, RuntimeError) as e:
        raise ExtractError("malformed", f"no readable word/document.xml ({e})", path) from e
    page: list[dict] = []
    para: _Paragraph | None = None
    tables: list[list[int]] = []
    in_text = 0
    try:
        for event, node in ElementTree.iterparse(source, ("start", "end")):
            name = _local(node.tag)
            if event == "start":
                if name == "p":
                    para = _Paragraph()
                elif name == "t":
                    in_text += 1
                elif name == "tbl":
                    tables.append([0, 0])
                elif name == "tr" and tables:
                    tables[-1][1] = 0
                continue
            if name == "t":
                in_text -= 1
                if para:
                    para.text.append(node.text or "")
            elif name in ("tab", "br", "cr") and para:
                para.text.append(" " if name == "tab" else "\n")
            elif name == "pStyle" and para:
                para.style = _val(node)
            elif name == "numId" and para:
                para.number = _val(node)
            elif name == "sectPr" and para and len(node):
                para.breaks = True
            elif name == "tc" and tables:
                tables[-1][1] += 1
            elif name == "tr" and tables:
                tables[-1][0] += 1
            elif name == "tbl" and tables:
                tables.pop()
            elif name == "p" and para:
                text = plain_text("".join(para.text))
                if text:
                    page.append({"block": len(page), "text": text} | para.kind(tuple(tables[-1]) if tables else None))
                if para.breaks and page:
                    yield page
                    page = []
                para = None
                node.clear()
    except (ElementTree.ParseError, zipfile.BadZipFile, OSError, EOFError, ValueError) as e:
        raise ExtractError("malformed", f"word/document.xml does not parse ({e})", path) from e
    if page:
        yield page
