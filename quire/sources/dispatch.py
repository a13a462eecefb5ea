"""Files to blocks: an extractor for each extension, run over file bytes where Spark puts them.

One bad file gives an error row; the blocks of its pages before the failure stay, as a stream would have delivered them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import BBOX, BLOCKS
from .docx import docx_pages
from .errors import ExtractError
from .image import image_page
from .pdf import pdf_pages

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
EXTRACTED = f"path string, {BLOCKS}, error_kind string, error_page int, detail string"
_NAMES = [f.split()[0] for f in EXTRACTED.replace(BBOX, "x").split(", ")]


def pages_of(path: str, data: bytes, ocr: bool = False, dpi: int = 150) -> Iterator[dict]:
    """Pages (number, width, height, origin, confidence, blocks) of a file, in order."""
    name = path.rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if kind == "docx":
        for number, blocks in enumerate(docx_pages(data, path), 1):
            yield {"number": number, "width": 0.0, "height": 0.0, "origin": "synthesized", "confidence": None, "blocks": blocks}
    elif kind == "pdf":
        yield from pdf_pages(data, path, ocr, dpi)
    elif kind in IMAGES:
        yield {"number": 1} | image_page(data, path)
    else:
        raise ExtractError("unsupported", f"no extractor for .{kind}" if kind else "no extension", path)


def rows_of(doc: str, path: str, source: str, data: bytes | None, ocr: bool, dpi: int) -> Iterator[dict]:
    """Rows of EXTRACTED: one a block, and one with error_kind if the file fails. A page without blocks gives none."""
    file = {"path": path, "doc": doc, "source": source}
    try:
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        for seq, page in enumerate(pages_of(path, data, ocr, dpi)):
            whole = file | {k: page[k] for k in ("width", "height", "origin", "confidence")} | {"page_seq": seq, "page": page["number"]}
            for pos, block in enumerate(page["blocks"]):
                yield whole | {"block_pos": pos} | block
    except ExtractError as e:
        yield file | {"error_kind": e.kind, "error_page": e.page, "detail": str(e)}
    except OSError as e:
        yield file | {"error_kind": "io", "detail": f"{path}: {e.strerror or e}"}
    except Exception as e:  # noqa: BLE001  any other failure of a file must not fail the job either
        yield file | {"error_kind": "backend", "detail": f"{path}: {e!r}"}


def extract(files: DataFrame, ocr: bool = False, dpi: int = 150, batch: int = 2000) -> DataFrame:
    """files (doc, path, source, and data binary if the bytes are at hand) to rows of EXTRACTED."""
    has_data = "data" in files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for frame in frames:
            for f in frame.itertuples():
                for row in rows_of(f.doc, f.path, f.source, f.data if has_data else None, ocr, dpi):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)

    return files.mapInPandas(run, EXTRACTED)


_INTS = ("page_seq", "page", "block_pos", "block", "level", "row", "col", "error_page")
_TEXTS = ("path", "doc", "source", "kind", "text", "origin", "error_kind", "detail", "bbox")


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=_NAMES).astype({c: "Int32" for c in _INTS})
    for c in _TEXTS:
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def extract_paths(spark: SparkSession, paths: list[tuple[str, str]], ocr: bool = False, dpi: int = 150) -> DataFrame:
    """Rows of EXTRACTED for (path, shown name). doc is the place in the list, so that a path given twice is read twice."""
    names = spark.createDataFrame([(f"{k:09d}", p, s) for k, (p, s) in enumerate(paths)], "doc string, path string, source string")
    return extract(names.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)), "doc"), ocr, dpi)
