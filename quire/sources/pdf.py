"""PDF pages. Text runs come from a library where one is installed; runs become lines as in operators.runs.

Without a PDF library only pages without any content can be told apart from the bytes, so a PDF fails with a
`backend` error: never an empty result. Extracted runs of other tools enter through operators.runs.merge_runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

from .errors import ExtractError


def pdf_pages(data: bytes, path: str, ocr: bool, dpi: int) -> Iterator[dict]:
    if not data.startswith(b"%PDF-") and b"%PDF-" not in data[:1024]:
        raise ExtractError("malformed", "no PDF header", path)
    if find_spec("pypdfium2") is None:
        raise ExtractError("backend", "no PDF library is installed (pypdfium2)", path)
    yield from _with_pdfium(data, path, ocr, dpi)


def _with_pdfium(data: bytes, path: str, ocr: bool, dpi: int) -> Iterator[dict]:
    import tempfile

    import pypdfium2

    from .lines import merge
    from .ocr import recognise
    from .plain import plain_text

    try:
        document = pypdfium2.PdfDocument(data)
    except pypdfium2.PdfiumError as e:
        raise ExtractError("malformed", str(e), path) from e
    for k in range(len(document)):
        try:
            page = document[k]
            width, height = page.get_size()
            text = page.get_textpage()
            boxes = [text.get_rect(n) for n in range(text.count_rects())]
            blocks = merge([(text.get_text_bounded(*box), *box) for box in boxes])
            found = {"number": k + 1, "width": width, "height": height, "origin": "native", "confidence": None, "blocks": blocks}
            if not blocks and ocr:
                with tempfile.NamedTemporaryFile(suffix=".png") as f:
                    page.render(scale=dpi / 72).to_pil().save(f.name)
                    said, confidence = recognise(f.name)
                said = plain_text(said)
                found |= {"origin": "ocr", "confidence": confidence, "blocks": [{"block": 0, "kind": "other", "text": said}] if said else []}
        except pypdfium2.PdfiumError as e:
            raise ExtractError("page", str(e), path, k + 1) from e
        yield found
