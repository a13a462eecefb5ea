"""Failures of extraction. In tables they are rows (error_kind, path, page, detail), so one bad file fails no job."""

from __future__ import annotations


class ExtractError(Exception):
    """kind is one of io, unsupported, malformed, page, backend, ocr_unavailable, index."""

    def __init__(self, kind: str, detail: str, path: str | None = None, page: int | None = None) -> None:
        self.kind, self.detail, self.path, self.page = kind, detail, path, page
        where = f"{path}: " if path else ""
        on = f"page {page}: " if page is not None else ""
        super().__init__(f"{where}{on}{detail}")

    def __reduce__(self):
        return ExtractError, (self.kind, self.detail, self.path, self.page)
