"""Text runs of one page to lines, in Python, for extractors. The DataFrame form is operators.runs.merge_runs; tests hold them together."""

from __future__ import annotations

import re

import numpy as np

from ..operators.runs import SAME_LINE, WORD_GAP
from .plain import _SPACE, plain_text

_f = np.float32
_OPENS, _CLOSES = re.compile(f"^{_SPACE.pattern}"), re.compile(f"{_SPACE.pattern}$")


def merge(runs: list[tuple[str, float, float, float, float]]) -> list[dict]:
    """(text, x0, y0, x1, y1) in reading order to line blocks."""
    lines: list[dict] = []
    last = None
    for raw, *box in runs:
        text = plain_text(raw)
        if not text:
            continue
        x0, y0, x1, y1 = map(_f, box)
        now = {"h": y1 - y0, "mid": (y0 + y1) / _f(2), "x0": x0, "x1": x1, "closes": bool(_CLOSES.search(raw)), "vertical": len(text) >= 3 and y1 - y0 > (x1 - x0) * _f(2)}
        joins = (
            last is not None and not last["vertical"] and not now["vertical"]
            and abs(last["mid"] - now["mid"]) <= max(last["h"], now["h"]) * _f(SAME_LINE) and x0 >= last["x0"]
        )
        if joins:
            wide = x0 - last["x1"] > min(last["h"], now["h"]) * _f(WORD_GAP)
            line, box_ = lines[-1], lines[-1]["bbox"]
            line["text"] += (" " if last["closes"] or _OPENS.search(raw) or wide else "") + text
            line["bbox"] = {"x0": min(box_["x0"], float(x0)), "y0": min(box_["y0"], float(y0)), "x1": max(box_["x1"], float(x1)), "y1": max(box_["y1"], float(y1))}
        else:
            lines.append({"block": len(lines), "kind": "line", "text": text, "bbox": {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}})
        last = now
    return lines
