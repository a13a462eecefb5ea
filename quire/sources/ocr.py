"""Text recognition by an external tesseract program; without one, an honest error and never an empty page."""

from __future__ import annotations

import os
import shutil
import subprocess

from .errors import ExtractError

VARIABLE = "QUIRE_TESSERACT"
_PLACES = ("/usr/bin/tesseract", "/usr/local/bin/tesseract", "/opt/homebrew/bin/tesseract", "C:\\Program Files\\Tesseract-OCR\\tesseract.exe")


def find_program() -> str:
    """The program named by QUIRE_TESSERACT, else on PATH, else in a usual place."""
    tried = []
    named = os.environ.get(VARIABLE)
    if named:
        tried.append(f"{VARIABLE}={named}")
        if os.path.isfile(named):
            return named
    found = shutil.which("tesseract")
    if found:
        return found
    tried.append("PATH")
    for place in _PLACES:
        tried.append(place)
        if os.path.isfile(place):
            return place
    raise ExtractError("ocr_unavailable", "tesseract was not found; tried " + ", ".join(tried))


def mean_confidence(tsv: str) -> float:
    """Mean confidence of the recognised words in a tab-separated report, in [0, 1]; 0 without words."""
    scores = []
    for row in tsv.split("\n")[1:]:
        cells = row.split("\t")
        if len(cells) > 11 and cells[11].strip():
            try:
                score = float(cells[10])
            except ValueError:
                continue
            if score >= 0:
                scores.append(score)
    return min(1.0, max(0.0, sum(scores) / len(scores) / 100)) if scores else 0.0


def recognise(image_path: str) -> tuple[str, float]:
    """(text, mean confidence) of an image file."""
    program = find_program()

    def run(*more: str) -> str:
        done = subprocess.run([program, image_path, "stdout", *more], capture_output=True, check=False)
        if done.returncode:
            raise ExtractError("backend", f"tesseract failed: {done.stderr.decode(errors='replace').strip()[:300]}", image_path)
        return done.stdout.decode(errors="replace")

    return run(), mean_confidence(run("tsv"))
