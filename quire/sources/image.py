"""Images: a header check (type and size), and one recognised page."""

from __future__ import annotations

import os
import struct
import tempfile

from .errors import ExtractError
from .ocr import recognise
from .plain import plain_text


def image_size(data: bytes, path: str = "") -> tuple[int, int]:
    """(width, height) from the header of a PNG, JPEG, BMP, TIFF or WebP file; malformed ones raise."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
        if data[:4] in (b"II*\x00", b"MM\x00*"):
            e = "<" if data[0] == 73 else ">"
            at = struct.unpack(e + "I", data[4:8])[0]
            size = {}
            for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
                tag, kind, _ = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
                raw = data[at + 10 + 12 * k : at + 14 + 12 * k]
                size[tag] = struct.unpack(e + "H", raw[:2])[0] if kind == 3 else struct.unpack(e + "I", raw)[0]
            return size[256], size[257]
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    except (struct.error, IndexError, KeyError) as e:
        raise ExtractError("malformed", f"broken image header ({e})", path) from e
    raise ExtractError("malformed", "no image of a known kind", path)


def image_page(data: bytes, path: str = "") -> dict:
    """The page of an image: size, confidence, and one block of recognised text, or none if that is blank."""
    width, height = image_size(data, path)
    with tempfile.NamedTemporaryFile(suffix=os.path.splitext(path)[1] or ".img") as f:
        f.write(data)
        f.flush()
        text, confidence = recognise(f.name)
    text = plain_text(text)
    blocks = [{"block": 0, "kind": "other", "text": text}] if text else []
    return {"width": float(width), "height": float(height), "origin": "ocr", "confidence": confidence, "blocks": blocks}
