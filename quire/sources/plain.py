"""Normalisation of one string in Python, for extractors. The Column form is functions.text.normalize; tests hold them together."""

from __future__ import annotations

import re

from ..functions.text import ELLIPSIS, FROM, TO

_MARKS = str.maketrans({**dict(zip(FROM, TO, strict=True)), ELLIPSIS: "..."})
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def plain_text(text: str) -> str:
    return _SPACE.sub(" ", _CONTROL.sub("", text.translate(_MARKS))).strip(" ")
