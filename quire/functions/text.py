"""Text functions as Column expressions: normalisation, sentences, hard splits, tokens, small parsers.

The character tables below are fixed values: other spellings would give other chunks.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, and the other control characters (Cc).
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
CONTROL = "\\x00-\\x08\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F"
#: Quotes and dashes with a one-character stand-in; the ellipsis becomes three dots.
FROM, TO = "\u201c\u201d\u201e\u2018\u2019\u201a\u2013\u2014\u2212", "\"\"\"'''---"
ELLIPSIS = "\u2026"
#: Marks a cut between sentences. Normalised text has no control characters, so it cannot occur.
CUT = "\x01"

SUPPORTED = ("docx", "pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Characters that normalisation replaces or drops: all white space but the space, controls, and the marks above.
_ODD = f"[{CONTROL}{SPACE.replace('-\\r ', '-\\r')}{FROM}{ELLIPSIS}]"


def normalize(text: str | Column) -> Column:
    """Plain quotes and dashes, no control characters, runs of white space as one space, trimmed. Null stays null.

    Most texts need no change; a search tells, and saves them the replacements.
    """
    text = _col(text)
    plain = F.replace(text, F.lit(ELLIPSIS), F.lit("..."))
    plain = F.translate(plain, FROM, TO)
    plain = F.regexp_replace(plain, f"[{CONTROL}]", "")
    plain = F.trim(F.regexp_replace(plain, f"[{SPACE}]+", " "))
    spaced = text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    return F.when(spaced | text.rlike(_ODD), plain).otherwise(text)


def sentences(normal: str | Column) -> Column:
    """Array of the sentences of a normalised text: cut behind . ! or ? and closing marks, if a space or the end follows."""
    marked = F.regexp_replace(_col(normal), "([.!?][.!?\"')\\]]*)(?= |\\z)", "$1" + CUT)
    return F.filter(F.transform(F.split(marked, CUT), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def hard_split(text: str | Column, most: int) -> Column:
    """Array of consecutive pieces of `most` code points (at least one each); the last may be shorter."""
    text, size = _col(text), max(most, 1)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))
    return F.transform(starts, lambda k: F.substring(text, k * size + 1, F.lit(size)))


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_col(path), "\\.([^./]+)$", 1))


def is_supported(path: str | Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def path_order(path: str | Column) -> Column:
    """Sorts paths component by component, as a depth-first walk by name meets them."""
    return F.split(_col(path), "/")


def heading_level(style: str | Column) -> Column:
    """1 to 9 for styles named Heading or heading and a number, else null."""
    number = F.trim(F.regexp_extract(_col(style), "^[Hh]eading(.*)$", 1))
    level = number.try_cast("int")
    return F.when(level.between(1, 9), level)


def ocr_confidence(tsv: str | Column) -> Column:
    """Mean confidence in [0, 1] of the recognised words of a tab-separated OCR report (header row first); 0 without any."""
    rows = F.slice(F.split(_col(tsv), "\n"), 2, 1 << 30)
    cells = F.transform(rows, lambda r: F.split(r, "\t"))
    words = F.filter(cells, lambda c: (F.size(c) > 11) & F.get(c, F.lit(11)).rlike(f"[^{SPACE}]"))
    scores = F.filter(F.transform(words, lambda c: F.get(c, F.lit(10)).try_cast("float")), lambda x: x >= 0)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(scores)
    return F.when(F.size(scores) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean / 100))).otherwise(F.lit(0.0)).cast("float")


def _accent_table() -> tuple[str, str]:
    """Single letters below U+2000 whose decomposition is one base letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x2000):
        split = unicodedata.normalize("NFD", chr(code))
        if len(split) > 1 and all(unicodedata.combining(c) for c in split[1:]):
            pairs.append((chr(code), split[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS, BASES = _accent_table()


def tokens(text: str | Column) -> Column:
    """Array of search terms: lower case without accents, runs of letters, digits and private-use characters."""
    bare = F.regexp_replace(F.translate(_col(text), ACCENTS, BASES), "\\p{M}+", "")
    return F.regexp_extract_all(F.lower(bare), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))
