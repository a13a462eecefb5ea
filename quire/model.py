"""Schemas of the engine's tables, and its configurations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

BBOX = "struct<x0:float,y0:float,x1:float,y1:float>"
#: One row a text block. page_seq and block_pos give the order in which a source delivers pages and blocks.
BLOCKS = f"doc string, source string, page_seq int, page int, width float, height float, block_pos int, block int, kind string, level int, row int, col int, bbox {BBOX}, text string, origin string, confidence float"
#: Positioned text runs of a page, in reading order.
SEGMENTS = "doc string, page int, seq int, text string, x0 float, y0 float, x1 float, y1 float"
LISTING = "rel_path string, byte_size long, mtime_ns long, error string"
FILES = "content_hash string, byte_size long, page_count int, chunk_count int, status string, error string, indexed_at string"
PATHS = "rel_path string, content_hash string, mtime_ns long, byte_size long, seen_at string"
CHUNKS = "content_hash string, ordinal int, page_start int, page_end int, origin string, confidence float, hard_split boolean, blocks array<struct<page:int,block:int>>, text string"

#: Changes when extraction gives other blocks for the same bytes, so that an index knows that it is stale.
EXTRACTION_VERSION = 1
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class ChunkConfig:
    target_chars: int = 800
    max_chars: int = 1200
    overlap_sentences: int = 1
    cross_page: bool = False

    @property
    def target(self) -> int:
        return min(self.target_chars, self.max_chars)


@dataclass(frozen=True)
class IndexConfig:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    ocr: bool = False
    ocr_dpi: int = 150

    def describe(self) -> str:
        c = self.chunk
        flag = lambda b: "true" if b else "false"
        return f"chunk={c.target_chars} max={c.max_chars} overlap={c.overlap_sentences} cross_page={flag(c.cross_page)} ocr={flag(self.ocr)} ocr_dpi={self.ocr_dpi}"

    def fingerprint(self) -> str:
        return hashlib.sha256(self.describe().encode()).hexdigest()
