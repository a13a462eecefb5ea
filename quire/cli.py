"""Command line: extract files to JSON lines, keep an index of a directory, tell its status, export it."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import emit
from .model import ChunkConfig, IndexConfig
from .operators.chunk import chunk
from .operators.index import Index
from .session import session
from .sources.dispatch import extract_paths
from .sources.errors import ExtractError
from .sources.listing import expand

COMMANDS = ("index", "status", "export")


def _options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--chunk", type=int, default=800)
    parser.add_argument("--max-chunk", type=int, default=1200)
    parser.add_argument("--overlap", type=int, default=1)
    parser.add_argument("--cross-page", action="store_true")
    parser.add_argument("--ocr", action="store_true")
    parser.add_argument("--ocr-dpi", type=int, default=150)


def _config(args: argparse.Namespace) -> IndexConfig:
    return IndexConfig(ChunkConfig(args.chunk, args.max_chunk, args.overlap, args.cross_page), args.ocr, args.ocr_dpi)


def parse(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quire")
    if argv and argv[0] in COMMANDS:
        sub = parser.add_subparsers(dest="command", required=True)
        for name in COMMANDS:
            one = sub.add_parser(name)
            one.add_argument("path", nargs="?", default=".")
            one.add_argument("--index-dir")
            if name != "export":
                _options(one)
            if name == "index":
                one.add_argument("--retry-failed", action="store_true")
                one.add_argument("--reindex", action="store_true")
                one.add_argument("-j", "--jobs", type=int)
            elif name == "status":
                one.add_argument("--json", action="store_true")
            else:
                one.add_argument("-o", "--output")
        return parser.parse_args(argv)
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-o", "--output")
    parser.add_argument("--emit", choices=("chunks", "blocks"), default="chunks")
    parser.add_argument("-j", "--jobs", type=int)
    _options(parser)
    args = parser.parse_args(argv)
    args.command = "stream"
    return args


def default_jobs(cores: int) -> int:
    return max(1, min(4, cores))


def stream(spark: SparkSession, args: argparse.Namespace, out, err) -> int:
    """Exit code 0 if all files gave their text, 2 if some failed, 1 if all did or there were none."""
    misplaced = [p for p in args.paths if p in COMMANDS and not os.path.exists(p)]
    if misplaced:
        print(f"hint: a command comes first, as in `quire {misplaced[0]} ...`", file=err)
    inputs = expand(args.paths)
    if not inputs:
        print("no supported files found", file=err)
        return 1
    cfg = _config(args)
    found = extract_paths(spark, inputs, cfg.ocr, cfg.ocr_dpi).persist()
    blocks = found.where("error_kind is null")
    if args.emit == "blocks":
        lines = emit.ordered_lines(blocks, emit.block_json(), "doc", "page_seq", "block_pos")
    else:
        lines = emit.ordered_lines(chunk(blocks, cfg.chunk), emit.chunk_json(), "doc", "id")
    for line in lines:
        print(line, file=out)
    failed = 0
    for row in found.where("error_kind is not null").orderBy("doc").select("detail").toLocalIterator():
        print(f"error: {row.detail}", file=err)
        failed += 1
    print(f"{len(inputs) - failed} ok, {failed} failed", file=err)
    return 0 if not failed else 1 if failed == len(inputs) else 2


def index(spark: SparkSession, args: argparse.Namespace, out, err) -> int:
    report = Index.open(spark, args.path, args.index_dir, args.reindex).index_dir(_config(args), args.retry_failed, args.reindex)
    if report.reason:
        print(f"full run: {report.reason}", file=err)
    print(", ".join(f"{v} {k.replace('_', ' ')}" for k, v in vars(report).items() if k != "reason"), file=err)
    bad = report.failed + report.walk_errors + report.modified_during_run  # an old failure that was skipped is none of this run
    good = report.parsed + report.linked + report.touched + report.unchanged
    return 0 if not bad else 2 if good else 1


def status(spark: SparkSession, args: argparse.Namespace, out, err) -> int:
    report = Index.open_existing(spark, args.path, args.index_dir).status(_config(args))
    if args.json:
        shown = {k: v for k, v in vars(report).items() if k != "failed"} | {"failed": [{"path": p, "reason": r} for p, r in report.failed]}
        print(json.dumps(shown), file=out)
    else:
        counts = {k: len(v) for k, v in vars(report).items() if isinstance(v, list)}
        print(", ".join(f"{counts[k]} {k}" for k in ("unchanged", "modified", "new", "deleted", "failed")), file=out)
        for name in ("modified", "new", "deleted"):
            for path in getattr(report, name):
                print(f"  {name}: {path}", file=out)
        for path, reason in report.failed:
            print(f"  failed: {path}: {reason}", file=out)
        if report.stale:
            print(f"stale: {report.stale}", file=out)
    return 2 if report.walk_errors else 0


def export(spark: SparkSession, args: argparse.Namespace, out, err) -> int:
    for line in Index.open_existing(spark, args.path, args.index_dir).export():
        print(line, file=out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    err = err or sys.stderr
    jobs = getattr(args, "jobs", None) or default_jobs(os.cpu_count() or 1)
    spark = spark or session(f"local[{jobs}]")
    target = getattr(args, "output", None)
    sink = open(target, "w", encoding="utf-8") if target else out or sys.stdout
    try:
        return {"stream": stream, "index": index, "status": status, "export": export}[args.command](spark, args, sink, err)
    except ExtractError as e:
        print(f"error: {e}", file=err)
        return 1
    finally:
        if target:
            sink.close()


if __name__ == "__main__":
    sys.exit(main())
