"""An incremental, content-addressed index of a directory, kept as immutable Parquet snapshots.

index/manifest.json names the current snapshot and holds the settings; a run writes a new snapshot folder and then
replaces the manifest in one step, so a reader sees the old state or the new one. A lock file keeps a second writer
out. Files are keyed by the hash of their bytes, paths by their name; equal bytes are parsed once.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import emit
from ..functions.text import basename, path_order
from ..model import CHUNKS, EXTRACTION_VERSION, FILES, PATHS, SCHEMA_VERSION, IndexConfig
from ..sources.dispatch import extract
from ..sources.errors import ExtractError
from ..sources.listing import listing
from ..storage import materialize
from . import detect
from .chunk import chunk

_TABLES = {"files": FILES, "paths": PATHS, "chunks": CHUNKS}


@dataclass
class IndexReport:
    parsed: int = 0
    linked: int = 0
    touched: int = 0
    unchanged: int = 0
    failed: int = 0
    skipped_failed: int = 0
    paths_pruned: int = 0
    files_pruned: int = 0
    modified_during_run: int = 0
    walk_errors: int = 0
    reason: str | None = None


@dataclass
class StatusReport:
    unchanged: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)
    new: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)
    walk_errors: int = 0
    stale: str | None = None


def _now() -> str:
    return str(int(time.time()))


class Index:
    """Index.open(...) to write, Index.open_existing(...) to read."""

    def __init__(self, spark: SparkSession, root: str, folder: str, manifest: dict) -> None:
        self.spark, self.root, self.folder, self.manifest = spark, os.path.abspath(root), folder, manifest

    # --- opening -------------------------------------------------------------------------------------------------

    @staticmethod
    def _folder(root: str, index_dir: str | None) -> str:
        return os.path.abspath(index_dir or os.path.join(root, ".quire"))

    @staticmethod
    def _validated(folder: str, root: str) -> dict:
        try:
            with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
                found = json.load(f)
            version = int(found["schema_version"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise ExtractError("index", f"the index in {folder} is not readable ({e}); rebuild it with reindex") from e
        if version != SCHEMA_VERSION:
            kind = "newer" if version > SCHEMA_VERSION else "older"
            raise ExtractError("index", f"the index in {folder} has the {kind} schema version {version}, this is {SCHEMA_VERSION}")
        if found.get("root_path") != os.path.abspath(root):
            raise ExtractError("index", f"the index in {folder} belongs to {found.get('root_path')}, not {os.path.abspath(root)}")
        return found

    @classmethod
    def open(cls, spark: SparkSession, root: str, index_dir: str | None = None, rebuild: bool = False) -> Index:
        """Create or open for writing. rebuild: an unreadable index is replaced instead of refused."""
        folder = cls._folder(root, index_dir)
        manifest = None
        if os.path.exists(os.path.join(folder, "manifest.json")):
            try:
                manifest = cls._validated(folder, root)
            except ExtractError:
                if not rebuild:
                    raise
        if manifest is None:
            try:
                os.makedirs(folder, exist_ok=True)
                index = cls(spark, root, folder, {"schema_version": SCHEMA_VERSION, "root_path": os.path.abspath(root), "created_at": _now(), "snapshot": None})
                index._commit(index.manifest)
            except OSError as e:
                raise ExtractError("index", f"{folder} is not writable ({e.strerror})") from e
            return index
        if not os.access(folder, os.W_OK):
            raise ExtractError("index", f"{folder} is not writable")
        return cls(spark, root, folder, manifest)

    @classmethod
    def open_existing(cls, spark: SparkSession, root: str, index_dir: str | None = None) -> Index:
        """Open for reading; nothing is created."""
        folder = cls._folder(root, index_dir)
        if not os.path.exists(os.path.join(folder, "manifest.json")):
            raise ExtractError("index", f"there is no index in {folder}")
        return cls(spark, root, folder, cls._validated(folder, root))

    # --- tables --------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        at = self.manifest.get("snapshot")
        if not at:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(os.path.join(self.folder, at, name))

    def _commit(self, manifest: dict) -> None:
        temporary = os.path.join(self.folder, f"manifest.{uuid.uuid4().hex}")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, os.path.join(self.folder, "manifest.json"))
        self.manifest = manifest

    def _store(self, tables: dict[str, DataFrame], settings: dict) -> None:
        """Write a snapshot, check its keys, and make it the current one; a failure leaves the old one in place."""
        name = f"snapshot-{uuid.uuid4().hex}"
        path = os.path.join(self.folder, name)
        try:
            for table, df in tables.items():
                kinds = [f.split(" ", 1) for f in _TABLES[table].replace("page:int,block:int", "page:int;block:int").split(", ")]
                df.select(*(F.col(n).cast(k.replace(";", ",")).alias(n) for n, k in kinds)).write.parquet(os.path.join(path, table))
            for table, keys in (("files", ["content_hash"]), ("paths", ["rel_path"]), ("chunks", ["content_hash", "ordinal"])):
                stored = self.spark.read.schema(_TABLES[table]).parquet(os.path.join(path, table))
                twice = stored.groupBy(*keys).count().where("count > 1").first()
                if twice:
                    raise ExtractError("index", f"{table} would hold {twice.asDict()} twice")
        except BaseException:
            shutil.rmtree(path, ignore_errors=True)
            raise
        # the snapshot before stays for those who still read it, until the next commit
        before, old = self.manifest.get("snapshot"), self.manifest.get("previous")
        self._commit(self.manifest | settings | {"snapshot": name, "previous": before, "updated_at": _now()})
        if old and old != before:
            shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)

    # --- staleness -----------------------------------------------------------------------------------------------

    def staleness(self, cfg: IndexConfig) -> str | None:
        """Why stored chunks may differ from what cfg gives; None if they do not. Extraction is asked first."""
        m = self.manifest
        if not m.get("config_fingerprint"):
            rows = m.get("snapshot") and not self.table("paths").isEmpty()
            return "an earlier run did not finish" if rows else None
        stored = int(m.get("extraction_version", 0))
        if stored != EXTRACTION_VERSION:
            return f"extraction version changed: {stored} -> {EXTRACTION_VERSION}"
        if m["config_fingerprint"] != cfg.fingerprint():
            return f"settings changed: {m.get('config_describe')} -> {cfg.describe()}"
        return None

    # --- the run -------------------------------------------------------------------------------------------------

    def _listed(self, known: DataFrame, retry_failed: bool, hash_all: bool) -> tuple[DataFrame, int, int]:
        """The listing with hashes where they are needed, the unreadable entries, and the files that did not hash."""
        walked = listing(self.spark, self.root).where(~F.col("rel_path").startswith(os.path.relpath(self.folder, self.root) + "/"))
        walked = walked.persist()
        errors = walked.where("error is not null").count()
        good = walked.where("error is null").drop("error")
        paths, files = self.table("paths"), self.table("files")
        now = good.join(paths.select("rel_path", F.col("byte_size").alias("s"), F.col("mtime_ns").alias("m"), "content_hash"), "rel_path", "left")
        now = now.join(files.select("content_hash", "status"), "content_hash", "left")
        same = F.coalesce((F.col("byte_size") == F.col("s")) & (F.col("mtime_ns") == F.col("m")), F.lit(False))
        cheap = detect.decide_cheap(F.col("s").isNotNull(), F.coalesce(F.col("status") == "indexed", F.lit(False)), same, F.lit(retry_failed))
        to_read = good if hash_all else now.where(cheap == detect.HASH).select("rel_path", "byte_size", "mtime_ns")
        hashed = hash_files(to_read, self.root)
        left = good.join(hashed.select("rel_path", F.col("hash").alias("content_hash"), "read_size", "problem"), "rel_path", "left")
        return left, errors, 0

    def index_dir(self, cfg: IndexConfig = IndexConfig(), retry_failed: bool = False, reindex: bool = False, hook=None) -> IndexReport:
        """Bring the index up to date with the directory. hook() runs between parsing and storing (for tests)."""
        lock = os.path.join(self.folder, "lock")
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError as e:
            raise ExtractError("index", f"another run is writing to {self.folder} (remove {lock} if not)") from e
        try:
            return self._run(cfg, retry_failed, reindex, hook)
        finally:
            os.unlink(lock)

    def _run(self, cfg: IndexConfig, retry_failed: bool, reindex: bool, hook) -> IndexReport:
        reason = "reindex was asked for" if reindex else self.staleness(cfg)
        rebuild = reason is not None
        report = IndexReport(reason=reason)
        listed, report.walk_errors, _ = self._listed(self.table("paths"), retry_failed, rebuild)
        listed = listed.persist()
        report.failed += listed.where("problem is not null").count()
        report.modified_during_run += listed.where("problem is null and read_size <> byte_size").count()
        settled = listed.where("problem is null and (read_size is null or read_size = byte_size)")
        done = detect.actions(settled, self.table("paths"), self.table("files"), retry_failed, rebuild).persist()
        leaders = done.where("leader").select(F.col("hash").alias("doc"), F.concat(F.lit(self.root + "/"), "rel_path").alias("path"), basename("rel_path").alias("source"), "rel_path", "size", "mtime")
        n = self.spark.sparkContext.defaultParallelism * 4
        # written, not cached: files that are read again after a lost executor might have changed since
        found = materialize(extract(leaders.select("doc", "path", "source").repartition(n, "doc"), cfg.ocr, cfg.ocr_dpi), "extracted")
        if hook:
            hook()
        # what changed while it was read is not stored, neither is what links to it
        moved = done.where("leader").join(_stat_again(leaders, self.root), "rel_path").where("changed").select(F.col("hash").alias("bad")).persist()
        report.modified_during_run += done.where(F.col("action") == detect.PARSE).join(moved, F.col("hash") == F.col("bad"), "left_semi").count()
        done = done.join(moved, F.col("hash") == F.col("bad"), "left").where(~((F.col("action") == detect.PARSE) & F.col("bad").isNotNull())).drop("bad").persist()
        complete = report.walk_errors == 0
        self._next(cfg, report, done, found, listed, complete)
        return report

    def _next(self, cfg: IndexConfig, report: IndexReport, done: DataFrame, found: DataFrame, listed: DataFrame, complete: bool) -> None:
        now = F.lit(_now())
        old_files, old_paths, old_chunks = (self.table(t) for t in ("files", "paths", "chunks"))
        parsed = done.where("leader").select(F.col("hash").alias("content_hash"), F.col("size").alias("byte_size"))
        problems = found.where("error_kind is not null").groupBy(F.col("doc").alias("content_hash")).agg(F.min("detail").alias("error"))
        blocks = found.where("error_kind is null").join(problems.select(F.col("content_hash").alias("doc")), "doc", "left_anti")
        pages = blocks.groupBy(F.col("doc").alias("content_hash")).agg(F.max("page").alias("page_count"))
        new_chunks = chunk(blocks, cfg.chunk).select(F.col("doc").alias("content_hash"), F.col("id").alias("ordinal"), "page_start", "page_end", "origin", "confidence", "hard_split", "blocks", "text").persist()
        counts = new_chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("chunk_count"))
        new_files = parsed.join(problems, "content_hash", "left").join(pages, "content_hash", "left").join(counts, "content_hash", "left")
        new_files = new_files.select("content_hash", "byte_size", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("status"), "error", now.alias("indexed_at")).persist()
        new_keys = parsed.select("content_hash")
        files = old_files.join(new_keys, "content_hash", "left_anti").unionByName(new_files)
        chunks = old_chunks.join(new_keys, "content_hash", "left_anti").unionByName(new_chunks)
        present = done.where("action <> 'gone'")
        own = F.when(F.col("action").isin(detect.UNCHANGED, detect.SKIP), F.col("old_hash")).otherwise(F.col("hash"))
        seen = present.select("rel_path", own.alias("content_hash"), F.col("mtime").alias("mtime_ns"), F.col("size").alias("byte_size"), now.alias("seen_at"))
        unsettled = listed.select("rel_path").join(present.select("rel_path"), "rel_path", "left_anti")
        keep = old_paths.join(seen.select("rel_path"), "rel_path", "left_anti")
        if complete:
            keep = keep.join(unsettled, "rel_path", "left_semi")
        paths = seen.unionByName(keep).persist()
        kept_files = files.join(paths.select("content_hash"), "content_hash", "left_semi")
        kept_chunks = chunks.join(paths.select("content_hash"), "content_hash", "left_semi")
        counters = done.join(new_files.select(F.col("content_hash").alias("nh"), F.col("status").alias("new_status")), F.col("hash") == F.col("nh"), "left")
        row = detect.report(counters).first()
        broken = counters.where((F.col("action") == detect.PARSE) & (F.col("new_status") == "failed"))
        failed = broken.agg(F.count_if("leader").alias("lead"), F.count_if(~F.col("leader")).alias("follow")).first()
        report.parsed, report.touched, report.unchanged = row.parsed - failed.lead, row.touched, row.unchanged
        report.linked, report.skipped_failed = row.linked - failed.follow, row.skipped_failed
        report.failed += failed.lead + failed.follow
        report.paths_pruned = row.paths_pruned - (0 if complete else row.paths_pruned)
        if complete:
            report.paths_pruned = old_paths.join(paths.select("rel_path"), "rel_path", "left_anti").count()
        report.files_pruned = old_files.join(paths.select("content_hash"), "content_hash", "left_anti").count() if complete else 0
        settings = {}
        hash_failures = listed.where("problem is not null").count()
        if complete and not report.modified_during_run and not hash_failures:
            settings = {"config_fingerprint": cfg.fingerprint(), "config_describe": cfg.describe(), "extraction_version": EXTRACTION_VERSION}
        self._store({"files": kept_files, "paths": paths, "chunks": kept_chunks}, settings)

    # --- reading -------------------------------------------------------------------------------------------------

    def status(self, cfg: IndexConfig = IndexConfig()) -> StatusReport:
        """What a run would find. Reads and hashes, parses and writes nothing."""
        listed, errors, _ = self._listed(self.table("paths"), False, False)
        done = detect.actions(listed.where("problem is null"), self.table("paths"), self.table("files"))
        told = detect.status_of(done, errors == 0).join(done.select("rel_path", "old_hash", "hash"), "rel_path")
        reasons = self.table("files").select(F.col("content_hash").alias("h"), "error")
        told = told.join(reasons, F.coalesce("hash", "old_hash") == F.col("h"), "left").orderBy(path_order("rel_path"))
        report = StatusReport(walk_errors=errors, stale=self.staleness(cfg))
        for row in told.toLocalIterator():
            if row.category == "failed":
                report.failed.append((row.rel_path, row.error or ""))
            else:
                getattr(report, row.category).append(row.rel_path)
        for row in listed.where("problem is not null").select("rel_path", "problem").toLocalIterator():
            report.failed.append((row.rel_path, row.problem))
        report.deleted.sort(key=os.fsencode)  # stored paths in flat order, files on disk in that of the walk
        return report

    def export_rows(self) -> DataFrame:
        """rel_path and the fields of a chunk; a content with several paths comes once for each, under its own name."""
        known = F.when(F.col("origin").isin("native", "synthesized", "ocr"), F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("unknown origin "), F.coalesce("origin", F.lit("null")))))
        rows = self.table("paths").select("rel_path", "content_hash").join(self.table("chunks"), "content_hash")
        return rows.select("rel_path", F.col("ordinal").cast("long").alias("id"), basename("rel_path").alias("source"), "page_start", "page_end", "blocks", "text", known.alias("origin"), "confidence", "hard_split")

    def export(self) -> Iterator[str]:
        """JSON lines by path components, then place in the document."""
        yield from emit.ordered_lines(self.export_rows(), emit.chunk_json(), path_order("rel_path"), "id")


def hash_files(files: DataFrame, root: str) -> DataFrame:
    """rel_path, hash, read_size, problem of each file under root, read in blocks."""
    import hashlib

    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for rel in frame.rel_path:
                digest, size = hashlib.sha256(), 0
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        while part := f.read(1 << 16):
                            digest.update(part)
                            size += len(part)
                    out.append((rel, digest.hexdigest(), size, None))
                except OSError as e:
                    out.append((rel, None, None, e.strerror or str(e)))
            yield pd.DataFrame(out, columns=["rel_path", "hash", "read_size", "problem"]).astype({"read_size": "Int64"})

    n = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("rel_path").repartition(n, "rel_path").mapInPandas(run, "rel_path string, hash string, read_size long, problem string")


def _stat_again(leaders: DataFrame, root: str) -> DataFrame:
    """rel_path, changed: whether a parsed file no longer has the size and time that the walk saw."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for f in frame.itertuples():
                try:
                    now = os.stat(os.path.join(root, f.rel_path))
                    out.append((f.rel_path, (now.st_size, now.st_mtime_ns) != (f.size, f.mtime)))
                except OSError:
                    out.append((f.rel_path, True))
            yield pd.DataFrame(out, columns=["rel_path", "changed"])

    return leaders.select("rel_path", "size", "mtime").mapInPandas(run, "rel_path string, changed boolean")
