"""What to do with each path of a listing: decisions on columns, and the snapshot comparison that feeds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Decisions before and after a file is read.
UNCHANGED, SKIP, HASH, PARSE, LINK, TOUCH = "unchanged", "skip_failed", "hash", "parse", "link", "touch"


def decide_cheap(known: Column, indexed: Column, same_stat: Column, retry_failed: Column) -> Column:
    """Without reading: known path of equal size and time is unchanged, or skipped if it failed and is not retried."""
    settled = known & same_stat
    return F.when(settled & indexed, UNCHANGED).when(settled & ~retry_failed, SKIP).otherwise(HASH)


def decide_after_hash(own: Column, owner: Column) -> Column:
    """own: the hash that the path has in the index; owner: the hash of the bytes if some file in the index has it; both may be null."""
    return F.when(owner.isNull(), PARSE).when(own.isNotNull() & (own == owner), TOUCH).otherwise(LINK)


def actions(listing: DataFrame, paths: DataFrame, files: DataFrame, retry_failed: bool = False, rebuild: bool = False) -> DataFrame:
    """One row a path of the listing (rel_path, byte_size, mtime_ns, content_hash) or of the index.

    Adds known, file_status, action, leader. action `gone` marks indexed paths that the listing lacks. content_hash of the
    listing may be null where decide_cheap settles the path. Of several paths to parse with equal bytes, the first in
    walk order is the leader; the others are linked to what it gives.
    """
    now = listing.select("rel_path", F.col("byte_size").alias("size"), F.col("mtime_ns").alias("mtime"), F.col("content_hash").alias("hash"))
    then = paths.select("rel_path", F.col("byte_size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    stored = files.select("content_hash", "status")
    both = now.withColumn("listed", F.lit(True)).join(then.withColumn("known", F.lit(True)), "rel_path", "full_outer")
    both = both.join(stored.select(F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status")), "old_hash", "left")
    both = both.join(stored.select(F.col("content_hash").alias("owner"), F.col("status").alias("owner_status")), F.col("hash") == F.col("owner"), "left")
    known, listed = F.coalesce("known", F.lit(False)), F.coalesce("listed", F.lit(False))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    cheap = F.lit(HASH) if rebuild else decide_cheap(known, F.col("old_status") == "indexed", F.coalesce(same, F.lit(False)), F.lit(retry_failed))
    after = F.lit(PARSE) if rebuild else decide_after_hash(F.col("old_hash"), F.col("owner"))
    retried = F.lit(retry_failed) & (F.col("owner_status") == "failed")
    action = F.when(~listed, "gone").when(cheap != HASH, cheap).when(F.coalesce(retried, F.lit(False)), PARSE).otherwise(after)
    out = both.withColumns({"known": known, "action": action})
    first = F.row_number().over(W.partitionBy("hash", "action").orderBy(F.split("rel_path", "/"))) == 1
    return out.select(
        "rel_path", "size", "mtime", "hash", "old_hash", "known", "old_status", "owner_status", "action", F.when(F.col("action") == PARSE, first).otherwise(F.lit(False)).alias("leader")
    )


def status_of(done: DataFrame, walk_complete: bool = True) -> DataFrame:
    """(rel_path, category) of actions(): unchanged, modified, new, deleted or failed.

    A path that is overwritten with bytes the index holds is listed as new; an action that lands on a failed file is listed
    as failed. Deletions are told only after a complete walk.
    """
    lands = F.when(F.col("action").isin(UNCHANGED, SKIP), F.col("old_status")).when(F.col("action").isin(LINK, TOUCH), F.col("owner_status"))
    category = (
        F.when(F.col("action") == "gone", "deleted")
        .when(lands == "failed", "failed")
        .when(F.col("action").isin(UNCHANGED, TOUCH), "unchanged")
        .when((F.col("action") == PARSE) & F.col("known"), "modified")
        .otherwise("new")
    )
    out = done.select("rel_path", category.alias("category"))
    return out if walk_complete else out.where("category <> 'deleted'")


def report(done: DataFrame) -> DataFrame:
    """One row with the counters of an indexing run, parsing itself not counted as failed or not."""
    count = lambda a: F.count_if(F.col("action") == a)
    failed_link = (F.col("action") == LINK) & (F.col("owner_status") == "failed")
    follower = (F.col("action") == PARSE) & ~F.col("leader")
    return done.agg(
        F.count_if("leader").alias("parsed"),
        F.count_if(((F.col("action") == LINK) & ~F.coalesce(failed_link, F.lit(False))) | follower).alias("linked"),
        count(TOUCH).alias("touched"), count(UNCHANGED).alias("unchanged"),
        (count(SKIP) + F.count_if(failed_link)).alias("skipped_failed"), count("gone").alias("paths_pruned"),
    )


def prune(files: DataFrame, paths: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, paths) that stay: paths among those seen, and files that some path still names."""
    kept = paths.join(seen.select("rel_path"), "rel_path", "left_semi")
    return files.join(kept.select("content_hash"), "content_hash", "left_semi"), kept
