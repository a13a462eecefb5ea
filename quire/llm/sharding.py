"""Sharding by fixed virtual slots: hash records to slots, weigh the slots, keep a versioned slot-to-shard map.

A record's slot follows from its text, so that equal texts lie in one slot and so in one shard. Only a group of equal
texts with more bytes than GROUP of a shard's even share is split: its rows go to slots by doc_id too. At most
SHARDS / GROUP groups can be so large; they are found by a sum before the shuffle and kept with the map as its list of split texts. Only the map
from slots to shards is edited, when shards are added or loads drift, so that a rebalancing moves the slots it must and
no others. The map has one row a slot (SLOTS of them), whatever the number of records; its size is the bound behind
every broadcast and every single-row step here. Maps are stored by version; a stored version is never written again.

Edge cases: a null text has no bytes (its size is the 8 bytes of the record), a null doc_id counts as none,
repeated rows share a slot, an empty table gives no rows; very long texts are only hashed. Extra columns are ignored by the queries and kept by
assign(), whose own column names win over clashing ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize, table, table_path, whole_text

SLOTS = 8192
SHARDS = 24
#: Groups of equal texts with more bytes than this part of a shard's even share are split.
GROUP = 0.1


def measured(records: DataFrame) -> DataFrame:
    """Add size (UTF-8 bytes of the text plus 8), text_crc32 and text_mark, a hash of the text."""
    text = whole_text()
    return records.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text.cast("binary")), "text_mark": F.xxhash64(text)})


def split_texts(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(text_mark) of the groups of equal texts over GROUP of a shard's share, at most shards / GROUP of them; records as from measured()."""
    groups = records.groupBy("text_mark").agg(F.sum("size").alias("held"))
    total = records.agg(F.sum("size").alias("s")).first().s or 0  # one number
    return groups.where(F.col("held") > total * GROUP / shards).select("text_mark")


def with_slots(records: DataFrame, slots: int = SLOTS, split: DataFrame | None = None) -> DataFrame:
    """Add virtual_slot, size and text_crc32. split: the text_marks whose rows are spread by doc_id, bounded as split_texts() says."""
    rows = records if "text_mark" in records.columns else measured(records)
    mark = F.col("text_mark")
    key = mark
    if split is not None:
        rows = rows.join(F.broadcast(split.select(mark.alias("_split"))), mark == F.col("_split"), "left")
        key = F.when(F.col("_split").isNull(), mark).otherwise(F.xxhash64(mark, "doc_id"))
    return rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int")).drop("_split", "text_mark")


def slot_loads(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, rows, bytes) of every slot, empty ones included; summed on the map side first."""
    sums = slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def initial_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: heaviest slot first, each to the shard with the fewest bytes so far.

    One row holds the loads of all slots (a bounded number); the fold runs inside a single SQL expression.
    """
    ranked = F.expr("sort_array(collect_list(struct(bytes, virtual_slot)), false)")
    fold = f"""
        aggregate(ranked,
          named_struct('load', array_repeat(0L, {shards}), 'to', cast(array() as array<int>)),
          (a, s) -> named_struct(
            'load', transform(a.load, (x, i) -> if(i = array_position(a.load, array_min(a.load)) - 1, x + s.bytes, x)),
            'to', array_append(a.to, cast(array_position(a.load, array_min(a.load)) - 1 as int))),
          a -> a.to)"""
    one = loads.groupBy().agg(ranked.alias("ranked")).select("ranked", F.expr(fold).alias("shards"))
    pairs = one.select(F.explode(F.arrays_zip(F.col("ranked.virtual_slot").alias("virtual_slot"), F.col("shards").alias("shard"))).alias("p"))
    return pairs.select(F.col("p.virtual_slot").alias("virtual_slot"), F.col("p.shard").alias("shard"), F.lit(1).alias("version"))


def add_shard(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version with one more shard: every old shard gives slots until the new one has its even share.

    Slots move into the new shard only. Within a shard the lightest slots go, as long as their running sum stays
    within the shard's part of the new share.
    """
    new = F.max("shard").over(W.partitionBy()) + 1
    by = W.partitionBy("shard")
    run = by.orderBy("bytes", "virtual_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = slot_map.join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot")
    moved = held.select("*", new.alias("new"), F.sum("bytes").over(run).alias("run"), F.sum("bytes").over(by).alias("load"))
    goes = F.col("run") * (F.col("new") + 1) <= F.col("load")
    return moved.select("virtual_slot", F.when(goes, F.col("new")).otherwise(F.col("shard")).alias("shard"), (F.col("version") + 1).alias("version"))


def rebalance(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version after loads have drifted: shards above the mean give their lightest surplus slots to those below."""
    shards = slot_map.agg((F.max("shard") + 1).alias("n"))
    held = slot_map.join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot").crossJoin(F.broadcast(shards))
    total = F.sum("bytes").over(W.partitionBy())
    by = W.partitionBy("shard")
    run = by.orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.select("*", (total / F.col("n")).alias("mean"), F.sum("bytes").over(run).alias("run"), F.sum("bytes").over(by).alias("load"))
    spare = held.where("run > mean and bytes > 0").withColumn("at", F.sum("bytes").over(W.partitionBy().orderBy(F.desc("bytes"), "virtual_slot")) - F.col("bytes") / 2)
    room = held.where("run <= mean").groupBy("shard").agg((F.first("mean") - F.sum("bytes")).alias("free"))
    room = room.withColumn("upto", F.sum("free").over(W.partitionBy().orderBy(F.desc("free"), "shard")))
    room = room.select(F.col("shard").alias("to"), (F.col("upto") - F.col("free")).alias("from_"), "upto")
    target = spare.join(F.broadcast(room), (F.col("at") >= F.col("from_")) & (F.col("at") < F.col("upto")), "left").select("virtual_slot", "to")
    return slot_map.join(target, "virtual_slot", "left").select("virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Store this version of the map. Fails if that version is stored already: a map in use is never written again."""
    version = slot_map.agg(F.max("version").alias("v")).first().v
    slot_map.drop("version").write.mode("error").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    maps = spark.read.parquet(folder)
    at = F.lit(version) if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == at).select("virtual_slot", "shard", "version")


def assign(slotted: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Add shard and slot: the record's place within its shard, gapless from 0.

    Places come from the sums of the slots before (a window over the map's rows) and the place within the slot, so no
    task holds a shard. The map is broadcast; it has one row a slot.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    first = slot_map.join(F.broadcast(loads.select("virtual_slot", "rows")), "virtual_slot")
    first = first.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_place"))
    within = W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = slotted.drop("shard", "slot").withColumn("place", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(first), "virtual_slot").withColumn("slot", (F.col("first_place") + F.col("place")).cast("long")).drop("place", "first_place")


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: sizes of the 24 shards near equal. More columns: virtual_slot, version."""
    records = materialize(measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "measured")
    split = materialize(split_texts(records), "split")
    records = materialize(with_slots(records, split=split), "slots")
    loads = materialize(slot_loads(records), "loads")
    folder = table_path(spark, "slotmaps")
    save_map(initial_map(loads), folder)
    out = assign(records, load_map(spark, folder, 1), loads)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("virtual_slot").cast("long").alias("virtual_slot"), F.lit(1).alias("version"),
    )
