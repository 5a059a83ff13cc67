"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record is hashed into one of thousands of slots, for good. Bytes are summed
per slot. A small table (version, slot, shard, moved) says where each slot lives;
rebalancing writes a new version that moves only the slots a too full shard has
to give up, so records are never hashed anew.

Defined results: a null text has no bytes (size 1); null ids are hashed by the
checksum of the text; rows equal in id and checksum are dealt one by one, in
``shard_table`` always, in ``shard_documents`` where together they outweigh an even
slot; an empty table gives no rows and an even map; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, stored

SLOTS = 4096
SHARDS = 8


def text_size(text: Column | str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column | str = "text") -> Column:
    return F.crc32(F.encode(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "UTF-8")).cast("long")


def slot_of(slots: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_load(df: DataFrame, slot: Column, size: Column) -> DataFrame:
    """Bytes and rows of every slot in use; partial sums meet by slot."""
    return df.select(slot.alias("vslot"), size.alias("_b")).groupBy("vslot").agg(
        F.sum("_b").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt round the shards."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"),
        (F.col("id") % shards).cast("int").alias("shard"), F.lit(False).alias("moved"))


def rebalance(current: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, for the given number of shards.

    Every shard keeps its largest slots up to an even share; the rest, smallest
    slots of the full shards and slots of shards that are gone, go one by one to
    the shard with the fewest bytes. The table has one row per slot, so its
    windows and the fold are bounded by the number of slots.
    """
    full = current.join(load, "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    marked = full.withColumn("stays", (F.sum("bytes").over(own) <= share) & (F.col("shard") < shards))
    gathered = marked.agg(
        F.max("version").alias("version"),
        F.collect_list(F.struct("vslot", "shard", "bytes", "stays")).alias("slots"))
    kept = F.filter("slots", lambda s: s["stays"])
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate(
        F.filter(kept, lambda s: s["shard"] == i), F.lit(0).cast("long"), lambda a, s: a + s["bytes"]))
    spare = F.sort_array(F.transform(
        F.filter("slots", lambda s: ~s["stays"]),
        lambda s: F.struct(s["bytes"].alias("bytes"), (-s["vslot"]).alias("low"), s["shard"].alias("shard"))), asc=False)

    def put(state, s):
        least = F.array(F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1)
        return F.transform(least, lambda j: F.struct(
            F.transform(state["loads"], lambda v, i: F.when(i == j, v + s["bytes"]).otherwise(v)).alias("loads"),
            F.concat(state["moves"], F.array(F.struct(
                (-s["low"]).alias("vslot"), j.alias("shard"), (j != s["shard"]).alias("moved")))).alias("moves")))[0]

    start = F.struct(F.col("loads"), F.array().cast("array<struct<vslot:int,shard:int,moved:boolean>>").alias("moves"))
    placed = gathered.select("version", kept.alias("kept"), spare.alias("spare"), loads.alias("loads")).select(
        "version", F.concat(
            F.transform("kept", lambda s: F.struct(s["vslot"].alias("vslot"), s["shard"].alias("shard"), F.lit(False).alias("moved"))),
            F.aggregate("spare", start, put)["moves"]).alias("slots"))
    return placed.select((F.col("version") + 1).alias("version"), F.inline("slots"))


def slot_maps(docs: DataFrame, slot: Column, size: Column, slots: int = SLOTS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The stored map with versions 0 and 1 and the stored load of the slots."""
    load = stored(slot_load(docs, slot, size), "slot-load")
    even = first_map(docs.sparkSession, slots, shards)
    return stored(even.unionByName(rebalance(even, load, shards)), "slot-map"), load


def place(df: DataFrame, slot: Column, maps: DataFrame, version: int) -> DataFrame:
    """Every row with its slot and shard by one version of the map (one row per slot: a bounded broadcast)."""
    chosen = maps.where(F.col("version") == version).select("vslot", "shard")
    return df.withColumn("vslot", slot).join(F.broadcast(chosen), "vslot")


def number(placed: DataFrame, maps: DataFrame, load: DataFrame, version: int, order: list[str]) -> DataFrame:
    """The place of each row in its shard, without gaps from 0.

    Slots of a shard lie one after another, so rows are numbered slot by slot
    and no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = maps.where(F.col("version") == version).join(load, "vslot").select(
        "vslot", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("vslot").orderBy(*order)
    return placed.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_start") + F.row_number().over(own) - 1).drop("_start")


def heavy_keys(rows: DataFrame, slots: int) -> DataFrame:
    """Hashes of (doc_id, checksum) whose equal rows hold more bytes than an even slot: fewer than ``slots`` of them."""
    per = rows.groupBy("doc_id", "_crc").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    per = stored(per, "shard-equal")
    share = per.agg(F.sum("_bytes")).select((F.col("sum(_bytes)") / slots).alias("_share"))
    return stored(per.where("_n > 1").join(F.broadcast(share), F.col("_bytes") > F.col("_share")).select(
        F.xxhash64("doc_id", "_crc").alias("_key")).distinct(), "shard-heavy")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Documents with ``shard`` and ``vslot``; the texts are not shuffled.

    Rows of a heavy group of equal rows are told apart by their place in the table.
    """
    clean = docs.drop("vslot", "shard")  # columns of these names are replaced
    place_ = F.monotonically_increasing_id()
    rows = stored(clean.select("doc_id", text_crc().alias("_crc"), text_size().alias("_size"), place_.alias("_place")), "shard-rows")
    heavy = heavy_keys(rows, slots).withColumn("_own", F.lit(True))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64("doc_id", "_crc")).join(F.broadcast(heavy), "_key", "left").drop("_key")

    slot = F.when(F.col("_own"), slot_of(slots, F.col("doc_id"), F.col("_crc"), F.col("_place"))).otherwise(
        slot_of(slots, F.col("doc_id"), F.col("_crc")))
    maps, _ = slot_maps(dealt(rows), slot, F.col("_size"), slots, shards)
    marked = clean.withColumns({"_crc": text_crc(), "_place": place_})
    return place(dealt(marked), slot, maps, 1).select(*clean.columns, "shard", "vslot")


def shard_table(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per document: sizes near equal over the shards (law ``bytes``)."""
    key = docs.select("doc_id", text_size().alias("size"), text_crc().alias("text_crc32"))
    counted = stored(key.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "shard-equal")
    rows = stored(numbered(counted).drop("n"), "shard-rows")
    slot = F.when(F.col("ordinal") == 0, slot_of(slots, F.col("doc_id"), F.col("text_crc32"))).otherwise(
        slot_of(slots, F.col("doc_id"), F.col("text_crc32"), F.col("ordinal")))
    maps, load = slot_maps(rows, slot, F.col("size"), slots, shards)
    out = number(place(rows, slot, maps, 1), maps, load, 1, ["doc_id", "text_crc32", "size", "ordinal"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot")
