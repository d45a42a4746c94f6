"""Sharding by fixed virtual slots, with DataFrame and SQL functions alone.

Records hash into a fixed number of slots by their text, so equal texts share a slot and by that a shard. Only a
text whose copies weigh more than 1 / PIECES of a shard, which the law of equal bytes can't leave together, is
dealt by its ids to as many slots as that takes (at most PIECES x shards texts can be so heavy, whatever the data,
so they are broadcast). Bytes are added up slot by slot (a partial sum before the shuffle); a versioned slot-to-shard
map says where each slot goes. A run reads the last version, keeps it while its shards are even, and else edits it:
slots that need not move stay, and the result is stored as the next version. The map has as many rows as there are
slots, whatever the data, so it is folded in one row and broadcast.

Defined cases: a null or empty text has no bytes and counts as 1, and null is a text of its own; null ids hash like a
value; many rows with the same id and text are dealt to several slots like other heavy texts; repeated
rows each get a place of their own; ties between shards go to the smaller number, between slots to the smaller one;
an empty table gives an empty result; a text may be of any length; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselake.llm.common import Shelf

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096


#: A text is dealt to several slots if its copies weigh more than this share of a shard's bytes.
PIECES = 16


def with_size(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, a hash of the text, a number for the row; the text itself goes no further."""
    text = F.encode(F.col("text"), "UTF-8")
    size, crc = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce(text, F.lit(b"")))
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text", F.col("text").isNull()).alias("same"), F.monotonically_increasing_id().alias("row"))


def with_slot(sized: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Adds vslot. ``sized`` is a stored table: rows that are all alike are told apart by the numbers that it gave them."""
    total = sized.agg(F.sum("size").alias("total"))
    heavy = lambda keys, name: sized.groupBy(*keys).agg(F.sum("size").alias("bytes")).join(F.broadcast(total)).where(F.col("bytes") * shards * PIECES > F.col("total")).select(*keys, F.ceil(F.col("bytes") * shards * PIECES / F.col("total")).alias(name))
    texts, rows = heavy(["same"], "pieces"), heavy(["same", "doc_id"], "row_pieces").withColumnRenamed("doc_id", "id")
    out = sized.join(F.broadcast(texts), "same", "left").join(F.broadcast(rows.withColumnRenamed("same", "like")), (F.col("same") == F.col("like")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    one = F.coalesce(F.pmod(F.xxhash64("row"), F.col("row_pieces")), F.lit(0))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", one), F.col("pieces")), F.lit(0))
    return out.select("doc_id", "size", "text_crc32", "row", F.pmod(F.xxhash64("same", piece), F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(sized: DataFrame) -> DataFrame:
    """vslot, bytes, rows of each slot in use."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(by_slot: DataFrame, shards: int, version: int | None = 1) -> DataFrame:
    """vslot, shard, version: slots in falling order of bytes, each to the shard with the fewest bytes so far."""
    return _deal(by_slot.select("vslot", "bytes", F.lit(None).cast("int").alias("was")), shards, version)


def rebalanced(old: DataFrame, by_slot: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version of a map: a slot stays where it was unless its shard is full (or gone); the rest is dealt anew.

    A shard is full at the mean; its largest slots stay first, so few slots move and little is left over.
    """
    known = by_slot.join(F.broadcast(old.select("vslot", F.col("shard").alias("was"))), "vslot", "left")
    mean = known.agg((F.sum("bytes") / shards).alias("mean"))
    at = Window.partitionBy("was").orderBy(F.desc("bytes"), "vslot")
    stays = F.col("was").isNotNull() & (F.col("was") < shards) & (F.sum("bytes").over(at) <= F.col("mean"))
    kept = known.join(F.broadcast(mean)).withColumn("was", F.when(stays, F.col("was")))
    return _deal(kept.select("vslot", "bytes", "was"), shards, version)


def _deal(slots: DataFrame, shards: int, version: int | None) -> DataFrame:
    """Fold all slots (a fixed number) in one row: the accumulator holds each shard's bytes and the map so far."""
    slots = slots.agg(F.array_sort(F.collect_list(F.struct(F.col("was").isNull().alias("free"), (-F.col("bytes")).alias("less"), "vslot", "was"))).alias("all"))
    folded = slots.selectExpr(
        f"""aggregate(all,
            named_struct('loads', array_repeat(0L, {shards}), 'placed', cast(array() as array<struct<vslot:int,shard:int>>)),
            (acc, s) -> named_struct(
                'loads', transform(acc.loads, (l, i) -> if(i = coalesce(s.was, array_position(acc.loads, array_min(acc.loads)) - 1), l - s.less, l)),
                'placed', array_append(acc.placed, named_struct('vslot', s.vslot, 'shard', cast(coalesce(s.was, array_position(acc.loads, array_min(acc.loads)) - 1) as int)))),
            acc -> acc.placed) as placed"""
    )
    return folded.select(F.inline("placed")).withColumn("version", F.lit(version))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store one version beside the earlier ones."""
    slot_map.write.partitionBy("version").mode("append").parquet(path)


def load_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version") == version)


def last_version(spark, path: str) -> int:
    """The number of the last version stored whole; 0 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) if files.exists(place.suffix("/_SUCCESS")) else 0


def is_even(slot_map: DataFrame, by_slot: DataFrame, shards: int) -> bool:
    """Whether every slot in use has one of the shards, all of them are used, and none is ahead of another by more than the largest slot."""
    known = by_slot.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot", "left")
    loads = known.groupBy("shard").agg(F.sum("bytes").alias("load"), F.max("bytes").alias("most"))
    row = loads.agg(F.count_if(F.col("shard").isNull() | (F.col("shard") >= shards)).alias("odd"), F.count(F.lit(1)).alias("n"), (F.max("load") - F.min("load")).alias("gap"), F.max("most").alias("most")).first()
    return row["n"] == 0 or row["odd"] == 0 and row["n"] == shards and row["gap"] <= row["most"]


def current_map(by_slot: DataFrame, shards: int, store: str) -> DataFrame:
    """The stored map if it is still even; else the next version, edited from it (or the first)."""
    spark = by_slot.sparkSession
    version = last_version(spark, store)
    old = load_map(spark, store, version) if version else None
    if old is None or not is_even(old, by_slot, shards):
        new = first_map(by_slot, shards) if old is None else rebalanced(old, by_slot, shards, version + 1)
        save_map(new, store)
        version += 1
    return load_map(spark, store, version).select("vslot", "shard", "version")


def assign(sized: DataFrame, slot_map: DataFrame, by_slot: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard (gapless from 0).

    Places are numbered slot by slot: a window over the few rows of the map says where each virtual slot
    starts in its shard, and only the rows of one virtual slot are sorted together.
    """
    starts = by_slot.join(slot_map, "vslot").withColumn("first", F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("vslot", "shard", F.coalesce("first", F.lit(0)).alias("first"))
    at = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "row")
    numbered = sized.withColumn("place", F.row_number().over(at) - 1)
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("first") + F.col("place")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), vslot, version of the map (null if it isn't stored).

    ``store``: the folder that holds the versions of this data set's map. Texts are read once.
    """
    shelf = Shelf(docs.sparkSession, "sharding")
    sized = with_slot(shelf.put(with_size(docs), "sized"), shards, slots)
    by_slot = shelf.put(slot_bytes(sized), "slots")
    slot_map = current_map(by_slot, shards, store) if store else first_map(by_slot, shards, None)
    placed = assign(sized, slot_map.select("vslot", "shard"), by_slot)
    version = slot_map.agg(F.max("version").cast("int").alias("version"))
    return placed.join(F.broadcast(version)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")
