"""Lookups in the catalogue of targets, pools and sets of target indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.functions import scalars
from tesselake.operators.layout import bit


def unknown_osts(wanted: DataFrame, osts: DataFrame) -> DataFrame:
    """Wanted indexes that the catalogue lacks; each is an ENODEV."""
    return wanted.join(osts.select("ost_index"), "ost_index", "left_anti").withColumn("errno", F.lit(S.ENODEV))


def usable_osts(osts: DataFrame, banned: DataFrame, pool_members: DataFrame, allowed: DataFrame | None = None, pool: str | None = None) -> DataFrame:
    """One row, usable: targets that a new mirror may use; null if that can't be known.

    An allowed list answers alone; else a pool's members off the banned ones (an empty pool is unknown);
    else the catalogue less the banned ones, never below 0 (an empty catalogue is unknown).
    """
    if allowed is not None:
        return allowed.join(banned, "ost_index", "left_anti").agg(F.count(F.lit(1)).cast("int").alias("usable"))
    all_osts = osts.agg(F.count(F.lit(1)).alias("n"))
    if pool is not None:
        marked = pool_members.where(F.col("pool") == pool).join(banned.select("ost_index", F.lit(1).alias("hit")).distinct(), "ost_index", "left")
        inside = marked.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("hit").isNull()).alias("free"))
        return inside.join(all_osts).select(F.when((F.col("members") > 0) & (F.col("n") > 0), F.col("free")).cast("int").alias("usable"))
    bans = banned.agg(F.count(F.lit(1)).alias("banned"))
    return all_osts.join(bans).select(F.when(F.col("n") > 0, F.greatest(F.col("n") - F.col("banned"), F.lit(0))).cast("int").alias("usable"))


def pool_usage(osts: DataFrame, banned: DataFrame, pool_members: DataFrame) -> DataFrame:
    """pool, members, usable for every pool at once."""
    marked = pool_members.join(banned.select("ost_index", F.lit(1).alias("hit")).distinct(), "ost_index", "left")
    return marked.groupBy("pool").agg(F.count(F.lit(1)).cast("int").alias("members"), F.count_if(F.col("hit").isNull()).cast("int").alias("usable"))


def allocation_possible(usable: Column, needed: int, any_banned: Column) -> Column:
    """Nothing is checked without bans, and what is unknown is left to the allocation itself."""
    return ~any_banned | usable.isNull() | (usable >= needed)


def allocation(usage: DataFrame, needed: int, any_banned: bool = True) -> DataFrame:
    """scope, possible, errno, message: whether a new mirror of ``needed`` stripes can be placed in each scope (a pool, or null: the catalogue)."""
    possible = allocation_possible(F.col("usable"), needed, F.lit(any_banned))
    pool = F.when(F.col("pool").isNotNull(), F.concat(F.lit(" in pool "), "pool")).otherwise("")
    says = F.format_string("only %d OST%s outside the banned set%s, but a new mirror needs %d stripe%s; nothing was changed", "usable", scalars.plural(F.col("usable")), pool, F.lit(needed), F.lit("" if needed == 1 else "s"))
    return usage.select(F.coalesce("pool", F.lit("catalogue")).alias("scope"), possible.alias("possible"), F.when(possible, 0).otherwise(S.ENOSPC).cast("int").alias("errno"), F.when(~possible, says).alias("message"))


def read_pool_members(names: DataFrame) -> DataFrame:
    """pool, ost_index of (pool, member name) rows; names that can't be read are left out."""
    return names.select("pool", scalars.parse_ost(F.col("member")).alias("ost_index")).where("ost_index >= 0")


def stale_range(components: DataFrame, flags: S.Flags = S.Flags()) -> DataFrame:
    """file_id, n, range_start, range_end over the stale components that a resync would copy (NOSYNC ones are skipped)."""
    stale = components.where(bit(F.col("flags"), flags.stale) & ~bit(F.col("flags"), flags.nosync))
    return stale.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("ext_start").alias("range_start"), F.max("ext_end").alias("range_end"))


def describe(files: DataFrame, components: DataFrame, objects: DataFrame, flags: S.Flags = S.Flags()) -> DataFrame:
    """One line of text for each file: state, counts, and stripes (``stripe_size``), pool and targets of the first component."""
    first = F.min_by(F.struct("stripe_count", "stripe_size", "pool"), "comp_ord")
    c = components.groupBy("file_id").agg(F.countDistinct("mirror_id").alias("mirrors"), F.count(F.lit(1)).alias("n"), F.count_if(bit(F.col("flags"), flags.init)).alias("init"), first.alias("first"), F.min("comp_ord").alias("comp_ord"))
    o = objects.groupBy("file_id", "comp_ord").agg(scalars.target_text(F.transform(F.array_sort(F.collect_list(F.struct("stripe_idx", "ost"))), lambda x: x["ost"])).alias("osts"))
    c = c.join(files.select("file_id", "flr_state"), "file_id").join(o, ["file_id", "comp_ord"], "left")
    pool = F.when(F.col("first.pool") == "", "-").otherwise(F.col("first.pool"))
    state = F.when(F.col("flr_state") == 0, "0").otherwise(F.format_string("0x%x", "flr_state"))
    text = F.format_string("flr_state=%s mirrors=%d components=%d init=%d stripe_count=%d stripe_size=%d pool=%s osts=[%s]", state, "mirrors", "n", "init", F.col("first.stripe_count"), F.col("first.stripe_size"), pool, F.coalesce("osts", F.lit("-")))
    return c.select("file_id", text.alias("description"))


def stale_components(components: DataFrame, flags: S.Flags = S.Flags()) -> DataFrame:
    """file_id, comp_ord of the components that a resync would copy."""
    return components.where(bit(F.col("flags"), flags.stale) & ~bit(F.col("flags"), flags.nosync)).select("file_id", "comp_ord")


def copy_plan(extents: DataFrame, files: DataFrame, page: int = S.PAGE) -> DataFrame:
    """file_id, action, pos, length of each step that copies a sparse file: its data in reads of ``buffer`` bytes (a column of
    files), and where a hole is at its end a truncation to the file's size."""
    chunks = copy_chunks(extents.join(files.select("file_id", "buffer"), "file_id"), F.col("buffer"), page)
    ends = extents.where("data_size > 0").groupBy("file_id").agg(F.max(F.col("data_off") + F.col("data_size")).alias("data_end"))
    holes = files.join(ends, "file_id", "left").where((F.col("file_size") > 0) & (F.coalesce("data_end", F.lit(0)) < F.col("file_size")))
    return chunks.select("file_id", F.lit("copy").alias("action"), "pos", "length").unionByName(holes.select("file_id", F.lit("truncate").alias("action"), F.col("file_size").alias("pos"), F.lit(0).cast("long").alias("length")))


def copy_chunks(extents: DataFrame, buffer: int | Column = S.COPY_BUFFER, page: int = S.PAGE) -> DataFrame:
    """file_id, pos, length of each aligned read that copies the data extents (file_id, data_off, data_size)."""
    size = buffer if isinstance(buffer, Column) else F.lit(buffer)
    start = F.col("data_off") - F.pmod(F.col("data_off"), F.lit(page))
    end = F.col("data_off") + F.col("data_size")
    stop = end + F.pmod(-end, F.lit(page))
    e = extents.where("data_size > 0").withColumn("first", start).withColumn("stop", stop).withColumn("buffer", size.cast("long"))
    return e.select("file_id", "stop", "buffer", F.explode(F.sequence("first", F.col("stop") - 1, "buffer")).alias("pos")).select("file_id", "pos", F.least("buffer", F.col("stop") - F.col("pos")).cast("long").alias("length"))
