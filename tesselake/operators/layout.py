"""Layout analysis: ordered components to mirror counters to one verdict a file.

Everything needs the rows of a file together and no more: components are shuffled by file_id once, and the
windows, the join with the banned objects and both aggregations stay in that partitioning (``tests/test_layouts.py``
counts the exchanges). Objects meet the banned set first (a broadcast where it is small), and those
on banned targets come as one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselake import schema as S


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def scan(components: DataFrame, files: DataFrame, flags: S.Flags = S.Flags()) -> DataFrame:
    """Components with the file's size and state, slot of the mirror, and each row's own error in the order of checks."""
    file = Window.partitionBy("file_id").orderBy("comp_ord")
    mirror = Window.partitionBy("file_id", "mirror_id").orderBy("comp_ord")
    c = components.join(files.select("file_id", "file_size", "flr_state"), "file_id")
    # the windows by file come first: what they need together serves those by mirror too
    c = c.withColumn("before", F.lag(F.struct("mirror_id", "flags", "ext_start", "ext_end")).over(file)).withColumn("last_of_file", F.lead("comp_ord").over(file).isNull())
    ext = bit(F.col("flags"), flags.extension)
    c = c.withColumn("extension", ext).withColumn("zero_length", (F.col("ext_end") == F.col("ext_start")) & ~ext)
    c = c.withColumn("first_of_mirror", F.row_number().over(mirror) == 1)
    c = c.withColumn("slot", F.sum(F.col("first_of_mirror").cast("int")).over(file).cast("int"))
    c = c.withColumn("slot", F.max(F.when(F.col("first_of_mirror"), F.col("slot"))).over(mirror))
    after_zero = (F.col("before.ext_end") == F.col("before.ext_start")) & ~bit(F.col("before.flags"), flags.extension)
    c = c.withColumn("unfollowed", F.coalesce(after_zero, F.lit(False)) & (~ext | (F.col("before.mirror_id") != F.col("mirror_id")))).withColumn("trailing", F.col("zero_length") & F.col("last_of_file"))
    error = (
        F.when(bit(F.col("flags"), ~flags.known & 0xFFFFFFFF), S.ENOTSUP)
        .when(F.col("ext_end") < F.col("ext_start"), S.EINVAL)
        .when(F.col("unfollowed"), S.EINVAL)
        .when(F.col("slot") > S.MAX_MIRRORS, S.E2BIG)
    )
    c = c.withColumn("error", error.cast("int"))
    covers = ~ext & (F.col("ext_end") > F.col("ext_start"))
    reached = F.max(F.when(covers, F.col("ext_end"))).over(mirror.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("covers", covers).withColumn("gap", covers & (F.col("ext_start") > F.coalesce(reached, F.lit(0))))
    mdt = F.col("pattern") == S.PATTERN_MDT
    return c.withColumn("instantiated", ~ext & (mdt | bit(F.col("flags"), flags.init) | F.col("has_objects")))


def first_errors(scanned: DataFrame) -> DataFrame:
    """file_id, error, error_ord: the error of the first bad component, else of a zero-length last one (order null)."""
    e = scanned.groupBy("file_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("comp_ord"))).alias("row_error"), F.min(F.when(F.col("error").isNotNull(), F.col("comp_ord"))).alias("error_ord"), F.bool_or("trailing").alias("trailing"))
    return e.select("file_id", F.coalesce("row_error", F.when(F.col("trailing"), S.EINVAL)).cast("int").alias("error"), "error_ord").where("error is not null")


def banned_components(objects: DataFrame, banned: DataFrame) -> DataFrame:
    """file_id, comp_ord, first_banned: components with an object on a banned target and the first such stripe."""
    on = objects.join(banned.select(F.col("ost_index").alias("ost")).distinct(), "ost", "left_semi")
    return on.groupBy("file_id", "comp_ord").agg(F.min("stripe_idx").alias("first_banned"))


def outside_allowed(objects: DataFrame, banned: DataFrame, allowed: DataFrame) -> DataFrame:
    """file_id, comp_ord, outside: stripes off the allowed targets, up to and with the first banned one."""
    first = banned_components(objects, banned)
    listed = allowed.agg((F.count(F.lit(1)) > 0).alias("listed"))  # no list given: everything is allowed
    off = objects.join(allowed.select(F.col("ost_index").alias("ost")).distinct(), "ost", "left_anti").join(F.broadcast(listed)).where("listed").drop("listed")
    seen = off.join(first, ["file_id", "comp_ord"], "left").where(F.col("first_banned").isNull() | (F.col("stripe_idx") <= F.col("first_banned")))
    return seen.groupBy("file_id", "comp_ord").agg(F.count(F.lit(1)).cast("int").alias("outside"))


def bad_pools(pool_members: DataFrame, banned: DataFrame) -> DataFrame:
    """Pools that hold a banned target."""
    return pool_members.join(banned.select("ost_index").distinct(), "ost_index", "left_semi").select("pool").distinct()


def mirrors(scanned: DataFrame, objects: DataFrame, banned: DataFrame, pool_members: DataFrame, flags: S.Flags = S.Flags()) -> DataFrame:
    """One row for each mirror: its counters, coverage, and whether it is banned or usable."""
    on = objects.join(F.broadcast(banned.select(F.col("ost_index").alias("ost")).distinct()), "ost", "left_semi")  # indexes have 16 bits
    on = on.groupBy("file_id").agg(F.collect_set("comp_ord").alias("on_banned"))
    bad = bad_pools(pool_members, banned).select("pool", F.lit(True).alias("bad_pool"))
    c = scanned.join(on, "file_id", "left").join(F.broadcast(bad), "pool", "left").withColumn("on_banned", F.array_contains("on_banned", F.col("comp_ord")))
    stale, away = bit(F.col("flags"), flags.stale), bit(F.col("flags"), flags.nosync | flags.offline)
    bare = ~F.col("extension") & ~F.col("instantiated")
    missing = bare & (F.col("ext_end") > F.col("ext_start")) & (F.col("file_size") > 0) & (F.col("ext_start") < F.col("file_size"))
    count = lambda x: F.count_if(x).cast("int")
    m = c.groupBy("file_id", "mirror_id").agg(
        F.min("slot").alias("slot"),
        F.first("file_size").alias("file_size"),
        F.first("flr_state").alias("flr_state"),
        F.count(F.lit(1)).cast("int").alias("components"),
        count(stale).alias("stale"),
        count(away).alias("unusable"),
        F.bool_or(stale & ~away).alias("any_stale"),
        count(F.col("instantiated")).alias("init"),
        count(F.coalesce("on_banned", F.lit(False)) & F.col("instantiated") & (F.col("pattern") != S.PATTERN_MDT)).alias("banned_components"),
        count(missing).alias("missing_data"),
        count(bare & F.coalesce("bad_pool", F.lit(False))).alias("pool_banned"),
        F.bool_or("gap").alias("has_gap"),
        F.coalesce(F.max(F.when(F.col("covers"), F.col("ext_end"))), F.lit(0)).alias("reach"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("comp_ord"))).alias("row_error"),
        F.min(F.when(F.col("error").isNotNull(), F.col("comp_ord"))).alias("error_ord"),
        F.bool_or("trailing").alias("trailing"),
    )
    return m.withColumn("banned", F.col("banned_components") > 0).withColumn("usable", usable())


def usable() -> Column:
    """A mirror that is a complete copy in sync, off the banned targets. ``reach`` is exact wherever there is no gap."""
    size = F.col("file_size")
    clean = (F.col("banned_components") == 0) & (F.col("stale") == 0) & (F.col("unusable") == 0) & (F.col("missing_data") == 0) & (F.col("pool_banned") == 0) & ~F.col("has_gap")
    return clean & ((size <= 0) | (F.col("reach") >= size)) & ((size <= 0) | (F.col("init") > 0))


def coverage(scanned: DataFrame) -> DataFrame:
    """Exact coverage end and gap of each mirror, folded in component order (a row after a hole doesn't extend it)."""
    rows = F.array_sort(F.collect_list(F.when(F.col("covers"), F.struct("comp_ord", "ext_start", "ext_end"))))
    fold = "aggregate(rows, named_struct('c', 0L, 'g', false), (a, x) -> named_struct('c', if(x.ext_start > a.c, a.c, greatest(a.c, x.ext_end)), 'g', a.g or x.ext_start > a.c))"
    return scanned.groupBy("file_id", "mirror_id").agg(rows.alias("rows")).selectExpr("file_id", "mirror_id", f"{fold} as f").select("file_id", "mirror_id", F.col("f.c").alias("coverage_end"), F.col("f.g").alias("has_gap"))


def usable_after_resync() -> Column:
    """Mirrors usable once the stale ones that a resync reaches are in sync (none that is NOSYNC or OFFLINE)."""
    size = F.col("file_size")
    clean = (F.col("banned_components") == 0) & (F.col("unusable") == 0) & (F.col("missing_data") == 0) & (F.col("pool_banned") == 0) & ~F.col("has_gap")
    return clean & ((size <= 0) | ((F.col("reach") >= size) & (F.col("init") > 0)))


def file_states(mirrors: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One row for each file that has components: counts, error, and its mirrors in slot order for the planner.

    ``declared``: file_id and the mirror count of the layout's header, refused where it is over 1 and differs.
    Counters of a file that couldn't be read are null.
    """
    f = mirrors.groupBy("file_id").agg(
        F.count(F.lit(1)).cast("int").alias("mirrors"),
        F.count_if("banned").cast("int").alias("banned"),
        F.count_if(~F.col("banned")).cast("int").alias("safe"),
        F.count_if(~F.col("banned") & F.col("usable")).cast("int").alias("usable"),
        F.bool_or("any_stale").alias("any_stale"),
        (F.first("flr_state").isin(S.FLR_WRITE_PENDING, S.FLR_SYNC_PENDING) | F.bool_or("any_stale")).alias("needs_resync"),
        F.count_if(usable_after_resync()).cast("int").alias("after_resync"),
        F.array_sort(F.collect_list(F.struct("slot", "mirror_id", "banned", "usable"))).alias("by_slot"),
        F.coalesce(F.min_by("row_error", "error_ord"), F.when(F.bool_or("trailing"), S.EINVAL)).cast("int").alias("error"),
    )
    if declared is not None:
        f = f.join(declared, "file_id", "left").withColumn("error", F.coalesce("error", F.when((F.col("declared") > 1) & (F.col("declared") != F.col("mirrors")), S.EINVAL))).drop("declared")
    good = F.col("error").isNull()
    return f.select("file_id", *(F.when(good, F.col(c)).alias(c) for c in (*COUNTS, "after_resync", "by_slot")), F.coalesce("error", F.lit(0)).cast("int").alias("error"))


COUNTS = ("mirrors", "banned", "safe", "usable", "any_stale", "needs_resync")


def verdicts(files: DataFrame, components: DataFrame, objects: DataFrame, banned: DataFrame, pool_members: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """file_id, mirrors, banned, safe, usable, any_stale, needs_resync, error of each file that has components."""
    return file_states(mirrors(scan(components, files), objects, banned, pool_members), declared).select("file_id", *COUNTS, "error")
