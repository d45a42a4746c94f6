"""Whole-job analytics: manifests, accounting, hard links, tree comparison, restore order, exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_manifest(spark, path: str, most: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(records, completeness) of NUL-terminated byte paths: a file without a final NUL, or with a record that is too long, is incomplete."""
    rows = spark.read.option("lineSep", "\0").text(path).select(F.col("value").cast("binary").alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    # a last record that is cut looks like one that ends, so lengths are compared: with a NUL behind each record they add up to the file's
    ends = rows.groupBy("file").agg((F.sum(F.octet_length("path") + 1) == F.max("size")).alias("ends"))
    complete = ends.agg(F.coalesce(F.bool_and("ends"), F.lit(True)).alias("ends")).join(rows.agg(F.coalesce(F.max(F.octet_length("path")) <= most, F.lit(True)).alias("short")))
    return rows.where(F.octet_length("path") <= most).select("path"), complete.select((F.col("ends") & F.col("short")).alias("input_complete"))


def write_manifest(records: DataFrame, path: str) -> None:
    """Byte paths, each ended by a NUL, as ``read_manifest`` reads them: the records that are left can be replayed."""
    records.select(F.col("path").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def remaining(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records of the manifest that have no outcome, to be replayed."""
    return manifest.join(outcomes.select("path").distinct(), "path", "left_anti")


def accounting(outcomes: DataFrame) -> DataFrame:
    """One row: inputs = finished + failed + unstarted, and whether that holds."""
    a = outcomes.agg(F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("outcome") == "object").alias("finished"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "unstarted").alias("unstarted"))
    return a.withColumn("balanced", F.col("inputs") == F.col("finished") + F.col("failed") + F.col("unstarted"))


def exit_codes(outcomes: DataFrame, input_complete: bool = True) -> DataFrame:
    """One row, exit_code: 0 if all finished, 1 if some failed or weren't started, 2 if the input or the accounting isn't whole."""
    a = accounting(outcomes)
    return a.select(F.when(~F.col("balanced") | ~F.lit(input_complete), 2).when((F.col("failed") > 0) | (F.col("unstarted") > 0), 1).otherwise(0).alias("exit_code"))


def protection(layers: DataFrame) -> DataFrame:
    """One row, protection: enforced where every layer holds, partial where some do, else not_enforced."""
    return layers.agg(F.when(F.bool_and("holds"), "enforced").when(F.bool_or("holds"), "partial").otherwise("not_enforced").alias("protection"))


def hardlink_groups(files: DataFrame) -> DataFrame:
    """st_dev, st_ino, names, links, complete: files with several links; a group short of names fails as a whole."""
    g = files.where("st_nlink > 1").groupBy("st_dev", "st_ino").agg(F.count(F.lit(1)).cast("int").alias("names"), F.max("st_nlink").alias("links"))
    return g.withColumn("complete", F.col("names") >= F.col("links"))


def manifest_links(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, st_dev, st_ino, listed, links, complete of each record with several links: whether the manifest lists all names of its inode."""
    named = manifest.select("path").distinct().join(files.where("st_nlink > 1").select("path", "st_dev", "st_ino", "st_nlink"), "path")
    listed = named.groupBy("st_dev", "st_ino").agg(F.count(F.lit(1)).cast("int").alias("listed"), F.max("st_nlink").alias("links"))
    return named.drop("st_nlink").join(listed, ["st_dev", "st_ino"]).withColumn("complete", F.col("listed") >= F.col("links"))


def tree_diff(source: DataFrame, target: DataFrame, attributes: list[str]) -> DataFrame:
    """path, difference (missing, extra, or the attributes that differ; nulls are equal), and failed: a missing path is a failure."""
    s, t = source.select("path", F.struct(*attributes).alias("s")), target.select("path", F.struct(*attributes).alias("t"))
    j = s.join(t, "path", "full")
    parts = [F.when(~F.col(f"s.{a}").eqNullSafe(F.col(f"t.{a}")), F.lit(a)) for a in attributes]
    differs = F.concat_ws(",", *parts)
    return j.select("path", F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").otherwise(differs).alias("difference"), F.col("t").isNull().alias("failed")).where("difference <> ''")


def restore_order(entries: DataFrame, ranges: int = 200) -> DataFrame:
    """path, is_dir, place: files first, then directories from the deepest up, the root of the tree last; null paths end their kind.

    Entries are sorted in ranges of paths within a level, so no task sorts a whole level. The ranges are cut by a
    sample of about 20 paths for each; a window over the few ranges says at which place each starts.
    The range is found by bisection in plain columns: with a lambda over the path, Spark 4.1 can carry the range's
    definition through the join to the side that has no path (for some ids of the columns) and then fails.
    """
    depth = F.size(F.split("path", "/")) - 1
    sample = entries.where("path is not null").select("path").orderBy(F.rand(1)).limit(20 * ranges)
    paths = sorted({r["path"] for r in sample.collect()})
    cuts = paths[:: max(1, len(paths) // ranges)]
    known = F.array(*map(F.lit, cuts)).cast("array<string>")
    e = entries.withColumn("level", F.when(F.col("is_dir"), F.coalesce(-depth, F.lit(1))).otherwise(F.lit(-(1 << 30)))).withColumn("range", F.lit(0))
    for step in (1 << k for k in reversed(range(len(cuts).bit_length()))):
        e = e.withColumn("range", F.col("range") + F.when(F.get(known, F.col("range") + (step - 1)) <= F.col("path"), step).otherwise(0))
    e = e.withColumn("range", F.when(F.col("path").isNull(), len(cuts) + 1).otherwise(F.col("range")))
    sizes = e.groupBy("level", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("level", "range", F.coalesce(F.sum("n").over(Window.orderBy("level", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("level", "range").orderBy(F.asc_nulls_last("path")))
    # no broadcast hint: the window has both sides' keys in place, and a broadcast would have to wait for a pass over all entries
    return e.withColumn("nth", at).join(starts, ["level", "range"]).select("path", "is_dir", (F.col("before") + F.col("nth")).cast("long").alias("place"))


def rollback_candidates(journal: DataFrame, files: DataFrame) -> DataFrame:
    """Journal entries (path, dev, ino) whose directory is the same one and is still locked (mode 0700, own uid)."""
    j = journal.join(files.select("path", "st_dev", "st_ino", "mode", "uid"), "path")
    return j.where((F.col("dev") == F.col("st_dev")) & (F.col("ino") == F.col("st_ino")) & (F.col("mode").bitwiseAND(F.lit(0o777)) == 0o700) & (F.col("uid") == F.col("own_uid"))).select("path", "dev", "ino")


def last_status(lines: DataFrame) -> DataFrame:
    """task, line: the last status line of each task."""
    return lines.groupBy("task").agg(F.max_by("line", "position").alias("line"))
