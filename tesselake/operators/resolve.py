"""What a run finds out about a path, set-wise: devices along it, the type of the file, its identity, and names of file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake import schema as S


def resolve(files: DataFrame, directories: DataFrame, root: str, root_dev: int, allow_other_devices: bool = False) -> DataFrame:
    """file_id, verdict, component, errno: the first fault along each path, from the root down.

    files: file_id, path, st_mode, st_dev. directories: path, st_dev. In this order: a directory on another device than
    the root, a file that isn't a regular one, a file on another device.
    """
    f = files.where(F.col("path").startswith(root.rstrip("/") + "/")).select("file_id", "path", "st_mode", "st_dev")
    names = F.split(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/")
    above = f.select("file_id", F.posexplode(F.slice(names, F.lit(1), F.size(names) - 1)).alias("level", "name"), names.alias("names"))
    above = above.select("file_id", "level", "name", F.concat_ws("/", F.lit(root.rstrip("/")), F.slice("names", F.lit(1), F.col("level") + 1)).alias("path"))
    other = directories.where(F.col("st_dev") != root_dev).select("path")
    crossed = above.join(other, "path", "left_semi").groupBy("file_id").agg(F.min_by("name", "level").alias("component"))
    boundary = F.lit(not allow_other_devices)
    verdict = (
        F.when(boundary & F.col("component").isNotNull(), "component on another file system")
        .when(F.col("st_mode").bitwiseAND(F.lit(S.S_IFMT)) != S.S_IFREG, "not a regular file")
        .when(boundary & (F.col("st_dev") != root_dev), "file on another file system")
        .otherwise("ok")
    )
    found = f.join(crossed, "file_id", "left").withColumn("verdict", verdict)
    return found.select("file_id", "verdict", F.when(F.col("verdict").startswith("component"), F.col("component")).alias("component"), F.when(F.col("verdict") == "ok", 0).otherwise(S.EINVAL).cast("int").alias("errno"))


def identity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """file_id, errno, message: whether the file is the one that the caller saw (expected: file_id, expected_dev, expected_ino)."""
    j = files.select("file_id", "st_dev", "st_ino").join(expected, "file_id")
    same = (F.col("st_dev") == F.col("expected_dev")) & (F.col("st_ino") == F.col("expected_ino"))
    says = F.format_string("the name now refers to a different file: caller expected dev/ino %d/%d, found %d/%d", "expected_dev", "expected_ino", "st_dev", "st_ino")
    return j.select("file_id", F.when(same, 0).otherwise(S.ESTALE).cast("int").alias("errno"), F.when(~same, says).alias("message"))


def file_system(requests: DataFrame, fsname: str) -> DataFrame:
    """request_id, verdict, pool, errno: whether the names in a request (expected_fsname, allowed, banned, pool_name) are this file system's.

    In this order: the expected name, allowed and banned targets spelled with a name, the pool's prefix, the pool's length.
    """
    foreign = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: (F.instr(x, "-OST") > 0) & (F.substring(x, F.lit(1), F.instr(x, "-OST") - 1) != fsname))
    dot = F.instr("pool_name", ".")
    pool = F.when(dot > 0, F.substring("pool_name", dot + 1, F.length("pool_name"))).otherwise(F.col("pool_name"))
    verdict = (
        F.when(F.col("expected_fsname") != fsname, "other file system")
        .when(foreign(F.col("allowed")), "allowed target of another file system")
        .when(foreign(F.col("banned")), "banned target of another file system")
        .when((dot > 0) & (F.substring("pool_name", F.lit(1), dot - 1) != fsname), "pool of another file system")
        .when(F.col("pool_name").isNotNull() & ~F.octet_length(pool).between(1, S.POOL_NAME_MAX), "invalid pool name")
        .otherwise("ok")
    )
    return requests.select("request_id", verdict.alias("verdict"), F.when(verdict == "ok", pool).alias("pool"), F.when(verdict == "ok", 0).otherwise(S.EINVAL).cast("int").alias("errno"))
