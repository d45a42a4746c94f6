"""Validation of requests, one row each, set-wise: an array of the rules that a request breaks, in the order of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.functions import scalars


def validate(requests: DataFrame) -> DataFrame:
    """request_id, broken (rule names in order), rc (2 if any, else 0).

    Columns: request_id, root, paths (array), pool_name, stripe_count, target, attempts (texts or null),
    expected_dev, expected_ino (texts or null), banned, allowed (arrays of spellings), keep, collapse, inspect,
    allow_other_devices (booleans). Options are checked first, then their combinations.
    """
    col = F.col
    indexes = lambda c: F.transform(F.coalesce(col(c), F.array()), lambda x: scalars.parse_ost(x))
    r = requests.withColumn("banned_ix", indexes("banned")).withColumn("allowed_ix", indexes("allowed"))
    bad_int = lambda c, low, high: col(c).isNotNull() & scalars.option_integer(col(c), low, high).isNull()
    number = r"^\s*[+-]?[0-9]{1,20}\z"
    bad_id = lambda c: col(c).isNotNull() & ~col(c).rlike(number)
    given = lambda c: F.coalesce(col(c), F.lit(False))
    stripes = F.coalesce(scalars.option_integer(col("stripe_count"), 1, S.MAX_STRIPES), F.lit(1))
    modes = given("keep").cast("int") + col("target").isNotNull().cast("int") + given("collapse").cast("int")
    zero = lambda c: F.coalesce(col(c).rlike(r"^\s*[+-]?0+\z"), F.lit(False))
    rules = [
        ("V1", F.coalesce(col("pool_name") == "", F.lit(False))),
        ("V2", bad_int("stripe_count", 1, S.MAX_STRIPES)),
        ("V3", (F.size("banned_ix") > S.MAX_OSTS) | (F.size("allowed_ix") > S.MAX_OSTS)),
        ("V4", F.exists(F.concat("banned_ix", "allowed_ix"), lambda x: x < 0)),
        ("V5", F.size(F.array_distinct("banned_ix")) < F.size("banned_ix")),
        ("V6", bad_int("target", 1, S.MAX_MIRRORS)),
        ("V7", bad_int("attempts", 1, S.MAX_ATTEMPTS)),
        ("V8", bad_id("expected_dev") | bad_id("expected_ino") | (col("expected_dev").isNull() != col("expected_ino").isNull()) | zero("expected_dev") | zero("expected_ino")),
        ("V9", ~F.coalesce(col("root").startswith("/"), F.lit(False))),
        ("V10", (F.size(F.coalesce("paths", F.array())) != 1) | F.coalesce(F.get(col("paths"), F.lit(0)) == "", F.lit(False))),
        ("V11", (F.size("banned_ix") == 0) & col("target").isNull() & ~given("keep") & ~given("collapse") & ~given("inspect")),
        ("V12", modes > 1),
        ("V13", F.arrays_overlap(F.filter("allowed_ix", lambda x: x >= 0), "banned_ix") | (F.size(F.array_distinct("allowed_ix")) < F.size("allowed_ix")) | ((F.size("allowed_ix") > 0) & (F.size("allowed_ix") < stripes))),
        ("V14", given("allow_other_devices") & (F.size("banned_ix") > 0)),
    ]
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    return r.select("request_id", F.array_join(broken, ",").alias("broken"), F.when(F.size(broken) > 0, 2).otherwise(0).alias("rc"))
