"""Small layouts built by hand: one file each, objects on one target a component."""

import pytest
from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.operators import layout
from tesselake.plans import decide

M, EOF = 1 << 20, S.EOF
I, ST, NS, EXT = S.INIT, S.STALE, S.NOSYNC, S.EXTENSION


def analyse(spark, comps, banned=(), flr=0, declared=None, size=6):
    """comps: (mirror, flags, start, end, objects, first target)"""
    components = spark.createDataFrame([(1, k + 1, m, fl, a, b, 0, 1, "", bool(o)) for k, (m, fl, a, b, o, _) in enumerate(comps)], S.COMPONENTS)
    objects = spark.createDataFrame([(1, k + 1, m, 0, t) for k, (m, fl, a, b, o, t) in enumerate(comps) if not fl & EXT and (fl & I or o)], S.OBJECTS)
    files = spark.createDataFrame([(1, "/fs0/a", size, 1, 1, 1, flr, None, "collapse", None)], S.FILES)
    bans = spark.createDataFrame([(b,) for b in banned], "ost_index int")
    pools = spark.createDataFrame([], "pool string, ost_index int")
    header = None if declared is None else spark.createDataFrame([(1, declared)], "file_id long, declared int")
    v = layout.verdicts(files, components, objects, bans, pools, header)
    return v, layout.mirrors(layout.scan(components, files), objects, bans, pools), files


@pytest.mark.parametrize(
    "comps, mirrors, usable",
    [
        ([(0, I, 0, M, 1, 3), (0, 0, M, M, 0, 0), (0, EXT, M, EOF, 0, 0)], 1, 1),
        ([(0, I, 0, M, 1, 3), (0, EXT, M, M, 0, 0)], 1, 1),
        ([(1, I, 0, M, 1, 3), (2, I, 0, M, 1, 1)], 2, 2),
        ([(1, I, 0, M, 1, 3), (2, I | ST, 0, M, 1, 1)], 2, 1),
    ],
)
def test_accepted(spark, comps, mirrors, usable):
    row = analyse(spark, comps)[0].first()
    assert (row["error"], row["mirrors"], row["usable"]) == (0, mirrors, usable)


@pytest.mark.parametrize(
    "comps, declared, error",
    [
        ([(0, I, 0, M, 1, 3), (0, 0, M, M, 0, 0)], None, S.EINVAL),
        ([(0, I, M, 1024, 1, 3)], None, S.EINVAL),
        ([(0, I | 4096, 0, M, 1, 3)], None, S.ENOTSUP),
        ([(1, I, 0, M, 1, 3)], 3, S.EINVAL),
        ([(k, I, 0, M, 1, 3) for k in range(17)], None, S.E2BIG),
        ([(0, I, M, 5, 1, 3), (0, I | 4096, 0, M, 1, 3)], None, S.EINVAL),
    ],
)
def test_refused(spark, comps, declared, error):
    row = analyse(spark, comps, declared=declared)[0].first()
    assert row["error"] == error and row["mirrors"] is None


def test_stale_without_sync_raises_nothing(spark):
    row = analyse(spark, [(1, I, 0, M, 1, 3), (2, I | ST | NS, 0, M, 1, 4)])[0].first()
    assert (row["any_stale"], row["needs_resync"], row["usable"]) == (False, False, 1)


def test_pending_state_needs_resync(spark):
    assert analyse(spark, [(1, I, 0, M, 1, 3)], flr=S.FLR_WRITE_PENDING)[0].first()["needs_resync"]


def test_hole_and_short_coverage_are_not_usable(spark):
    assert analyse(spark, [(1, I, 0, 2, 1, 3), (1, I, 4, M, 1, 3)])[0].first()["usable"] == 0
    assert analyse(spark, [(1, I, 0, 4, 1, 3)])[0].first()["usable"] == 0
    assert analyse(spark, [(1, I, 0, 4, 1, 3)], size=0)[0].first()["usable"] == 1


def test_delete_guard(spark):
    _, m, _ = analyse(spark, [(1, I, 0, M, 1, 3), (2, I, 0, M, 1, 1)])
    ask = spark.createDataFrame([(1, 1, "SURPLUS", 1), (1, 1, "SURPLUS", 2), (1, 1, "BANNED", 1), (1, 1, "ROLLBACK", 1), (1, 9, "BANNED", 1)], "file_id long, mirror_id int, reason string, target int")
    got = sorted((r["mirror_id"], r["reason"], r["verdict"]) for r in decide.delete_guard(m, ask).collect())
    assert got == [(1, "BANNED", "no longer banned"), (1, "ROLLBACK", "allowed"), (1, "SURPLUS", "allowed"), (1, "SURPLUS", "nothing is surplus"), (9, "BANNED", "gone")]


def test_last_usable_copy_stays(spark):
    _, m, _ = analyse(spark, [(1, I, 0, M, 1, 3), (2, I | ST, 0, M, 1, 1)])
    ask = spark.createDataFrame([(1, 1, r, 1) for r in ("SURPLUS", "BANNED", "ROLLBACK")], "file_id long, mirror_id int, reason string, target int")
    assert {r["verdict"] for r in decide.delete_guard(m, ask).collect()} == {"no usable copy left"}


def test_picks(spark):
    comps = [(1, I, 0, M, 1, 0), (2, I, 0, M, 1, 3), (3, I | ST, 0, M, 1, 4), (4, I, 0, M, 1, 5)]
    v, m, files = analyse(spark, comps, banned=[0])
    assert decide.pick_banned(m).first()["mirror_id"] == 1
    assert [r["mirror_id"] for r in decide.surplus_order(m).orderBy("victim").collect()] == [3, 4]
    counts = decide.plan_counts(decide.targets(files, layout.file_states(m)))
    actions = [(r["action"], r["mirror_id"]) for r in decide.plan_actions(counts).orderBy("step").collect()]
    assert actions == [("DELETE", 1), ("DELETE", 3), ("DELETE", 4), ("RESYNC", None)]


def test_coverage_window_equals_fold(spark):
    """The window form of the hole rule against the fold, on layouts made at random."""
    import random

    rnd = random.Random(5)
    rows = []
    for f in range(300):
        for k in range(rnd.randint(1, 6)):
            a = rnd.randint(0, 6)
            rows.append((f, k + 1, 1, I, a, a + rnd.randint(0, 4), 0, 1, "", True))
    components = spark.createDataFrame(rows, S.COMPONENTS)
    files = spark.createDataFrame([(f, "", 6, 1, f, 1, 0, None, "keep", None) for f in range(300)], S.FILES)
    scanned = layout.scan(components, files)
    window = scanned.groupBy("file_id").agg(F.bool_or("gap").alias("w"))
    assert layout.coverage(scanned).join(window, "file_id").where("has_gap <> w").count() == 0


def test_components_are_shuffled_once(spark):
    """Windows, the join with banned objects and both aggregations keep to one partitioning by file."""
    import re

    components = spark.range(1000).selectExpr("id % 100 as file_id", "cast(id / 100 as int) as comp_ord", "1 as mirror_id", "16L as flags", "0L as ext_start", "9L as ext_end", "0 as pattern", "1 as stripe_count", "'' as pool", "true as has_objects")
    files = spark.range(100).selectExpr("id as file_id", "6L as file_size", "0 as flr_state")
    objects = spark.range(1000).selectExpr("id % 100 as file_id", "cast(id / 100 as int) as comp_ord", "1 as mirror_id", "0 as stripe_idx", "cast(id % 7 as int) as ost")
    one = spark.createDataFrame([(1,)], "ost_index int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.verdicts(files, components, objects, one, spark.createDataFrame([("p", 1)], "pool string, ost_index int"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert sum(k.startswith("file_id") for k in keys) == 3  # components, files and the banned objects' files, each once
    assert not any("mirror_id" in k or "comp_ord" in k for k in keys)


def test_an_empty_list_allows_everything(spark):
    objects = spark.createDataFrame([(1, 1, 1, 0, 3), (1, 1, 1, 1, 4)], S.OBJECTS)
    none, some = spark.createDataFrame([], "ost_index int"), spark.createDataFrame([(3,)], "ost_index int")
    assert layout.outside_allowed(objects, none, none).count() == 0
    assert [tuple(r) for r in layout.outside_allowed(objects, none, some).collect()] == [(1, 1, 1)]
