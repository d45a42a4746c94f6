"""Scalar functions on spellings and texts whose results are known."""

import base64

import pytest
from pyspark.sql import functions as F

from tesselake.functions import scalars
from tesselake.operators import jobs, lookups
from tesselake.plans import decide

OSTS = [
    ("14", 14), ("0x0014", 20), ("fs0-OST0014_UUID", 20), ("fs0-OST0014", 20), ("other-OST0014", -2), ("keine-zahl", -1), ("-3", -1), ("OST0014", 20), ("0014", -1), ("010", -1), ("0", 0), (" 14", -1),
    ("65536", -1), ("0xffff", 65535), ("+14", 14), ("+0014", 14), ("OST0x14", 20), ("0x0x14", 20), ("-0", 0), ("14_UUID", 14), ("", -1), (None, -1), ("OST", -1), ("0x", -1), ("99999999999999999999", -1), ("14\n", -1), ("\t1", -1), ("\n1", 1),
]


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expr).collect()]


def test_parse_ost(spark):
    assert values(spark, [x for x, _ in OSTS], scalars.parse_ost(F.col("x"), "fs0")) == [y for _, y in OSTS]


@pytest.mark.parametrize("data", [b"", b"f", b"fo", b"foobar", b"\xff\xfe\x00z", bytes(200)])
def test_base64(spark, data):
    assert values(spark, [bytearray(data)], scalars.base64_text(F.col("x")), "x binary") == [base64.b64encode(data).decode()]


def test_json_escape_takes_bytes(spark):
    data = [bytearray(b'a"\\\n\x7f\xff'), bytearray("é".encode())]
    assert values(spark, data, scalars.json_escaped(F.col("x")), "x binary") == ['a\\"\\\\\\u000a\\u007f\\u00ff', "\\u00c3\\u00a9"]


def test_paths(spark):
    cases = [("/fs0/a/b", "ok"), ("a/b", "ok"), ("/fs0/../x", "rejected component"), ("/fs0-evil/a", "outside root"), ("/fs0/a/", "directory"), ("/fs0/a//b", "rejected component"), ("/fs0", "root itself"), ("/fs0/" + "n" * 256, "rejected component"), ("/fs0/" + "é" * 128, "rejected component"), ("/fs0/a//", "rejected component")]
    assert values(spark, [x for x, _ in cases], scalars.path_verdict(F.col("x"), "/fs0")) == [y for _, y in cases]
    assert values(spark, ["/etc/x", "/"], scalars.path_verdict(F.col("x"), "/")) == ["ok", "root itself"]


def test_placement_spreads(spark):
    got = values(spark, list(range(64)), scalars.pick_osts(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("x"), F.lit(1), 2), "x long")
    assert {tuple(x) for x in got} == {(1, 2), (2, 3), (3, 1)}


def test_errors(spark):
    assert values(spark, [0, 11, 22, None], scalars.exit_code(F.col("x")), "x int") == [0, 3, 1, 0]
    assert values(spark, [-5, 3], scalars.errno_of(F.col("x")), "x int") == [5, 5]


def test_goals(spark):
    goal, errno = decide.read_goal(F.col("x"))
    rows = ["3", "", "x", "17", "0", None, "16"]
    assert values(spark, rows, goal) == [3, 0, 0, 0, 0, 0, 16]
    assert values(spark, rows, errno) == [0, 22, 22, 22, 22, 0, 0]
    # An owner's record is never a privileged run's goal, and the trusted one isn't read without privileges.
    goal, errno = decide.read_goal(F.lit(None).cast("string"), F.col("x"), F.lit(True))
    assert values(spark, ["3", "", None], goal) == [0, 0, 0] and values(spark, ["3", "", None], errno) == [22, 22, 0]
    goal, errno = decide.read_goal(F.lit("5"), F.col("x"), F.lit(False))
    assert values(spark, ["3", None, "0" * 31 + "4"], goal) == [3, 0, 0] and values(spark, ["3", None, "0" * 31 + "4"], errno) == [0, 0, 34]


def test_chunks_cover_extents(spark):
    e = spark.createDataFrame([(1, 5000, 9000)], "file_id long, data_off long, data_size long")
    got = sorted((r["pos"], r["length"]) for r in lookups.copy_chunks(e, buffer=8192).collect())
    assert got == [(4096, 8192), (12288, 4096)]


def test_retries(spark):
    o = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False)], "file_id long, attempt int, ok boolean")
    got = sorted(tuple(r) for r in decide.retries(o, 2).collect())
    assert got == [(1, True, 1, 0, 0), (2, False, 2, 1, 11)]


def test_manifest(spark, tmp_path):
    (tmp_path / "whole").write_bytes(b"/a\xff\0/b\0")
    (tmp_path / "cut").write_bytes(b"/a\0/b")
    rows, complete = jobs.read_manifest(spark, str(tmp_path / "whole"))
    assert sorted(bytes(r[0]) for r in rows.collect()) == [b"/a\xff", b"/b"] and complete.first()[0] is True
    assert jobs.read_manifest(spark, str(tmp_path / "cut"))[1].first()[0] is False


def test_pool_names(spark):
    assert values(spark, ["fs0.gold", "gold", "", "x" * 16], scalars.normal_pool(F.col("x"), "fs0")) == ["gold", "gold", None, None]


def test_log_stream(spark, tmp_path):
    from tesselake.streaming import joblog

    (tmp_path / "a.json").write_text('{"ts":"2026-01-01T00:00:10Z","rc":0,"mirrors_added":2,"mirrors_deleted":1}\n{"ts":"2026-01-01T00:01:00Z","rc":3,"mirrors_added":0,"mirrors_deleted":0}\n')
    q = joblog.window_counts(joblog.read_log(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("job_log").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.sql("select * from job_log").collect()] == [(1, 1, 2, 1)]


def test_remaining_records_can_be_replayed(spark, tmp_path):
    records = spark.createDataFrame([("/a b",), ("/é",), ("/c\nd",)], "path string")
    jobs.write_manifest(records, str(tmp_path / "left"))
    rows, complete = jobs.read_manifest(spark, str(tmp_path / "left"))
    assert sorted(bytes(r[0]).decode() for r in rows.collect()) == ["/a b", "/c\nd", "/é"] and complete.first()[0] is True
    assert jobs.read_manifest(spark, str(tmp_path / "left"), most=3)[1].first()[0] is False


def test_messages_are_cut_by_bytes(spark):
    assert values(spark, ["aé" * 3], scalars.json_escaped(scalars.first_bytes(F.col("x"), 5))) == ["a\\u00c3\\u00a9a\\u00c3"]
    assert values(spark, ["plain text", 'a"b', None], scalars.json_escaped(F.col("x"))) == ["plain text", 'a\\"b', None]


def test_restore_order_in_ranges(spark):
    paths = [f"/r/d{i % 7}/f{i}" for i in range(300)]
    entries = spark.createDataFrame([(p, False) for p in paths] + [(f"/r/d{i}", True) for i in range(7)] + [("/r", True)], "path string, is_dir boolean")
    got = [r["path"] for r in jobs.restore_order(entries, ranges=5).orderBy("place").collect()]
    assert got == sorted(paths) + [f"/r/d{i}" for i in range(7)] + ["/r"]
    assert jobs.restore_order(entries.limit(0)).count() == 0


def test_restore_order_of_odd_paths(spark):
    files = ["/r/a", "/r/a", "/r/é", "/r/\uffee", "/r/\U0001f600", None, None, "", "/r/" + "d/" * 300 + "f"]
    entries = spark.createDataFrame([(p, False) for p in files] + [("/r", True), (None, True), ("/r/d", True), ("", True), ("/r/d/d", True)], "path string, is_dir boolean")
    for ranges in (1, 3, 200):
        rows = jobs.restore_order(entries, ranges=ranges).orderBy("place").collect()
        assert [r["place"] for r in rows] == list(range(1, 15))
        assert [(r["path"], r["is_dir"]) for r in rows] == [(p, False) for p in [*sorted(x for x in files if x is not None), None, None]] + [(p, True) for p in ("/r/d/d", "/r/d", "/r", "", None)]


def test_target_text_has_fixed_room(spark):
    found = values(spark, [[65535] * 40, [1, 2], []], scalars.target_text(F.col("x")), "x array<int>")
    assert found == [",".join(["65535"] * 15), "1,2", ""]
