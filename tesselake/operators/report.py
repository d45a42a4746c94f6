"""Result records: one JSON line or one line of text for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.functions import scalars
from tesselake.plans import decide

COUNTS = ["initial_mirror_count", "mirror_count_before", "mirror_count_after", "banned_mirrors_before", "banned_mirrors_after", "target_mirror_count"]
ACTIONS = ["mirrors_added", "mirrors_deleted", "resyncs", "allocation_retries"]


def results(files: DataFrame, targeted: DataFrame) -> DataFrame:
    """What an inspection of each file finds, in the fields of the record. ``files`` may have the file's ``fid``."""
    fid = F.col("fid") if "fid" in files.columns else F.lit(None).cast("string")
    r = files.select("file_id", "path", "file_size", fid.alias("fid")).join(targeted.drop("mode", "target_opt"), "file_id")
    good = F.col("error") == 0
    message = F.when(~good, F.concat(F.lit("cannot read the layout: error "), F.col("error").cast("string"))).otherwise(decide.inspected())
    none = F.lit(0)
    return r.select(
        "file_id", "path", "fid", F.when(good, "ok").otherwise("error").alias("status"), scalars.exit_code(F.col("error")).alias("rc"), F.col("error").alias("errno"),
        F.when(~good, "analyse").alias("stage"), F.lit(False).alias("changed"), F.lit(False).alias("pending_layout"),
        F.when(good, F.col("initial")).alias("initial_mirror_count"), F.col("mirrors").alias("mirror_count_before"), F.col("mirrors").alias("mirror_count_after"),
        F.col("banned").alias("banned_mirrors_before"), F.col("banned").alias("banned_mirrors_after"), F.col("target").alias("target_mirror_count"),
        *(none.alias(c) for c in ACTIONS), message.alias("message"),
    )


def record_json(root: str) -> Column:
    """The record as one ASCII line with its fields in a fixed order; unknown counts are null, fid only if known, stage and errno only after an error."""
    text = lambda c: F.concat(F.lit('"'), scalars.json_escaped(c), F.lit('"'))
    flag = lambda c: F.when(c, "true").otherwise("false")
    number = lambda c: F.coalesce(scalars.known_count(F.col(c)).cast("string"), F.lit("null"))
    fields = [
        ("schema", F.lit(str(S.RESULT_SCHEMA))), ("status", text(F.col("status"))), ("rc", F.col("rc").cast("string")), ("retryable", flag(scalars.is_transient(F.col("errno")))),
        ("program", F.lit(f'"{S.PROGRAM}"')), ("program_version", F.lit(f'"{S.PROGRAM_VERSION}"')),
        ("path_b64", F.concat(F.lit('"'), scalars.base64_text(F.col("path")), F.lit('"'))), ("root_b64", F.concat(F.lit('"'), scalars.base64_text(F.lit(root)), F.lit('"'))),
        ("fid", text(F.col("fid"))), ("changed", flag(F.col("changed"))), ("pending_layout", flag(F.col("pending_layout"))), *((c, number(c)) for c in COUNTS), *((c, F.col(c).cast("string")) for c in ACTIONS),
        ("message", text(scalars.first_bytes(F.col("message"), S.MESSAGE_BYTES))),
    ]
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields))
    failed = F.concat(F.lit(',"stage":'), text(F.col("stage")), F.lit(',"errno":'), F.col("errno").cast("string"))
    return F.concat(F.lit("{"), body, F.when(F.col("rc") != 0, failed).otherwise(""), F.lit("}"))


def record_text() -> Column:
    """The readable line: counts and message after success, stage and message after an error."""
    count = lambda c: F.coalesce(F.col(c), F.lit(-1))
    ok = F.format_string("%s: %s: %s (mirrors %d -> %d, banned %d -> %d, added %d, deleted %d, resyncs %d)%s%s", F.lit(S.PROGRAM), "path", "status", count("mirror_count_before"), count("mirror_count_after"), count("banned_mirrors_before"), count("banned_mirrors_after"), "mirrors_added", "mirrors_deleted", "resyncs", F.when(F.col("message") != "", ": ").otherwise(""), "message")
    return F.when(F.col("rc") == 0, ok).otherwise(F.format_string("%s: %s: %s: %s", F.lit(S.PROGRAM), "path", "stage", "message"))


def write_records(results: DataFrame, root: str, path: str) -> None:
    """The job's log: one record a line."""
    results.select(record_json(root).alias("value")).write.text(path)


def projected(files: DataFrame, counts: DataFrame) -> DataFrame:
    """file_id, path, the counters that a run's record would have if all planned actions succeed, and its message."""
    r = files.select("file_id", "path").join(counts, "file_id")
    added, deleted = F.col("projected_add_first") + F.col("projected_add"), F.col("projected_delete_banned") + F.col("projected_delete_surplus")
    resyncs = F.col("projected_resync_first").cast("int") + F.col("projected_resync_last").cast("int")
    says = F.format_string("migrated: %d mirror%s, none on a banned OST; added %d, deleted %d, resynced %d%s", "target", scalars.plural(F.col("target")), added, deleted, resyncs, F.lit(""))
    return r.select("file_id", "path", added.cast("int").alias("mirrors_added"), deleted.cast("int").alias("mirrors_deleted"), resyncs.alias("resyncs"), (added + deleted + resyncs > 0).alias("changed"), F.col("target").alias("mirror_count_after"), says.alias("message"))


def unfinished(results: DataFrame) -> DataFrame:
    """path_b64 and layout_changed of the files that a run touched but didn't finish."""
    return results.where("rc <> 0").select("file_id", scalars.base64_text(F.col("path")).alias("path_b64"), F.col("changed").alias("layout_changed"))
