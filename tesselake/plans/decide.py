"""Decisions about a file: what to aim at, whether it is done, which mirror goes, and a projected plan.

A projection assumes that actions succeed and new mirrors are sound; its columns say so by their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.functions import scalars
from tesselake.operators import lookups


def read_goal(trusted: Column, user: Column | None = None, privileged: Column | None = None) -> tuple[Column, Column]:
    """(goal, errno) of the goal recorded on a file, from the text of either attribute (null: absent).

    A privileged run reads the trusted one alone; others read only the one that a file's owner can change. Absent is 0;
    empty, no number or out of 1 to 16 is EINVAL, and so is an owner's record without a trusted one in a privileged run.
    A value longer than the buffer it is read into can't be read (ERANGE).
    """
    user = F.lit(None).cast("string") if user is None else user
    privileged = F.lit(True) if privileged is None else privileged
    text = F.when(privileged, trusted).otherwise(user)
    long = F.octet_length(text) > S.GOAL_BYTES
    value = F.when(~long, scalars.option_integer(text, 1, S.MAX_MIRRORS))
    errno = F.when(text.isNull(), F.when(privileged & user.isNotNull(), S.EINVAL).otherwise(0)).when(long, S.ERANGE).when(value.isNull(), S.EINVAL).otherwise(0)
    return F.coalesce(value, F.lit(0)).cast("int"), errno.cast("int")


def targets(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds initial (recorded goal, else the mirrors found) and target: an explicit number, else 1 on collapse, else initial on keep, else 1."""
    f = files.select("file_id", "mode", "target_opt", "recorded_goal").join(verdicts, "file_id")
    initial = F.when(F.col("recorded_goal") > 0, F.col("recorded_goal")).otherwise(F.col("mirrors"))
    keep = F.when(F.col("initial") > 0, F.col("initial")).otherwise(1)
    target = F.when(F.col("target_opt") > 0, F.col("target_opt")).when(F.col("mode") == "collapse", 1).when(F.col("mode") == "keep", keep).otherwise(1)
    f = f.withColumn("initial", initial.cast("int"))
    return f.withColumn("target", F.when(F.col("error") == 0, target).cast("int"))


def is_done() -> Column:
    return (F.col("banned") == 0) & (F.col("mirrors") == F.col("target")) & ~F.col("any_stale") & ~F.col("needs_resync") & (F.col("usable") > 0)


def done(targeted: DataFrame) -> DataFrame:
    """file_id, done, clears_goal of each file that could be read."""
    good = targeted.where("error = 0").withColumn("done", is_done())
    return good.select("file_id", "target", "done", (F.col("done") & (F.coalesce("recorded_goal", F.lit(0)) > 0)).alias("clears_goal"))


def dry_run(targeted: DataFrame, usable_osts: DataFrame, needed: int = 1, any_banned: bool = True) -> DataFrame:
    """file_id, message of what a run would do. Capacity is only looked at where the file as it is needs a new mirror."""
    t = targeted.where("error = 0").join(F.broadcast(usable_osts.withColumnRenamed("usable", "usable_osts")))
    new = (F.col("usable") == 0) | (F.col("mirrors") < F.col("target"))
    short = new & ~lookups.allocation_possible(F.col("usable_osts"), needed, F.lit(any_banned))
    says = F.format_string("would migrate: %d of %d mirrors on banned OSTs, %d usable, target mirror count %d", "banned", "mirrors", "usable", "target")
    more = F.format_string("; but only %d OST%s lie outside the banned set and a new mirror needs %d", "usable_osts", scalars.plural(F.col("usable_osts")), F.lit(needed))
    message = F.when(is_done(), "already in the requested state").otherwise(F.concat(says, F.when(short, more).otherwise("")))
    return t.select("file_id", new.alias("needs_new_mirror"), message.alias("message"))


def inspected() -> Column:
    """What an inspection says of a file that could be read."""
    unfinished = F.when(F.col("recorded_goal") > 0, "; an earlier run did not finish and recorded its mirror goal on this file").otherwise("")
    says = F.format_string("inspected: %d mirrors, %d on banned OSTs, %d usable, size %d%s", "mirrors", "banned", "usable", "file_size", unfinished)
    return F.when(is_done(), "already in the requested state").otherwise(says)


def inspection(files: DataFrame, targeted: DataFrame) -> DataFrame:
    """file_id, message of an inspection."""
    t = targeted.where("error = 0").join(files.select("file_id", "file_size"), "file_id")
    return t.select("file_id", inspected().alias("message"))


def goal_actions(targeted: DataFrame) -> DataFrame:
    """file_id, step, action, value: planned changes of the recorded goal. A run that keeps mirrors writes its target before it
    changes anything, and every run that ends well leaves no goal (none being there counts as cleared)."""
    t = targeted.where("error = 0").withColumn("done", is_done())
    had = F.coalesce("recorded_goal", F.lit(0)) > 0
    writes = ~F.col("done") & (F.col("mode") == "keep")
    wanted = F.array(F.struct(writes.alias("go"), F.lit("SET").alias("action"), F.col("target").cast("string").alias("value")), F.struct((writes | had).alias("go"), F.lit("REMOVE").alias("action"), F.lit(None).cast("string").alias("value")))
    steps = t.select("file_id", F.posexplode(F.filter(wanted, lambda x: x["go"])).alias("at", "act"))
    return steps.select("file_id", (F.col("at") + 1).cast("int").alias("step"), "act.action", "act.value")


def pick_banned(mirrors: DataFrame) -> DataFrame:
    """file_id, mirror_id of the banned mirror to go first: the first in slot order."""
    return mirrors.where("banned").groupBy("file_id").agg(F.min_by("mirror_id", "slot").alias("mirror_id"))


def surplus_order(mirrors: DataFrame) -> DataFrame:
    """file_id, mirror_id, victim: safe mirrors in the order in which surplus ones go; the first usable one never does."""
    ranked = mirrors.where(~F.col("banned")).withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "usable").orderBy("slot")))
    can_go = ranked.where(~F.col("usable") | (F.col("nth") > 1))
    return can_go.withColumn("victim", F.row_number().over(Window.partitionBy("file_id").orderBy("usable", "slot")).cast("int")).select("file_id", "mirror_id", "usable", "victim")


def pick_surplus(mirrors: DataFrame) -> DataFrame:
    return surplus_order(mirrors).where("victim = 1").select("file_id", "mirror_id")


def delete_guard(mirrors: DataFrame, requested: DataFrame) -> DataFrame:
    """Whether each deletion (file_id, mirror_id, reason, target) is allowed by the layout as it is now.

    In this order: the mirror must be there, another usable one must be left, and the reason must still hold.
    """
    return guarded(requested.join(with_others(mirrors).select("file_id", "mirror_id", "banned", "n", "others"), ["file_id", "mirror_id"], "left"))


def with_others(mirrors: DataFrame) -> DataFrame:
    """Adds the file's number of mirrors, and how many usable ones it has besides this one."""
    file = Window.partitionBy("file_id")
    return mirrors.withColumn("n", F.count(F.lit(1)).over(file)).withColumn("others", F.count_if(~F.col("banned") & F.col("usable")).over(file) - (~F.col("banned") & F.col("usable")).cast("int"))


def guarded(g: DataFrame) -> DataFrame:
    """The verdict on requests (reason, target) that stand beside their mirrors and ``with_others``."""
    verdict = (
        F.when(F.col("n").isNull(), "gone")
        .when(F.col("others") < 1, "no usable copy left")
        .when((F.col("reason") == "BANNED") & ~F.col("banned"), "no longer banned")
        .when((F.col("reason") == "SURPLUS") & (F.col("n") <= F.col("target")), "nothing is surplus")
        .otherwise("allowed")
    )
    return g.select("file_id", "mirror_id", "reason", scalars.delete_reason(F.col("reason")).alias("reason_text"), verdict.alias("verdict"), F.when(verdict == "allowed", 0).otherwise(S.EAGAIN).cast("int").alias("errno"))


def new_mirror(before: DataFrame | Column, after: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """The mirror that appeared between two snapshots of a file's mirrors (before: file_id, mirrors; or a column over file_id and n, the mirrors after), and whether it may stay.

    There must be just one more than before (else EBUSY and id 0). The newest has the greatest id; it is
    refused when banned, off the allowed targets, or not usable.
    """
    after = after.join(outside, ["file_id", "mirror_id"], "left") if outside is not None else after.withColumn("outside", F.lit(0))
    newest = after.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("mirror_id", "banned", "outside", "usable"), "mirror_id").alias("new"))
    j = newest.withColumn("mirrors", before) if isinstance(before, Column) else before.join(newest, "file_id")
    grown = F.col("n") == F.col("mirrors") + 1
    errno = F.when(~grown, S.EBUSY).when(F.col("new.banned") | (F.coalesce("new.outside", F.lit(0)) > 0) | ~F.col("new.usable"), S.EINVAL).otherwise(0)
    why = F.when(~grown, "layout changed").when(F.col("new.banned"), "banned").when(F.coalesce("new.outside", F.lit(0)) > 0, "outside allowed").when(~F.col("new.usable"), "not usable").otherwise("accepted")
    return j.select("file_id", F.when(grown, F.col("new.mirror_id")).otherwise(0).cast("int").alias("added_id"), errno.cast("int").alias("errno"), why.alias("verdict"))


def plan_counts(targeted: DataFrame) -> DataFrame:
    """Projected numbers of actions for each file that isn't done: resync first, add, delete banned, add, delete surplus.

    ``targeted``: targets over ``layout.file_states``; the mirrors in slot order are handed on.
    """
    t = targeted.where("error = 0").where(~is_done())
    first = (F.col("usable") == 0) & F.col("needs_resync")
    t = t.withColumn("projected_resync_first", first).withColumn("left_usable", F.when(first, F.col("after_resync")).otherwise(F.col("usable")))
    t = t.withColumn("projected_add_first", (F.col("left_usable") == 0).cast("int"))
    held = F.col("mirrors") + F.col("projected_add_first") - F.col("banned")
    return t.select(
        "file_id", "target", "projected_resync_first", "projected_add_first", F.col("banned").alias("projected_delete_banned"),
        F.greatest(F.lit(0), F.col("target") - held).cast("int").alias("projected_add"), F.greatest(F.lit(0), held - F.col("target")).cast("int").alias("projected_delete_surplus"),
        (F.col("needs_resync") & ~first).alias("projected_resync_last"), "by_slot",
    )


def plan_actions(counts: DataFrame) -> DataFrame:
    """file_id, step, action, mirror_id, reason: the projected actions in order. New mirrors have no id yet.

    A file whose banned mirrors outnumber the rounds that a run makes is cut off there, as a run would be.
    Everything is made from the one row of the file.
    """
    act = lambda action, mirror="cast(null as int)", reason="cast(null as string)": f"named_struct('action', '{action}', 'mirror_id', {mirror}, 'reason', {reason})"
    none = f"slice(array({act('ADD')}), 1, 0)"
    when = lambda test, action: f"if({test}, array({act(action)}), {none})"
    ids = lambda test: f"transform(filter(by_slot, m -> {test}), m -> cast(m.mirror_id as int))"
    gone = f"slice({ids('m.banned')}, 1, {S.MAX_ROUNDS})"
    spare = f"slice(concat({ids('not m.banned and not m.usable')}, slice({ids('not m.banned and m.usable')}, 2, {2 * S.MAX_MIRRORS})), 1, projected_delete_surplus)"
    parts = [
        when("projected_resync_first", "RESYNC"), when("projected_add_first > 0", "ADD"), f"transform({gone}, x -> {act('DELETE', 'x', chr(39) + 'banned' + chr(39))})",
        f"array_repeat({act('ADD')}, projected_add)", f"transform({spare}, x -> {act('DELETE', 'x', chr(39) + 'surplus' + chr(39))})", when("projected_resync_last", "RESYNC"),
    ]
    steps = counts.select("file_id", F.posexplode(F.expr(f"concat({', '.join(parts)})")).alias("at", "act"))
    return steps.select("file_id", (F.col("at") + 1).cast("int").alias("step"), "act.action", "act.mirror_id", "act.reason")


def retries(outcomes: DataFrame, attempts: int) -> DataFrame:
    """file_id, added, allocation_retries, rc, errno from (file_id, attempt, ok): rejected mirrors are rolled back and tried again.

    When the attempts run out the record says EAGAIN but isn't offered for a retry (rc 1).
    """
    tried = outcomes.where(F.col("attempt").between(1, attempts))
    first = tried.groupBy("file_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.count(F.lit(1)).alias("n"))
    lost = F.col("won").isNull()
    return first.select("file_id", (~lost).alias("added"), F.when(lost, F.col("n")).otherwise(F.col("won") - 1).cast("int").alias("allocation_retries"), F.when(lost, 1).otherwise(0).alias("rc"), F.when(lost, S.EAGAIN).otherwise(0).alias("errno"))
