"""Every operator as a query over the fixture views; ``tesselake.oracles`` has the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselake import schema as S
from tesselake.functions import scalars
from tesselake.operators import jobs, layout, lookups, report, resolve
from tesselake.plans import decide, validate
from tesselake.sources.fixtures import view

ROOT, FSNAME = "/fs0", "fs0"


class Tables:
    """The views of a folder, and what is derived from them, made when first asked for."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        found = view(self.spark, self.sf_dir, f"v_{name}")
        setattr(self, name, found)
        return found

    def scanned(self):
        return layout.scan(self.components, self.files)

    def mirrors(self):
        return layout.mirrors(self.scanned(), self.objects, self.banned, self.pool_members)

    def verdicts(self):
        return layout.verdicts(self.files, self.components, self.objects, self.banned, self.pool_members)

    def targets(self):
        return decide.targets(self.files, self.verdicts())

    def states(self):
        return decide.targets(self.files, layout.file_states(self.mirrors()))

    def usable_osts(self):
        return lookups.usable_osts(self.osts, self.banned, self.pool_members)


def components_scan(t):
    c = t.components.join(t.files.select("file_id", "file_size"), "file_id")
    bits = {"init": S.INIT, "stale": S.STALE, "offline": S.OFFLINE, "nosync": S.NOSYNC, "extension": S.EXTENSION}
    return c.select("file_id", "comp_ord", "mirror_id", "file_size", "ext_start", "ext_end", "pool", *(layout.bit(F.col("flags"), b).alias(n) for n, b in bits.items()))


def objects_scan(t):
    return t.objects.select("file_id", "comp_ord", "stripe_idx", "ost", scalars.ost_name(FSNAME, F.col("ost")).alias("ost_uuid"))


def pool_scan(t):
    return lookups.read_pool_members(t.pool_members.select("pool", scalars.ost_name(FSNAME, F.col("ost_index")).alias("member")))


def parse_ost(t):
    return t.ost_text.select("sp", scalars.parse_ost(F.col("sp"), FSNAME).alias("parsed"), "expected")


def ost_name(t):
    return t.osts.select("ost_index", scalars.ost_name(FSNAME, F.col("ost_index")).alias("name"), (scalars.ost_name(FSNAME, F.col("ost_index")) == F.col("ost_uuid")).alias("same"))


def path_lexical(t):
    return t.paths.select("file_id", scalars.path_verdict(F.col("raw_path"), ROOT).alias("verdict"), scalars.relative_path(F.col("raw_path"), ROOT).alias("relative"))


def placement(t):
    allowed = t.allowed.agg(F.array_sort(F.collect_list("ost_index")).alias("allowed"))
    chosen = scalars.pick_osts(F.col("allowed"), F.col("st_ino"), F.lit(1), 2)
    return t.files.join(F.broadcast(allowed)).select("file_id", F.array_join(F.transform(chosen, lambda x: x.cast("string")), ",").alias("chosen"))


def error_class(t):
    rc = (F.pmod(F.col("file_id"), F.lit(131)) - 120).cast("int")
    e = t.files.select("file_id", rc.alias("rc")).withColumn("errno", scalars.errno_of(F.col("rc")))
    return e.select("file_id", "errno", scalars.is_transient(F.col("errno")).alias("transient"), scalars.exit_code(F.col("errno")).alias("exit_code"))


def mirror_state(t):
    return t.mirrors().select("file_id", "mirror_id", "slot", "components", "stale", "unusable", "any_stale", "init", "banned_components", "missing_data", "pool_banned", "has_gap", "banned", "usable")


def coverage(t):
    return layout.coverage(t.scanned())


def zero_length_rule(t):
    return t.scanned().where("unfollowed or trailing").select("file_id", "comp_ord", "mirror_id", "unfollowed", F.col("trailing").alias("at_the_end"))


def scan_errors(t):
    return layout.first_errors(t.scanned())


def mirror_slots(t):
    return t.scanned().where("first_of_mirror").select("file_id", "mirror_id", "slot")


def layout_verdict(t):
    return t.verdicts()


def banned_objects(t):
    return layout.banned_components(t.objects, t.banned)


def outside_allowed(t):
    return layout.outside_allowed(t.objects, t.banned, t.allowed)


def bad_pools(t):
    bad = layout.bad_pools(t.pool_members, t.banned)
    return t.components.join(bad, "pool", "left_semi").groupBy("pool").agg(F.count(F.lit(1)).alias("components"))


def unknown_osts(t):
    shifted = t.banned.select((F.col("ost_index") * 3).alias("ost_index"))
    return lookups.unknown_osts(shifted, t.osts)


def usable_osts(t):
    everything = t.usable_osts().select(F.lit("catalogue").alias("scope"), "usable")
    allowed = lookups.usable_osts(t.osts, t.banned, t.pool_members, allowed=t.allowed).select(F.lit("allowed").alias("scope"), "usable")
    absent = lookups.usable_osts(t.osts, t.banned, t.pool_members, pool="nopool").select(F.lit("absent pool").alias("scope"), "usable")
    return everything.unionByName(allowed).unionByName(absent).unionByName(lookups.pool_usage(t.osts, t.banned, t.pool_members).select(F.col("pool").alias("scope"), "usable"))


def stale_range(t):
    return lookups.stale_range(t.components)


def stale_components(t):
    return lookups.stale_components(t.components)


def layout_description(t):
    return lookups.describe(t.files, t.components.withColumn("stripe_size", (F.col("file_id") % 5 + 1) * 65536), t.objects)


def target_text(t):
    osts = F.transform(F.sequence(F.lit(1), (F.col("file_id") % 40 + 1).cast("int")), lambda i: (F.col("file_id") * i * 37) % 65536)
    return t.files.select("file_id", scalars.target_text(osts).alias("osts"))


def allocation(t):
    usage = lookups.pool_usage(t.osts, t.banned, t.pool_members).select("pool", "usable").unionByName(t.usable_osts().select(F.lit(None).cast("string").alias("pool"), "usable"))
    return lookups.allocation(usage, needed=31)


def copy_plan(t):
    files = t.files.select("file_id", "file_size", scalars.copy_buffer((F.col("file_id") % 7 + 1) * 2048).alias("buffer"))
    half = F.floor(F.col("file_size") / 2).cast("long")
    extents = files.where("file_size > 0").select("file_id", F.when(F.col("file_id") % 2 == 0, 0).otherwise(half).cast("long").alias("data_off"), (F.col("file_size") - half).alias("data_size"))
    return lookups.copy_plan(extents, files)


def fid_of(t):
    """A file identifier for most files."""
    k = F.col("file_id")
    return t.files.withColumn("fid", F.when(k % 13 != 0, scalars.file_id_text(k % 7 + 8589935616, k, F.lit(0))))


def copy_chunks(t):
    extents = t.files.where("file_size > 0").select("file_id", F.pmod(F.col("file_id") * 1237, F.lit(100_000)).alias("data_off"), F.col("file_size").alias("data_size"))
    return lookups.copy_chunks(extents, buffer=1 << 20)


def target_count(t):
    return t.targets().where("error = 0").select("file_id", "initial", "target")


def goal_read(t):
    k, n = F.col("file_id") % 7, F.col("file_id") % 20
    trusted = F.when(k == 0, "").when(k == 1, "x").when(k == 2, F.concat(F.repeat(F.lit("0"), 30), n.cast("string"))).when(k < 5, n.cast("string"))
    user = F.when(F.col("file_id") % 11 < 3, (F.col("file_id") % 18).cast("string")).when(F.col("file_id") % 11 == 3, "")
    f = t.files.select("file_id", trusted.alias("trusted_goal"), user.alias("user_goal"), (F.col("file_id") % 3 > 0).alias("privileged"))
    goal, errno = decide.read_goal(F.col("trusted_goal"), F.col("user_goal"), F.col("privileged"))
    return f.select("file_id", "privileged", goal.alias("goal"), errno.alias("errno"))


def done(t):
    return decide.done(t.targets())


def dry_run(t):
    return decide.dry_run(t.targets(), t.usable_osts(), needed=2)


def inspection(t):
    return decide.inspection(t.files, t.targets())


def pick_banned(t):
    return decide.pick_banned(t.mirrors())


def pick_surplus(t):
    return decide.pick_surplus(t.mirrors())


def delete_guard(t):
    reason = F.when(F.col("mirror_id") % 3 == 0, "BANNED").when(F.col("mirror_id") % 3 == 1, "SURPLUS").otherwise("ROLLBACK")
    asked = decide.with_others(t.mirrors()).withColumn("reason", reason)
    return decide.guarded(asked.join(t.files.select("file_id", F.coalesce("target_opt", F.lit(1)).alias("target")), "file_id"))


def new_mirror(t):
    m = t.mirrors()
    before = F.col("n") - F.when(F.col("file_id") % 5 == 0, 0).otherwise(1)
    outside = layout.outside_allowed(t.objects, t.banned, t.allowed).join(t.components.select("file_id", "comp_ord", "mirror_id"), ["file_id", "comp_ord"]).groupBy("file_id", "mirror_id").agg(F.sum("outside").alias("outside"))
    return decide.new_mirror(before, m, outside)


def new_mirror_unrestricted(t):
    """With an empty list of allowed targets everything is allowed."""
    m = t.mirrors()
    outside = layout.outside_allowed(t.objects, t.banned, t.allowed.where("false")).join(t.components.select("file_id", "comp_ord", "mirror_id"), ["file_id", "comp_ord"]).groupBy("file_id", "mirror_id").agg(F.sum("outside").alias("outside"))
    return decide.new_mirror(F.col("n") - F.when(F.col("file_id") % 5 == 0, 0).otherwise(1), m, outside)


def allowed_sets(t):
    """Components and stripes off the allowed targets, for a list and for none."""
    count = lambda allowed, name: layout.outside_allowed(t.objects, t.banned, allowed).agg(F.lit(name).alias("allowed"), F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("outside"), F.lit(0)).alias("stripes"))
    return count(t.allowed, "listed").unionByName(count(t.allowed.where("false"), "no list"))


def declared_mirrors(t):
    declared = t.files.select("file_id", (F.col("file_id") % 4).cast("int").alias("declared"))
    return layout.verdicts(t.files, t.components, t.objects, t.banned, t.pool_members, declared)


def goal_actions(t):
    return decide.goal_actions(t.targets())


def projected_result(t):
    return report.projected(t.files, decide.plan_counts(t.states()).drop("by_slot"))


def directories_of(t):
    """The directories above the files; a few are mount points of device 9."""
    one = t.files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    both = one.unionByName(one.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct())
    return both.select("path", F.when(F.col("path").rlike("/(p|d[0-9]*7)$"), 9).otherwise(1).cast("long").alias("st_dev"))


def resolve_path(t):
    files = t.files.select("file_id", "path", "st_dev", F.when(F.col("file_id") % 23 == 0, 0o120777).otherwise(0o100644).alias("st_mode"))
    both = [resolve.resolve(files, directories_of(t), ROOT, 1, allow).withColumn("other_devices", F.lit(allow)) for allow in (False, True)]
    return both[0].unionByName(both[1])


def identity_match(t):
    expected = t.files.select("file_id", (F.col("st_dev") + F.when(F.col("file_id") % 10 == 3, 1).otherwise(0)).alias("expected_dev"), (F.col("st_ino") + F.when(F.col("file_id") % 10 == 4, 1).otherwise(0)).alias("expected_ino"))
    return resolve.identity(t.files, expected)


def file_system_names(t):
    k, text = F.col("file_id"), lambda x: x.cast("string")
    name = lambda odd, n: F.concat(F.when(odd, "other").otherwise(FSNAME), F.lit("-OST"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    requests = t.files.select(
        k.alias("request_id"), F.when(k % 3 == 0, F.when(k % 21 == 0, "fs1").otherwise(FSNAME)).alias("expected_fsname"), F.when(k % 4 < 3, F.array(text(k % 9), name(k % 11 == 0, k % 16))).alias("allowed"),
        F.when(k % 2 == 0, F.array(name(k % 8 == 2, k % 64))).alias("banned"), F.when(k % 7 == 0, F.concat(F.lit("fs0."), F.repeat(F.lit("p"), (k % 20).cast("int")))).when(k % 7 == 1, "fs2.gold").when(k % 7 == 2, "gold").alias("pool_name"),
    )
    return resolve.file_system(requests, FSNAME)


def manifest_links(t):
    return jobs.manifest_links(t.files.where("file_id % 6 <> 1").select("path"), t.files)


def retry_policy(t):
    outcomes = t.components.select("file_id", F.col("comp_ord").alias("attempt"), (F.col("ost0") % 10 != 0).alias("ok"))
    return decide.retries(outcomes, attempts=3)


def plan_counts(t):
    return decide.plan_counts(t.states()).drop("by_slot")


def plan_actions(t):
    return decide.plan_actions(decide.plan_counts(t.states()))


def requests_of(t):
    """Requests made up from files: every rule is broken by some of them."""
    k = F.col("file_id")
    text = lambda x: x.cast("string")
    sp = lambda n: F.when(k % 13 == 0, F.concat(F.lit("0"), text(k % 50 + 1))).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(n))))
    return t.files.select(
        k.alias("request_id"), F.when(k % 31 == 0, "fs0").otherwise("/fs0").alias("root"),
        F.when(k % 37 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 41 == 0, F.array(F.lit(""))).otherwise(F.array("path")).alias("paths"),
        F.when(k % 29 == 0, "").when(k % 3 == 0, "pool1").alias("pool_name"), F.when(k % 5 == 0, text(k % 2100)).alias("stripe_count"),
        F.when(F.col("target_opt").isNotNull(), text(F.col("target_opt") * F.when(k % 23 == 0, 9).otherwise(1))).alias("target"), F.when(k % 19 == 0, "1e3").when(k % 17 == 0, "5").alias("attempts"),
        F.when(k % 6 == 0, text(k % 4)).alias("expected_dev"), F.when((k % 6 == 0) & (k % 7 != 0), text(k)).alias("expected_ino"),
        F.when(k % 4 == 0, F.array(sp(k % 64), sp(k % 32))).otherwise(F.array().cast("array<string>")).alias("banned"),
        F.when(k % 8 < 3, F.array(text(k % 9), text(k % 16), text(k % 25))).otherwise(F.array().cast("array<string>")).alias("allowed"),
        (F.col("mode") == "keep").alias("keep"), ((F.col("mode") == "collapse") & (k % 9 != 0)).alias("collapse"), (k % 10 == 1).alias("inspect"), (k % 12 == 0).alias("allow_other_devices"),
    )


def request_validation(t):
    return validate.validate(requests_of(t))


def result_record(t):
    return report.results(fid_of(t), t.targets()).select("file_id", report.record_json(ROOT).alias("record"))


def result_text(t):
    return report.results(t.files, t.targets()).select("file_id", report.record_text().alias("line"))


def unfinished(t):
    return report.unfinished(report.results(t.files, t.targets()))


def outcomes_of(t):
    v = t.files.select("file_id", "path").join(t.verdicts().select("file_id", "error"), "file_id", "left")
    return v.select("file_id", "path", F.when(F.col("error").isNull(), "unstarted").when(F.col("error") == 0, "object").otherwise("failed").alias("outcome"))


def accounting(t):
    return jobs.accounting(outcomes_of(t))


def exit_code(t):
    return jobs.exit_codes(outcomes_of(t))


def remaining_tasks(t):
    started = outcomes_of(t).where("outcome <> 'unstarted'")
    return jobs.remaining(t.files.select("path"), started)


def protection_verdict(t):
    return jobs.protection(t.pool_members.join(layout.bad_pools(t.pool_members, t.banned).withColumn("bad", F.lit(True)), "pool", "left").select(F.col("bad").isNull().alias("holds")))


def hardlink_groups(t):
    return jobs.hardlink_groups(t.files)


def tree_diff(t):
    target = t.files.where("file_id % 53 <> 0").select(F.when(F.col("file_id") % 59 == 0, F.concat("path", F.lit("~"))).otherwise(F.col("path")).alias("path"), F.when(F.col("file_id") % 61 == 0, F.lit(None)).otherwise(F.col("file_size")).alias("file_size"), (F.col("flr_state") + F.when(F.col("file_id") % 67 == 0, 1).otherwise(0)).alias("flr_state"))
    return jobs.tree_diff(t.files, target, ["file_size", "flr_state"])


def restore_order(t):
    files = t.files.select("path", F.lit(False).alias("is_dir"))
    parent = lambda path: F.regexp_replace(path, "/[^/]*$", "")
    one = t.files.select(parent("path").alias("path")).distinct()
    dirs = one.select(F.posexplode(F.array("path", parent("path"), parent(parent("path")))).alias("up", "path")).distinct().select("path", F.lit(True).alias("is_dir"))
    return jobs.restore_order(files.unionByName(dirs))


def rollback_selection(t):
    state = t.files.select("path", "st_dev", "st_ino", F.when(F.col("file_id") % 3 == 0, 0o40700).otherwise(0o40755).alias("mode"), (F.col("file_id") % 4).alias("uid"))
    journal = t.files.where("file_id % 2 = 0").select("path", F.col("st_dev").alias("dev"), (F.col("st_ino") + F.when(F.col("file_id") % 10 == 0, 1).otherwise(0)).alias("ino"), F.lit(0).cast("long").alias("own_uid"))
    return jobs.rollback_candidates(journal, state)


def last_status(t):
    lines = t.components.select(F.col("file_id").alias("task"), F.col("comp_ord").alias("position"), F.concat(F.lit("component "), F.col("comp_ord").cast("string"), F.lit(" of mirror "), F.col("mirror_id").cast("string")).alias("line"))
    return jobs.last_status(lines)


ALL = [
    components_scan, objects_scan, pool_scan, parse_ost, ost_name, path_lexical, placement, error_class, mirror_state, coverage, zero_length_rule, scan_errors,
    mirror_slots, layout_verdict, banned_objects, outside_allowed, bad_pools, unknown_osts, usable_osts, stale_range, layout_description, copy_chunks, target_count, goal_read,
    done, dry_run, inspection, pick_banned, pick_surplus, delete_guard, new_mirror, retry_policy, plan_counts, plan_actions, request_validation, result_record, result_text, unfinished,
    stale_components, target_text, allocation, copy_plan, new_mirror_unrestricted, allowed_sets, declared_mirrors, goal_actions, projected_result, resolve_path, identity_match, file_system_names, manifest_links,
    accounting, exit_code, remaining_tasks, protection_verdict, hardlink_groups, tree_diff, restore_order, rollback_selection, last_status,
]


def _bound(f):
    def query(spark, sf_dir):
        return f(Tables(spark, sf_dir))

    query.__name__ = f.__name__
    return query


QUERIES = {f.__name__: _bound(f) for f in ALL}
