"""The queries in DuckDB's SQL, written from the rules alone: no text is shared with the DataFrame code but the views."""

from __future__ import annotations

from tesselake.sources.fixtures import with_views

# Rows with their neighbours, and each row's error in the order of checks.
_SCAN = """
slots as (select file_id, mirror_id, row_number() over (partition by file_id order by min(comp_ord)) as slot from v_components group by file_id, mirror_id),
rows_ as (
  select c.*, f.file_size, f.flr_state, s.slot, (c.flags & 256) <> 0 as ext,
    coalesce(lag(c.ext_end = c.ext_start and (c.flags & 256) = 0) over w, false) as after_zero, lag(c.mirror_id) over w as before_id,
    c.ext_end = c.ext_start and (c.flags & 256) = 0 and lead(c.comp_ord) over w is null as at_end
  from v_components c join v_files f using (file_id) join slots s using (file_id, mirror_id)
  window w as (partition by c.file_id order by c.comp_ord)),
scan_ as (
  select *, after_zero and (not ext or before_id <> mirror_id) as unfollowed,
    case when (flags & ~(16|32|64|128|256)) <> 0 then 95 when ext_end < ext_start then 22
         when after_zero and (not ext or before_id <> mirror_id) then 22 when slot > 16 then 7 end as err
  from rows_),
errs as (
  select file_id, cast(coalesce(arg_min(err, comp_ord) filter (where err is not null), case when bool_or(at_end) then 22 end) as int) as error,
    min(comp_ord) filter (where err is not null) as error_ord
  from scan_ group by file_id having bool_or(err is not null) or bool_or(at_end))"""
# One row for each mirror, by lists: the coverage is folded over the extents in order.
_MIRRORS = (
    _SCAN
    + """,
hit as (select distinct file_id, comp_ord from v_objects where ost in (select ost_index from v_banned)),
bad as (select distinct pool from v_pool_members where ost_index in (select ost_index from v_banned)),
flagged as (
  select s.*, h.file_id is not null as on_banned, s.pool in (select pool from bad) as in_bad,
    not ext and (pattern = 2 or (flags & 16) <> 0 or has_objects) as live
  from scan_ s left join hit h using (file_id, comp_ord)),
counted as (
  select file_id, mirror_id, any_value(slot) as slot, any_value(file_size) as file_size, any_value(flr_state) as flr_state, count(*) as components,
    count_if((flags & 32) <> 0) as stale, count_if((flags & 192) <> 0) as unusable, bool_or((flags & 32) <> 0 and (flags & 192) = 0) as any_stale,
    count_if(live) as init, count_if(live and pattern <> 2 and on_banned) as banned_components,
    count_if(not ext and not live and ext_end > ext_start and file_size > 0 and ext_start < file_size) as missing_data,
    count_if(not ext and not live and in_bad) as pool_banned,
    list_reduce(
      [{'s': 0::bigint, 'e': 0::bigint, 'c': 0::bigint, 'g': false}] || coalesce(list({'s': ext_start, 'e': ext_end, 'c': 0::bigint, 'g': false} order by comp_ord) filter (where not ext and ext_end > ext_start), []),
      lambda a, x: {'s': x.s, 'e': x.e, 'c': case when x.s > a.c then a.c else greatest(a.c, x.e) end, 'g': a.g or x.s > a.c}) as fold
  from flagged group by file_id, mirror_id),
m as (
  select *, fold.c as coverage_end, fold.g as has_gap, banned_components > 0 as banned,
    banned_components = 0 and stale = 0 and unusable = 0 and missing_data = 0 and pool_banned = 0 and not fold.g
      and (file_size <= 0 or fold.c >= file_size) and (file_size <= 0 or init > 0) as usable
  from counted)"""
)
_VERDICT = (
    _MIRRORS
    + """,
v as (
  select file_id, cast(count(*) as int) as mirrors, cast(count_if(banned) as int) as banned, cast(count_if(not banned) as int) as safe,
    cast(count_if(usable and not banned) as int) as usable, bool_or(any_stale) as any_stale, any_value(flr_state) in (2, 3) or bool_or(any_stale) as needs_resync,
    coalesce(max(e.error), 0) as error
  from m left join errs e using (file_id) group by file_id)"""
)
_TARGET = (
    _VERDICT
    + """,
t0 as (select v.*, f.mode, f.target_opt, f.recorded_goal, f.file_size, f.path, case when f.recorded_goal > 0 then f.recorded_goal else v.mirrors end as initial from v join v_files f using (file_id)),
t as (
  select *, case when target_opt > 0 then target_opt when mode = 'collapse' then 1 when mode = 'keep' and initial > 0 then initial else 1 end as target from t0),
d as (select *, banned = 0 and mirrors = target and not any_stale and not needs_resync and usable > 0 as done from t where error = 0)"""
)
_SURPLUS = """,
ranked as (select *, row_number() over (partition by file_id, usable order by slot) as nth from m where not banned),
goes as (select file_id, mirror_id, row_number() over (partition by file_id order by usable, slot) as victim from ranked where not usable or nth > 1)"""
_COUNTS = """,
ar as (
  select file_id, count_if(banned_components = 0 and unusable = 0 and missing_data = 0 and pool_banned = 0 and not has_gap and (file_size <= 0 or (coverage_end >= file_size and init > 0))) as after_resync
  from m group by file_id),
p0 as (select d.*, (usable = 0 and needs_resync) as first_, case when usable = 0 and needs_resync then after_resync else usable end as left_ from d join ar using (file_id) where not done),
p as (
  select file_id, target, first_ as projected_resync_first, cast(case when left_ = 0 then 1 else 0 end as int) as projected_add_first, banned as projected_delete_banned,
    cast(greatest(0, target - (mirrors + case when left_ = 0 then 1 else 0 end - banned)) as int) as projected_add,
    cast(greatest(0, mirrors + case when left_ = 0 then 1 else 0 end - banned - target) as int) as projected_delete_surplus, needs_resync and not first_ as projected_resync_last
  from p0)"""
_INSPECTED = """case when done then 'already in the requested state' else printf('inspected: %d mirrors, %d on banned OSTs, %d usable, size %d%s', mirrors, banned, usable, file_size,
  case when recorded_goal > 0 then '; an earlier run did not finish and recorded its mirror goal on this file' else '' end) end"""
_RESULT = (
    _TARGET
    + f""",
r as (
  select t.file_id, t.path, t.error, t.error = 0 as good, case when t.error = 0 then t.initial end as initial, case when t.error = 0 then t.mirrors end as mirrors,
    case when t.error = 0 then t.banned end as banned, case when t.error = 0 then t.target end as target,
    coalesce(x.message, 'cannot read the layout: error ' || t.error) as message
  from t left join (select file_id, {_INSPECTED} as message from d) x using (file_id))"""
)
_OUT = _VERDICT + ", o as (select f.file_id, f.path, case when v.error is null then 'unstarted' when v.error = 0 then 'object' else 'failed' end as outcome from v_files f left join v using (file_id))"


def _b64(text: str) -> str:
    return f"to_base64(encode({text}))"


_PARSED = r"""case when sp = '' or sp[1] in (' ', chr(9)) then -1
  when instr(sp, '-OST') > 0 and substr(sp, 1, instr(sp, '-OST') - 1) <> 'fs0' then -2
  when instr(sp, '-OST') > 0 then hexes(substr(sp, instr(sp, '-OST') + 4))
  when starts_with(sp, 'OST') then hexes(substr(sp, 4))
  when starts_with(lower(sp), '0x') then hexes(substr(sp, 3))
  when sp[1] = '0' and length(sp) > 1 then -1
  else decs(sp) end"""


def _parse(text: str) -> str:
    """SQL for the index of a spelling; the digit rules are written out for base 16 and 10."""
    import re

    def digits(arg: str, base: int) -> str:
        kind, prefix = ("[0-9A-Fa-f]", "(0[xX])?") if base == 16 else ("[0-9]", "")
        body = f"ltrim(regexp_extract({arg}, '^\\s*[+-]?{prefix}({kind}+)(_UUID)?$', {2 if base == 16 else 1}), '0')"
        number = f"cast('0x0' || {body} as bigint)" if base == 16 else f"cast('0' || {body} as bigint)"
        return f"(case when not regexp_full_match({arg}, '\\s*[+-]?{prefix}{kind}+(_UUID)?') or length({body}) > 9 then -1 when {number} > 65535 or ({number} > 0 and regexp_matches({arg}, '^\\s*-')) then -1 else {number} end)"

    out = re.sub(r"hexes\((substr\(sp, [^()]*(?:\([^()]*\)[^()]*)?\))\)", lambda m: digits(m[1], 16), _PARSED)
    out = out.replace("decs(sp)", digits("sp", 10))
    return re.sub(r"\bsp\b", text, out)


_SQL = {
    "components_scan": "select file_id, comp_ord, mirror_id, file_size, ext_start, ext_end, pool, (flags & 16) <> 0 as init, (flags & 32) <> 0 as stale, (flags & 64) <> 0 as offline, (flags & 128) <> 0 as nosync, (flags & 256) <> 0 as extension from v_components join v_files using (file_id)",
    "objects_scan": "select file_id, comp_ord, stripe_idx, ost, printf('fs0-OST%04x_UUID', ost) as ost_uuid from v_objects",
    "pool_scan": "select pool, ost_index from v_pool_members",
    "parse_ost": f"select sp, cast({_parse('sp')} as int) as parsed, expected from v_ost_text",
    "ost_name": "select ost_index, printf('fs0-OST%04x_UUID', ost_index) as name, printf('fs0-OST%04x_UUID', ost_index) = ost_uuid as same from v_osts",
    "path_lexical": """with r as (select file_id, case when raw_path[1] <> '/' then raw_path when raw_path = '/fs0' or starts_with(raw_path, '/fs0/') then substr(raw_path, 5) end as rest from v_paths),
      q as (select file_id, ltrim(rest, '/') as rel from r)
      select file_id, rel as relative, case when rel is null then 'outside root' when rel = '' then 'root itself'
        when len(list_filter(string_split(case when ends_with(rel, '/') then rel[:-2] else rel end, '/'), lambda p: p in ('', '.', '..') or strlen(p) > 255)) > 0 then 'rejected component'
        when ends_with(rel, '/') then 'directory' else 'ok' end as verdict from q""",
    "placement": "with a as (select list(ost_index order by ost_index) as l from v_allowed) select file_id, l[1 + (st_ino + 1) % len(l)] || ',' || l[1 + (st_ino + 2) % len(l)] as chosen from v_files, a",
    "error_class": """with e as (select file_id, cast(case when file_id % 131 - 120 < 0 then 120 - file_id % 131 else 5 end as int) as errno from v_files)
      select file_id, errno, errno in (4, 11, 16, 37, 110, 116) as transient, cast(case when errno in (4, 11, 16, 37, 110, 116) then 3 else 1 end as int) as exit_code from e""",
    "mirror_state": f"with {_MIRRORS} select file_id, mirror_id, cast(slot as int) as slot, cast(components as int) as components, cast(stale as int) as stale, cast(unusable as int) as unusable, any_stale, cast(init as int) as init, cast(banned_components as int) as banned_components, cast(missing_data as int) as missing_data, cast(pool_banned as int) as pool_banned, has_gap, banned, usable from m",
    "coverage": f"with {_MIRRORS} select file_id, mirror_id, coverage_end, has_gap from m",
    "zero_length_rule": f"with {_SCAN} select file_id, comp_ord, mirror_id, unfollowed, at_end as at_the_end from scan_ where unfollowed or at_end",
    "scan_errors": f"with {_SCAN} select file_id, error, error_ord from errs",
    "mirror_slots": f"with {_SCAN} select file_id, mirror_id, cast(slot as int) as slot from slots",
    "layout_verdict": f"with {_VERDICT} select file_id, {', '.join(f'case when error = 0 then {c} end as {c}' for c in ('mirrors', 'banned', 'safe', 'usable', 'any_stale', 'needs_resync'))}, error from v",
    "banned_objects": "select file_id, comp_ord, min(stripe_idx) as first_banned from v_objects where ost in (select ost_index from v_banned) group by file_id, comp_ord",
    "outside_allowed": """with b as (select file_id, comp_ord, min(stripe_idx) as cut from v_objects where ost in (select ost_index from v_banned) group by all)
      select file_id, comp_ord, cast(count(*) as int) as outside from v_objects left join b using (file_id, comp_ord) where ost not in (select ost_index from v_allowed) and stripe_idx <= coalesce(cut, 99) group by file_id, comp_ord""",
    "bad_pools": "select pool, count(*) as components from v_components where pool in (select p.pool from v_pool_members p join v_banned using (ost_index)) group by pool",
    "unknown_osts": "select ost_index * 3 as ost_index, 19 as errno from v_banned where ost_index * 3 not in (select ost_index from v_osts)",
    "usable_osts": """select 'catalogue' as scope, cast((select count(*) from v_osts) - (select count(*) from v_banned) as int) as usable
      union all select 'allowed', cast(count(*) as int) from v_allowed where ost_index not in (select ost_index from v_banned)
      union all select 'absent pool', null
      union all select pool, cast(count_if(ost_index not in (select ost_index from v_banned)) as int) from v_pool_members group by pool""",
    "stale_components": "select file_id, comp_ord from v_components where (flags // 32) % 2 = 1 and (flags // 128) % 2 = 0",
    "target_text": """with x as (select file_id, list_transform(range(1, file_id % 40 + 2), lambda i: ((file_id * i * 37) % 65536)::varchar) as l from v_files)
      select file_id, array_to_string(list_filter(l, lambda v, i: i = 1 or len(array_to_string(l[1:i - 1], ',')) < 88), ',') as osts from x""",
    "allocation": """with u as (select p.pool as scope, ' in pool ' || p.pool as place, count_if(b.ost_index is null) as n from v_pool_members p left join v_banned b using (ost_index) group by p.pool
        union all select 'catalogue', '', (select count(*) from v_osts) - (select count(*) from v_banned))
      select scope, n >= 31 as possible, case when n >= 31 then 0 else 28 end as errno,
        case when n < 31 then printf('only %d OST%s outside the banned set%s, but a new mirror needs 31 stripes; nothing was changed', n, case when n = 1 then '' else 's' end, place) end as message from u""",
    "copy_plan": """with f as (select file_id, file_size as z, file_size // 2 as h, case when (file_id % 7 + 1) * 2048 < 4096 then 4194304 else (file_id % 7 + 1) * 2048 end as buf from v_files where file_size > 0),
      e as (select *, case when file_id % 2 = 0 then 0 else h end as o, case when file_id % 2 = 0 then z - h else z end as stop from f),
      g as (select file_id, buf, (stop + 4095) // 4096 * 4096 as top, unnest(range(o // 4096 * 4096, (stop + 4095) // 4096 * 4096, buf)) as pos from e)
      select file_id, 'copy' as action, pos, least(buf, top - pos) as length from g union all select file_id, 'truncate', z, 0 from e where stop < z""",
    "new_mirror_unrestricted": f"""with {_MIRRORS}, q as (select file_id, max(mirror_id) as newest from m group by file_id),
      k as (select q.file_id, q.newest, m.banned, m.usable, q.file_id % 5 <> 0 as grown from q join m on m.file_id = q.file_id and m.mirror_id = q.newest)
      select file_id, cast(case when grown then newest else 0 end as int) as added_id, case when not grown then 16 when banned or not usable then 22 else 0 end as errno,
        case when not grown then 'layout changed' when banned then 'banned' when not usable then 'not usable' else 'accepted' end as verdict from k""",
    "allowed_sets": """with b as (select file_id, comp_ord, min(stripe_idx) as cut from v_objects where ost in (select ost_index from v_banned) group by all),
      x as (select file_id, comp_ord from v_objects left join b using (file_id, comp_ord) where ost not in (select ost_index from v_allowed) and stripe_idx <= coalesce(cut, 99))
      select 'listed' as allowed, (select count(*) from (select distinct file_id, comp_ord from x)) as components, (select count(*) from x) as stripes union all select 'no list', 0, 0""",
    "declared_mirrors": f"""with {_VERDICT}, w as (select * replace (case when error = 0 and file_id % 4 > 1 and file_id % 4 <> mirrors then 22 else error end as error) from v)
      select file_id, {', '.join(f'case when error = 0 then {c} end as {c}' for c in ('mirrors', 'banned', 'safe', 'usable', 'any_stale', 'needs_resync'))}, error from w""",
    "goal_actions": f"""with {_TARGET} select file_id, 1 as step, 'SET' as action, target::varchar as value from d where not done and mode = 'keep'
      union all select file_id, case when not done and mode = 'keep' then 2 else 1 end, 'REMOVE', null from d where recorded_goal is not null or not done and mode = 'keep'""",
    "projected_result": f"""with {_TARGET}{_COUNTS}, n as (select *, projected_add_first + projected_add as a, projected_delete_banned + projected_delete_surplus as x, projected_resync_first::int + projected_resync_last::int as r from p)
      select file_id, path, a::int as mirrors_added, x::int as mirrors_deleted, r as resyncs, a > 0 or x > 0 or r > 0 as changed, target::int as mirror_count_after,
        'migrated: ' || target::int || ' mirror' || case when target = 1 then '' else 's' end || ', none on a banned OST; added ' || a || ', deleted ' || x || ', resynced ' || r as message from n join v_files using (file_id)""",
    "resolve_path": """with f as (select file_id, string_split(path, '/') as l, st_dev, file_id % 23 = 0 as odd from v_files),
      c as (select *, case when l[3] = 'p' then 'p' when regexp_full_match(l[4], 'd[0-9]*7') then l[4] end as far from f), a as (select unnest([false, true]) as other_devices),
      v as (select file_id, other_devices, far, case when not other_devices and far is not null then 'component on another file system' when odd then 'not a regular file' when not other_devices and st_dev <> 1 then 'file on another file system' else 'ok' end as verdict from c, a)
      select file_id, verdict, case when verdict like 'component%' then far end as component, case when verdict = 'ok' then 0 else 22 end as errno, other_devices from v""",
    "identity_match": """with e as (select *, st_dev + (file_id % 10 = 3)::int as xd, st_ino + (file_id % 10 = 4)::int as xi from v_files)
      select file_id, case when file_id % 10 in (3, 4) then 116 else 0 end as errno, case when file_id % 10 in (3, 4) then format('the name now refers to a different file: caller expected dev/ino {}/{}, found {}/{}', xd, xi, st_dev, st_ino) end as message from e""",
    "file_system_names": """with v as (select file_id as k, case when file_id % 21 = 0 then 'other file system' when file_id % 4 < 3 and file_id % 11 = 0 then 'allowed target of another file system' when file_id % 8 = 2 then 'banned target of another file system'
        when file_id % 7 = 1 then 'pool of another file system' when file_id % 7 = 0 and (file_id % 20 = 0 or file_id % 20 > 15) then 'invalid pool name' else 'ok' end as verdict from v_files)
      select k as request_id, verdict, case when verdict = 'ok' then case k % 7 when 0 then repeat('p', k % 20) when 2 then 'gold' end end as pool, case when verdict = 'ok' then 0 else 22 end as errno from v""",
    "manifest_links": """with m as (select * from v_files where file_id % 6 <> 1 and st_nlink > 1)
      select path, st_dev, st_ino, cast(count(*) over w as int) as listed, max(st_nlink) over w as links, count(*) over w >= max(st_nlink) over w as complete from m window w as (partition by st_dev, st_ino)""",
    "stale_range": "select file_id, cast(count(*) as int) as n, min(ext_start) as range_start, max(ext_end) as range_end from v_components where (flags & 32) <> 0 and (flags & 128) = 0 group by file_id",
    "layout_description": """with c as (select file_id, count(distinct mirror_id) as mm, count(*) as n, count_if((flags & 16) <> 0) as i, arg_min(stripe_count, comp_ord) as sc, any_value(file_id % 5 + 1) * 65536 as sz, arg_min(pool, comp_ord) as pool from v_components group by file_id),
      o as (select file_id, string_agg(ost, ',' order by stripe_idx) as osts from v_objects where comp_ord = 1 group by file_id)
      select file_id, printf('flr_state=%s mirrors=%d components=%d init=%d stripe_count=%d stripe_size=%d pool=%s osts=[%s]', case when flr_state = 0 then '0' else '0x' || flr_state end, mm, n, i, sc, sz, case when pool = '' then '-' else pool end, coalesce(osts, '-')) as description
      from c join v_files using (file_id) left join o using (file_id)""",
    "copy_chunks": """with e as (select file_id, (file_id * 1237) % 100000 as o, file_size as s from v_files where file_size > 0),
      b as (select file_id, o // 4096 * 4096 as a, (o + s + 4095) // 4096 * 4096 as z from e), g as (select file_id, z, unnest(range(a, z, 1048576)) as pos from b)
      select file_id, pos, least(1048576, z - pos) as length from g""",
    "target_count": f"with {_TARGET} select file_id, cast(initial as int) as initial, cast(target as int) as target from t where error = 0",
    "goal_read": """with g as (select file_id, file_id % 3 <> 0 as privileged, case file_id % 7 when 0 then '' when 1 then 'x' when 2 then repeat('0', 30) || (file_id % 20) when 3 then cast(file_id % 20 as varchar) when 4 then cast(file_id % 20 as varchar) end as t,
        case when file_id % 11 in (0, 1, 2) then cast(file_id % 18 as varchar) when file_id % 11 = 3 then '' end as u from v_files),
      r as (select *, if(privileged, t, u) as x from g), s as (select *, case when length(x) < 32 and x <> '' and regexp_full_match(x, '[0-9]+') then cast(x as int) end as n from r)
      select file_id, privileged, cast(case when n between 1 and 16 then n else 0 end as int) as goal,
        case when x is null and privileged and u is not null then 22 when x is null then 0 when length(x) > 31 then 34 when n between 1 and 16 then 0 else 22 end as errno from s""",
    "done": f"with {_TARGET} select file_id, cast(target as int) as target, done, done and coalesce(recorded_goal, 0) > 0 as clears_goal from d",
    "dry_run": f"""with {_TARGET}, u as (select (select count(*) from v_osts) - (select count(*) from v_banned) as n)
      select file_id, usable = 0 or mirrors < target as needs_new_mirror, case when done then 'already in the requested state' else printf('would migrate: %d of %d mirrors on banned OSTs, %d usable, target mirror count %d', banned, mirrors, usable, target)
        || case when (usable = 0 or mirrors < target) and n < 2 then printf('; but only %d OST%s lie outside the banned set and a new mirror needs 2', n, case when n = 1 then '' else 's' end) else '' end end as message from d, u""",
    "inspection": f"with {_TARGET} select file_id, {_INSPECTED} as message from d",
    "pick_banned": f"with {_MIRRORS} select file_id, arg_min(mirror_id, slot) as mirror_id from m where banned group by file_id",
    "pick_surplus": f"with {_MIRRORS}{_SURPLUS} select file_id, mirror_id from goes where victim = 1",
    "delete_guard": f"""with {_MIRRORS}, g as (select m.file_id, mirror_id, case mirror_id % 3 when 0 then 'BANNED' when 1 then 'SURPLUS' else 'ROLLBACK' end as reason, m.banned, coalesce(target_opt, 1) as target,
        (select count(*) from m x where x.file_id = m.file_id) as n, (select count(*) from m x where x.file_id = m.file_id and x.mirror_id <> m.mirror_id and x.usable) as others from m join v_files f using (file_id)),
      h as (select *, case when others < 1 then 'no usable copy left' when reason = 'BANNED' and not banned then 'no longer banned' when reason = 'SURPLUS' and n <= target then 'nothing is surplus' else 'allowed' end as verdict from g)
      select file_id, mirror_id, reason, case reason when 'BANNED' then 'banned' when 'ROLLBACK' then 'rollback of the mirror just added' else 'surplus' end as reason_text, verdict, case when verdict = 'allowed' then 0 else 11 end as errno from h""",
    "new_mirror": f"""with {_MIRRORS}, cut as (select file_id, comp_ord, min(stripe_idx) as z from v_objects where ost in (select ost_index from v_banned) group by all),
      ou as (select file_id, mirror_id, count(*) as n_out from v_objects left join cut using (file_id, comp_ord) where ost not in (select ost_index from v_allowed) and stripe_idx <= coalesce(z, 99) group by all),
      q as (select file_id, max(mirror_id) as newest from m group by file_id),
      k as (select q.file_id, q.newest, m.banned, coalesce(n_out, 0) as n_out, m.usable, q.file_id % 5 <> 0 as grown from q join m on m.file_id = q.file_id and m.mirror_id = q.newest left join ou on ou.file_id = q.file_id and ou.mirror_id = q.newest)
      select file_id, cast(case when grown then newest else 0 end as int) as added_id, case when not grown then 16 when banned or n_out > 0 or not usable then 22 else 0 end as errno,
        case when not grown then 'layout changed' when banned then 'banned' when n_out > 0 then 'outside allowed' when not usable then 'not usable' else 'accepted' end as verdict from k""",
    "retry_policy": """with a as (select file_id, min(comp_ord) filter (where ost0 % 10 <> 0) as won, count(*) as n from v_components where comp_ord <= 3 group by file_id)
      select file_id, won is not null as added, cast(coalesce(won - 1, n) as int) as allocation_retries, case when won is null then 1 else 0 end as rc, case when won is null then 11 else 0 end as errno from a""",
    "plan_counts": f"with {_TARGET}{_COUNTS} select file_id, cast(target as int) as target, projected_resync_first, projected_add_first, projected_delete_banned, projected_add, projected_delete_surplus, projected_resync_last from p",
    "plan_actions": f"""with {_TARGET}{_COUNTS}{_SURPLUS}, steps as (
        select file_id, 1 as part, 1 as nth, 'RESYNC' as action, null::int as mirror_id, null::varchar as reason from p where projected_resync_first
        union all select file_id, 2, 1, 'ADD', null, null from p where projected_add_first > 0
        union all select * from (select file_id, 3, row_number() over (partition by file_id order by slot) as k, 'DELETE', mirror_id, 'banned' from m join p using (file_id) where m.banned) where k <= 32
        union all select file_id, 4, unnest(range(1, projected_add + 1)), 'ADD', null, null from p
        union all select file_id, 5, victim, 'DELETE', mirror_id, 'surplus' from goes join p using (file_id) where victim <= projected_delete_surplus
        union all select file_id, 6, 1, 'RESYNC', null, null from p where projected_resync_last)
      select file_id, cast(row_number() over (partition by file_id order by part, nth) as int) as step, action, cast(mirror_id as int) as mirror_id, reason from steps""",
    "result_record": f"""with {_RESULT} select file_id, '{{"schema":2,"status":"' || case when good then 'ok' else 'error' end || '","rc":' || case when good then 0 when error in (4, 11, 16, 37, 110, 116) then 3 else 1 end
      || ',"retryable":' || case when error in (4, 11, 16, 37, 110, 116) then 'true' else 'false' end || ',"program":"tesselake","program_version":"1.0","path_b64":"' || {_b64("path")} || '","root_b64":"' || {_b64("'/fs0'")}
      || '"' || case when file_id % 13 <> 0 then printf(',"fid":"[0x%x:0x%x:0x0]"', 8589935616 + file_id % 7, file_id) else '' end || ',"changed":false,"pending_layout":false,"initial_mirror_count":' || coalesce(initial::varchar, 'null') || ',"mirror_count_before":' || coalesce(mirrors::varchar, 'null') || ',"mirror_count_after":' || coalesce(mirrors::varchar, 'null')
      || ',"banned_mirrors_before":' || coalesce(banned::varchar, 'null') || ',"banned_mirrors_after":' || coalesce(banned::varchar, 'null') || ',"target_mirror_count":' || coalesce(target::varchar, 'null')
      || ',"mirrors_added":0,"mirrors_deleted":0,"resyncs":0,"allocation_retries":0,"message":"' || message || '"' || case when good then '' else ',"stage":"analyse","errno":' || error end || '}}' as record from r""",
    "result_text": f"""with {_RESULT} select file_id, case when good then printf('tesselake: %s: ok (mirrors %d -> %d, banned %d -> %d, added 0, deleted 0, resyncs 0): %s', path, mirrors, mirrors, banned, banned, message)
      else printf('tesselake: %s: analyse: %s', path, message) end as line from r""",
    "unfinished": f"with {_RESULT} select file_id, {_b64('path')} as path_b64, false as layout_changed from r where not good",
    "accounting": f"with {_OUT} select count(*) as inputs, count_if(outcome = 'object') as finished, count_if(outcome = 'failed') as failed, count_if(outcome = 'unstarted') as unstarted, true as balanced from o",
    "exit_code": f"with {_OUT} select cast(max(case when outcome = 'object' then 0 else 1 end) as int) as exit_code from o",
    "remaining_tasks": f"with {_OUT} select path from o where outcome = 'unstarted'",
    "protection_verdict": "with b as (select distinct pool from v_pool_members where ost_index in (select ost_index from v_banned)), h as (select pool not in (select pool from b) as ok from v_pool_members) select case when bool_and(ok) then 'enforced' when bool_or(ok) then 'partial' else 'not_enforced' end as protection from h",
    "hardlink_groups": "select st_dev, st_ino, cast(count(*) as int) as names, max(st_nlink) as links, count(*) >= max(st_nlink) as complete from v_files where st_nlink > 1 group by st_dev, st_ino",
    "tree_diff": """with b as (select case when file_id % 59 = 0 then path || '~' else path end as path, case when file_id % 61 <> 0 then file_size end as file_size, flr_state + case when file_id % 67 = 0 then 1 else 0 end as flr_state from v_files where file_id % 53 <> 0)
      select coalesce(a.path, b.path) as path, case when b.path is null then 'missing' when a.path is null then 'extra' else concat_ws(',', case when a.file_size is distinct from b.file_size then 'file_size' end, case when a.flr_state is distinct from b.flr_state then 'flr_state' end) end as difference, b.path is null as failed
      from v_files a full join b on a.path = b.path where a.path is null or b.path is null or a.file_size is distinct from b.file_size or a.flr_state is distinct from b.flr_state""",
    "restore_order": """with one as (select distinct regexp_replace(path, '/[^/]*$', '') as path from v_files), two as (select distinct regexp_replace(path, '/[^/]*$', '') as path from one), three as (select distinct regexp_replace(path, '/[^/]*$', '') as path from two),
      x as (select path, false as is_dir from v_files union all select path, true from one union all select path, true from two union all select path, true from three)
      select path, is_dir, row_number() over (order by is_dir, case when is_dir then -len(string_split(path, '/')) else 0 end, path collate "binary") as place from x""",
    "rollback_selection": "select path, st_dev as dev, st_ino as ino from v_files where file_id % 2 = 0 and file_id % 10 <> 0 and file_id % 3 = 0 and file_id % 4 = 0",
    "last_status": "select file_id as task, 'component ' || max(comp_ord) || ' of mirror ' || arg_max(mirror_id, comp_ord) as line from v_components group by file_id",
    "request_validation": f"""with q as (select file_id as k, *, case when file_id % 4 <> 0 then [] when file_id % 13 = 0 then ['0' || (file_id % 50 + 1), '0' || (file_id % 50 + 1)] else ['0x' || lower(printf('%x', file_id % 64)), '0x' || lower(printf('%x', file_id % 32))] end as bs,
        case when file_id % 8 < 3 then [file_id % 9, file_id % 16, file_id % 25] else [] end as al,
        case when file_id % 6 = 0 then file_id % 4 end as dev, case when file_id % 6 = 0 and file_id % 7 <> 0 then file_id end as ino, target_opt * case when file_id % 23 = 0 then 9 else 1 end as tg from v_files),
      b as (select *, list_transform(bs, lambda s: {_parse('s')}) as bx, case when k % 5 = 0 and k % 2100 between 1 and 2000 then k % 2100 else 1 end as st from q),
      w as (select k, list_filter([
        case when k % 29 = 0 then 'V1' end, case when k % 5 = 0 and k % 2100 not between 1 and 2000 then 'V2' end, case when len(list_filter(bx, lambda x: x < 0)) > 0 then 'V4' end,
        case when len(list_distinct(bx)) < len(bx) then 'V5' end, case when tg not between 1 and 16 then 'V6' end, case when k % 19 = 0 then 'V7' end,
        case when (dev is null) <> (ino is null) or dev = 0 or ino = 0 then 'V8' end, case when k % 31 = 0 then 'V9' end, case when k % 37 = 0 or k % 41 = 0 then 'V10' end,
        case when len(bx) = 0 and tg is null and mode <> 'keep' and not (mode = 'collapse' and k % 9 <> 0) and k % 10 <> 1 then 'V11' end,
        case when (mode = 'keep')::int + (tg is not null)::int + (mode = 'collapse' and k % 9 <> 0)::int > 1 then 'V12' end,
        case when list_has_any(al, list_transform(bx, lambda x: x::bigint)) or len(list_distinct(al)) < len(al) or (len(al) > 0 and len(al) < st) then 'V13' end,
        case when k % 12 = 0 and len(bx) > 0 then 'V14' end], lambda x: x is not null) as broken from b)
      select k as request_id, array_to_string(broken, ',') as broken, case when len(broken) > 0 then 2 else 0 end as rc from w""",
}

ORACLE_SQL = {name: with_views(sql) for name, sql in _SQL.items()}
