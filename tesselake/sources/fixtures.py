"""Views that read the test tables as file layouts; the same text serves Spark and DuckDB."""

from __future__ import annotations

import re

VIEWS = {
    "v_osts": """select cast(s_suppkey as int) as ost_index,
       'fs0-OST' || lpad(lower(hex(s_suppkey)), 4, '0') || '_UUID' as ost_uuid
from supplier""",
    "v_pool_members": """select 'pool' || cast(s_suppkey % 3 as string) as pool, cast(s_suppkey as int) as ost_index
from supplier""",
    "v_banned": "select cast(s_suppkey as int) as ost_index from supplier where s_suppkey % 10 = 0",
    "v_allowed": "select cast(s_suppkey as int) as ost_index from supplier where s_suppkey % 10 in (1, 3, 5, 7)",
    "v_files": """select o_orderkey as file_id,
       '/fs0/' || lower(o_orderstatus) || '/d' || cast(o_custkey % 50 as string)
         || '/f' || cast(o_orderkey as string) as path,
       case when o_orderkey % 17 = 0 then cast(0 as bigint)
            else cast(floor(o_totalprice) as bigint) * 8 end as file_size,
       cast(case when o_orderkey % 97 = 0 then 2 else 1 end as bigint) as st_dev,
       case when o_orderkey % 20 < 2 then o_orderkey - o_orderkey % 2 else o_orderkey end as st_ino,
       cast(case when o_orderkey % 60 < 2 then 3 when o_orderkey % 20 < 2 then 2 else 1 end as int) as st_nlink,
       cast(case when o_orderkey % 19 = 0 then 2 when o_orderkey % 41 = 0 then 3
                 when o_orderkey % 2 = 0 then 1 else 0 end as int) as flr_state,
       cast(case when o_orderkey % 43 = 0 then 1 + o_orderkey % 4 end as int) as recorded_goal,
       case when o_orderpriority = '1-URGENT' then 'keep'
            when o_orderpriority = '2-HIGH' then 'target' else 'collapse' end as mode,
       cast(case when o_orderpriority = '2-HIGH' then 1 + o_orderkey % 4 end as int) as target_opt
from orders""",
    "v_components": """select file_id, comp_ord, mirror_id,
       (case when l_partkey % 7 <> 0 then 16 else 0 end)
       + (case when l_partkey % 11 = 0 then 32 else 0 end)
       + (case when l_partkey % 29 = 0 then 64 else 0 end)
       + (case when l_partkey % 23 = 0 then 128 else 0 end)
       + (case when l_partkey % 101 = 7 then 256 else 0 end)
       + (case when l_partkey % 997 = 3 then 4096 else 0 end) as flags,
       cast(idx * 1048576 + case when l_partkey % 31 = 0 and idx > 0 then 4096 else 0 end as bigint) as ext_start,
       cast(case when idx = k - 1 then 9223372036854775807
                 when l_partkey % 499 = 5 then idx * 1048576
                 when l_partkey % 499 = 6 then idx * 1048576 - 1
                 else (idx + 1) * 1048576 end as bigint) as ext_end,
       cast(case when l_partkey % 37 = 0 then 2 else 0 end as int) as pattern,
       cast(1 + l_partkey % 3 as int) as stripe_count,
       case when l_partkey % 5 = 0 then 'pool' || cast(l_suppkey % 3 as string) else '' end as pool,
       cast(l_suppkey as int) as ost0,
       l_partkey % 4 = 0 as has_objects
from (
  select *, cast(1 + floor((comp_ord - 1) / k) as int) as mirror_id, (comp_ord - 1) % k as idx
  from (
    select l_orderkey as file_id, 1 + l_orderkey % 3 as k, l_partkey, l_suppkey,
           cast(row_number() over (partition by l_orderkey
             order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as comp_ord
    from lineitem) a) b""",
    "v_objects": """select c.file_id, c.comp_ord, c.mirror_id, i.stripe_idx,
       cast((c.ost0 + i.stripe_idx) % n.n as int) as ost
from v_components c
join (values (0), (1), (2)) i(stripe_idx) on i.stripe_idx < c.stripe_count
cross join (select count(*) as n from supplier) n
where c.pattern <> 2 and (c.flags & 256) = 0 and ((c.flags & 16) <> 0 or c.has_objects)""",
    "v_ost_text": """select sp, cast(expected as int) as expected from (
  select cast(s_suppkey as string) as sp, s_suppkey as expected from supplier
  union all select '0x' || lower(hex(s_suppkey)), s_suppkey from supplier
  union all select 'OST' || lpad(hex(s_suppkey), 4, '0'), s_suppkey from supplier
  union all select 'fs0-OST' || lpad(lower(hex(s_suppkey)), 4, '0') || '_UUID', s_suppkey from supplier
  union all select 'other-OST' || lpad(lower(hex(s_suppkey)), 4, '0'), -2 from supplier
  union all select '0' || cast(s_suppkey as string), -1 from supplier
  union all select '-' || cast(s_suppkey + 1 as string), -1 from supplier
  union all select cast(65536 + s_suppkey as string), -1 from supplier) t""",
    "v_paths": """select file_id,
       case cast(file_id % 9 as int)
            when 0 then path
            when 1 then substr(path, 6)
            when 2 then '/fs0-evil' || substr(path, 5)
            when 3 then path || '/'
            when 4 then '/fs0/a/../b'
            when 5 then '/fs0/a//b'
            when 6 then '/fs0/./a'
            when 7 then '/fs0'
            else '/fs0/' || repeat('n', 256) end as raw_path
from v_files""",
}

_BASE = re.compile(r"\b(from|join)\s+(supplier|orders|lineitem)\b")
_VIEW = re.compile(r"\b(from|join)\s+(v_\w+)\b")


def needs(sql: str) -> list[str]:
    """The views a text reads, directly or through others, in an order that defines each before its use."""
    out: list[str] = []
    for name in dict.fromkeys(m[2] for m in _VIEW.finditer(sql)):
        if name in VIEWS:
            out += [x for x in [*needs(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """The views as common table expressions in front of a text that may have its own."""
    views = ",\n".join(f"{n} as ({VIEWS[n]})" for n in needs(sql))
    if not views:
        return sql
    body = sql.strip()
    return f"with {views},\n{body[5:]}" if body.lower().startswith("with ") else f"with {views}\n{body}"


def view(spark, sf_dir: str, name: str):
    """A view as a DataFrame over the Parquet tables of a folder."""
    return spark.sql(_BASE.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", with_views(f"select * from {name}")))
