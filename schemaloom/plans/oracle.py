"""Independent oracle SQL (DuckDB) for every registered query.

The oracle never sees DDL text: it computes the expected rows straight from
customer / orders / lineitem / supplier / part / documents with the FIXTURES.md
§2 relations (``ver``, ``cols``, ``pcols``, ``attrs``), while the Spark side
renders text and reads it back. Clause values are compared in canonical form
(lower-case outside quotes), so the oracle applies ``lower``.
"""

from __future__ import annotations

import re

BASE = r"""
with ver as materialized (
  select concat('db_', cast(c.c_nationkey as varchar)) as db,
         concat('t_', cast(c.c_custkey as varchar)) as tbl,
         o.o_orderkey as vid, o.o_orderdate as captured_at,
         o.o_orderstatus as status, substring(o.o_orderpriority, 1, 1) as prio,
         lower(c.c_mktsegment) as seg, o.o_orderkey % 50 = 7 as is_like,
         cast(row_number() over (partition by c.c_custkey
                                 order by o.o_orderdate, o.o_orderkey) as integer) as v
  from customer c join orders o on o.o_custkey = c.c_custkey),
raw as (
  select v.db, v.tbl, v.v, concat('c_', cast(l.l_partkey % 8 as varchar)) as name,
         case l.l_returnflag when 'A' then 'DECIMAL(10,2)' when 'R' then 'BIGINT'
              else 'MAP<STRING,INT>' end as type,
         case when l.l_linestatus = 'O'
              then concat('open, (q ', cast(cast(l.l_quantity as integer) as varchar), ')') end as comment,
         row_number() over (partition by v.tbl, v.v, l.l_partkey % 8
           order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
                    l.l_discount, l.l_tax, l.l_shipdate, l.l_returnflag, l.l_linestatus) as rn
  from ver v join lineitem l on l.l_orderkey = v.vid
  where not v.is_like),
cols as materialized (select db, tbl, v, name, type, comment from raw where rn = 1),
pcols as materialized (
  select db, tbl, v, 1 as pos, 'dt' as name, 'STRING' as type, 'load day' as comment
    from ver where not is_like and prio in ('1', '2')
  union all
  select db, tbl, v, 1, 'dt', 'STRING', cast(null as varchar) from ver where not is_like and prio = '3'
  union all
  select db, tbl, v, 2, 'hr', 'INT', cast(null as varchar) from ver where not is_like and prio = '3'),
attrs as materialized (
  select db, tbl, v, vid, captured_at,
         case when status = 'F' then 'external' end as kind,
         case when is_like then concat(db, '.t_template') end as like_table,
         case when not is_like and vid % 4 = 0
              then concat('clustered by (c_0) into ', cast(vid % 16 + 1 as varchar), ' buckets') end as clustered,
         case when not is_like and vid % 10 = 0 then 'skewed by (c_1, c_2)' end as skewed,
         case when not is_like and vid % 10 = 0 then 'on ((1,2),(3,4))' end as skewed_on,
         case when not is_like and vid % 20 = 0 then 'stored as directories' end as skewed_dirs,
         lower(case when is_like then concat('LOCATION ''/wh/', db, '/', tbl, '''')
              else concat('STORED AS ', case when status = 'P' then 'PARQUET' else 'ORC' end,
                          ' LOCATION ''/wh/', db, '/', tbl, ''' TBLPROPERTIES (''owner''=''', seg, ''')')
              end) as options_tail
  from ver),
cons as materialized (
  select db, tbl, v,
         concat('constraint pk_', cast(vid as varchar), ' primary key (c_0, c_1) disable novalidate') as text
  from ver x where vid % 6 = 1 and exists (select 1 from cols c where c.tbl = x.tbl and c.v = x.v)),
pairs as (select n.db, n.tbl, n.v, o.v as pv from ver n join ver o on n.tbl = o.tbl and n.v = o.v + 1),
col_sides as (
  select n.db, n.tbl, n.v, c.name, 1 as side, c.type, c.comment
    from pairs n join cols c on c.tbl = n.tbl and c.v = n.v
  union all
  select n.db, n.tbl, n.v, c.name, 0, c.type, c.comment
    from pairs n join cols c on c.tbl = n.tbl and c.v = n.pv),
pcol_sides as (
  select n.db, n.tbl, n.v, c.name, 1 as side, c.type, c.comment
    from pairs n join pcols c on c.tbl = n.tbl and c.v = n.v
  union all
  select n.db, n.tbl, n.v, c.name, 0, c.type, c.comment
    from pairs n join pcols c on c.tbl = n.tbl and c.v = n.pv),
col_diff as (
  select db, tbl, v, name,
         case when max(side) = 0 then 'deleted' when min(side) = 1 then 'added'
              when max(type) filter (where side = 0) is distinct from max(type) filter (where side = 1)
                or max(comment) filter (where side = 0) is distinct from max(comment) filter (where side = 1)
              then 'changed' else 'same' end as change,
         max(type) filter (where side = 0) as old_type, max(type) filter (where side = 1) as new_type,
         max(comment) filter (where side = 0) as old_comment,
         max(comment) filter (where side = 1) as new_comment
  from col_sides group by db, tbl, v, name),
pcol_diff as (
  select db, tbl, v, name,
         case when max(side) = 0 then 'deleted' when min(side) = 1 then 'added'
              when max(type) filter (where side = 0) is distinct from max(type) filter (where side = 1)
                or max(comment) filter (where side = 0) is distinct from max(comment) filter (where side = 1)
              then 'changed' else 'same' end as change,
         max(type) filter (where side = 0) as old_type, max(type) filter (where side = 1) as new_type,
         max(comment) filter (where side = 0) as old_comment,
         max(comment) filter (where side = 1) as new_comment
  from pcol_sides group by db, tbl, v, name),
constraint_diff as (
  select db, tbl, v, text, case when max(side) = 0 then 'deleted' else 'added' end as change
  from (select n.db, n.tbl, n.v, c.text, 1 as side
          from pairs n join cons c on c.tbl = n.tbl and c.v = n.v
        union all
        select n.db, n.tbl, n.v, c.text, 0
          from pairs n join cons c on c.tbl = n.tbl and c.v = n.pv) x
  group by db, tbl, v, text having count(*) = 1),
attr_pairs as (
  select n.db, n.tbl, n.v, o.kind as o_kind, n.kind as n_kind,
         o.clustered as o_clustered, n.clustered as n_clustered,
         o.skewed as o_skewed, n.skewed as n_skewed,
         o.skewed_on as o_skewed_on, n.skewed_on as n_skewed_on,
         o.skewed_dirs as o_skewed_dirs, n.skewed_dirs as n_skewed_dirs,
         o.options_tail as o_options_tail, n.options_tail as n_options_tail,
         o.like_table as o_like_table, n.like_table as n_like_table
  from pairs p join attrs n on n.tbl = p.tbl and n.v = p.v join attrs o on o.tbl = p.tbl and o.v = p.pv),
attr_diff as (
  select db, tbl, v, 'kind' as section, o_kind as old, n_kind as new from attr_pairs where o_kind is distinct from n_kind
  union all select db, tbl, v, 'clustered', o_clustered, n_clustered from attr_pairs where o_clustered is distinct from n_clustered
  union all select db, tbl, v, 'skewed', o_skewed, n_skewed from attr_pairs where o_skewed is distinct from n_skewed
  union all select db, tbl, v, 'skewed_on', o_skewed_on, n_skewed_on from attr_pairs where o_skewed_on is distinct from n_skewed_on
  union all select db, tbl, v, 'skewed_dirs', o_skewed_dirs, n_skewed_dirs from attr_pairs where o_skewed_dirs is distinct from n_skewed_dirs
  union all select db, tbl, v, 'options_tail', o_options_tail, n_options_tail from attr_pairs where o_options_tail is distinct from n_options_tail
  union all select db, tbl, v, 'like_table', o_like_table, n_like_table from attr_pairs where o_like_table is distinct from n_like_table),
def_diff as (
  select db, tbl, v, 'columns' as section, change, name,
         case when change <> 'added' then concat(name, ' ', old_type, coalesce(' COMMENT ''' || old_comment || '''', '')) end as old,
         case when change <> 'deleted' then concat(name, ' ', new_type, coalesce(' COMMENT ''' || new_comment || '''', '')) end as new
  from col_diff where change <> 'same'
  union all
  select db, tbl, v, 'part_columns', change, name,
         case when change <> 'added' then concat(name, ' ', old_type, coalesce(' COMMENT ''' || old_comment || '''', '')) end,
         case when change <> 'deleted' then concat(name, ' ', new_type, coalesce(' COMMENT ''' || new_comment || '''', '')) end
  from pcol_diff where change <> 'same'
  union all
  select db, tbl, v, 'constraints', change, text,
         case when change = 'deleted' then text end, case when change = 'added' then text end
  from constraint_diff
  union all
  select db, tbl, v, section,
         case when old is null then 'added' when new is null then 'deleted' else 'changed' end,
         cast(null as varchar), old, new
  from attr_diff),
sig as (
  select x.db, x.tbl, x.v, x.vid, x.captured_at,
         concat_ws('|', coalesce(a.kind, '~'), coalesce(a.like_table, '~'), coalesce(a.clustered, '~'),
                   coalesce(a.skewed, '~'), coalesce(a.skewed_on, '~'), coalesce(a.skewed_dirs, '~'),
                   coalesce(a.options_tail, '~'),
                   coalesce((select string_agg(c.name || ':' || c.type || ':' || coalesce(c.comment, '~'), ',' order by c.name)
                               from cols c where c.tbl = x.tbl and c.v = x.v), '~'),
                   coalesce((select string_agg(p.name || ':' || p.type || ':' || coalesce(p.comment, '~'), ',' order by p.name)
                               from pcols p where p.tbl = x.tbl and p.v = x.v), '~'),
                   coalesce((select min(k.text) from cons k where k.tbl = x.tbl and k.v = x.v), '~')) as s
  from ver x join attrs a on a.tbl = x.tbl and a.v = x.v),
prev_t as (select distinct db, tbl from ver where captured_at < timestamp '1998-01-01 00:00:00'),
cur_t as (select distinct db, tbl from ver where captured_at >= timestamp '1998-01-01 00:00:00'),
new_t as (select db, tbl from cur_t except select db, tbl from prev_t),
del_t as (select db, tbl from prev_t except select db, tbl from cur_t),
report_lines as (
  select db, tbl, v, name,
         case section when 'columns' then 1 when 'part_columns' then 2 when 'kind' then 3
              when 'identity' then 4 when 'clustered' then 5 when 'skewed' then 6
              when 'skewed_on' then 7 when 'skewed_dirs' then 8 when 'as_sql' then 9
              when 'options_tail' then 10 when 'like_table' then 11 when 'constraints' then 12
              when 'view_text' then 13 when 'provider' then 14 when 'table_comment' then 15 end as section_no,
         concat(case change when 'added' then '+' when 'deleted' then '-' else '~' end, ' ', section, ': ',
                case change when 'added' then coalesce(new, '(none)')
                            when 'deleted' then coalesce(old, '(none)')
                            else coalesce(old, '(none)') || ' -> ' || coalesce(new, '(none)') end) as line
  from def_diff),
change_report as (
  select db, tbl, v, string_agg(line, chr(10) order by section_no, name) as body
  from report_lines group by db, tbl, v),
subs as (
  select distinct concat('db_', cast(s_nationkey as varchar)) as db, recipient
  from (select s_nationkey, min(s_name) as a, max(s_name) as b from supplier group by s_nationkey) x,
       unnest([a, b]) as t(recipient)),
told as (
  select distinct t.db, t.tbl, s.recipient
  from (select distinct db, tbl from ver) t join (
    select db, cast(null as varchar) as tbl, recipient from subs
    union all
    select concat('db_', cast(s_nationkey as varchar)), concat('t_', cast(s_suppkey as varchar)), s_name
    from supplier) s on s.db = t.db and (s.tbl is null or s.tbl = t.tbl)),
kept as (
  select db, tbl, v, vid, cast(captured_at as date) as valid_from from ver x
  where v = 1 or exists (select 1 from def_diff d where d.tbl = x.tbl and d.v = x.v))
"""

_COL_DIFF = ("select db, tbl, v, name, change, old_type, new_type, old_comment, new_comment "
             "from {rel}{where}")

#: What the four runs of ``drift_run`` list and capture.
_RUNS = """
        , runs(run, cut) as (values (1, timestamp '1994-01-01'), (2, timestamp '1996-01-01'),
                                   (3, timestamp '1997-06-01'), (4, timestamp '1998-07-01')),
        listed as (
          select r.run, g.db, g.tbl, max(g.v) as v from runs r join sig g on g.captured_at < r.cut
          where r.run not in (2, 3) or g.tbl not like '%3' group by r.run, g.db, g.tbl),
        caught as (
          select l.run, l.db, l.tbl, g.captured_at,
                 case when (run = 1 and l.tbl like '%8') or (run = 2 and l.tbl like '%5') then 'bad'
                      when run = 3 and l.tbl like '%6' then 'none' else 'read' end as how, g.s
          from listed l join sig g on g.tbl = l.tbl and g.v = l.v)"""

Q: dict[str, str] = {
    # sources / inventory
    "inventory": "select distinct db, tbl from ver",
    "inventory_filtered": "select distinct db, tbl from ver where db <> 'db_0'",
    "def_files": """
        select a.db, a.tbl, a.v, a.v < t.top as is_history, a.kind, a.options_tail,
               (select count(*) from cols c where c.tbl = a.tbl and c.v = a.v) as n_cols,
               (select count(*) from pcols p where p.tbl = a.tbl and p.v = a.v) as n_part_cols
        from attrs a join (select tbl, max(v) as top from ver group by tbl) t
          on t.tbl = a.tbl and a.v >= t.top - 1""",
    "def_files_again": """
        select a.db, a.tbl, a.v, case when a.tbl like '%1' then 1 else 3 end as scan, a.kind, a.options_tail,
               (select count(*) from cols c where c.tbl = a.tbl and c.v = a.v) as n_cols,
               (select count(*) from pcols p where p.tbl = a.tbl and p.v = a.v) as n_part_cols
        from attrs a join (select tbl, max(v) as top from ver where vid % 3 = 0 group by tbl) t
          on t.tbl = a.tbl and a.v = t.top where a.tbl like '%1' or a.tbl like '%2'""",
    "append_snapshot": "select cast(captured_at as date) as capture_date, count(*) as n from ver group by 1",
    "archived_versions": "select db, tbl, v from ver o where exists "
                         "(select 1 from ver n where n.tbl = o.tbl and n.v > o.v)",
    # extraction
    "x_identity": "select v, vid, db, tbl from ver",
    "x_kind": "select db, tbl, v, kind from attrs where kind is not null",
    "x_like": "select db, tbl, v, like_table from attrs where like_table is not null",
    "x_clustered": "select db, tbl, v, clustered, 'c_0' as cluster_cols, "
                   "cast(vid % 16 + 1 as integer) as n_buckets from attrs where clustered is not null",
    "x_skew": "select db, tbl, v, skewed, skewed_on, skewed_dirs from attrs where skewed is not null",
    "x_tail": "select db, tbl, v, options_tail from attrs",
    "x_shape": "select case when is_like then 'like' else 'table' end as shape, count(*) as n "
               "from ver group by 1",
    "x_columns": "select db, tbl, v, name, type, comment from cols",
    "x_part_columns": "select db, tbl, v, pos, name, type, comment from pcols",
    "x_constraints": "select db, tbl, v, text from cons",
    "x_definition": """
        select a.db, a.tbl, a.v, case when like_table is not null then 'like' else 'table' end as shape,
               a.kind, a.db || '.' || a.tbl as identity, a.clustered, a.skewed, a.skewed_on, a.skewed_dirs,
               cast(null as varchar) as as_sql, a.options_tail, a.like_table,
               cast(null as varchar) as view_text, cast(null as varchar) as provider,
               cast(null as varchar) as table_comment, cast(null as varchar) as options,
               coalesce((select count(*) from cols c where c.tbl = a.tbl and c.v = a.v), 0) as n_cols,
               coalesce((select count(*) from pcols p where p.tbl = a.tbl and p.v = a.v), 0) as n_part_cols,
               coalesce((select count(*) from cons k where k.tbl = a.tbl and k.v = a.v), 0) as n_constraints
        from attrs a""",
    "x_statements": """
        , st as (select p_partkey as k, lower(p_brand) as brand, v, p_size > 25 and v = 2 as big
                 from part, (values (1), (2)) t(v))
        select 'x_' || k as tbl, v,
               case when k % 4 = 0 then 'view' else 'table' end as shape,
               case when k % 4 = 1 then 'parquet' end as provider,
               case when k % 4 = 1 then 'it''s ' || brand end as table_comment,
               case when k % 4 = 1 then concat('(''compression''=''', case when big then 'gzip' else 'snappy' end, ''')') end as options,
               case when k % 4 = 1 then 'select * from s.base where (((1 = 1)))' end as as_sql,
               case when k % 4 = 0 then concat('create or replace view s.x_', k, ' as select * from s.base where brand = ''',
                    brand, '''', case when big then ' and size > 25' else '' end) end as view_text,
               case when k % 4 = 2 then 'STRUCT<A:STRUCT<B:STRUCT<C:STRUCT<D:STRUCT<E:MAP<STRING,ARRAY<DECIMAL(10,2)>>>>>>>'
                    when k % 4 = 3 and v = 1 then 'INT' end as first_type,
               case when k % 4 = 2 then 'it''s ' || brand end as first_comment,
               k % 4 = 3 and v = 2 as is_rejected
        from st""",
    "x_rejected": "select 'x_' || p_partkey as tbl, cast(2 as integer) as v, 'table' as shape, "
                  "'column list unbalanced' as reject_reason from part where p_partkey % 4 = 3",
    "x_probes": """
        , st as (select p_partkey as p, p_partkey % 8 as k, lower(p_brand) as brand, v, p_size > 25 and v = 2 as big
                 from part, (values (1), (2)) t(v))
        select 'x_' || p as tbl, v, 's.x_' || p as identity,
               case k when 0 then 'check ' || if(big, 'BIGINT', 'INT') || '; constraint DATE; unique STRING ' || brand
                      when 1 then if(big, 'extra INT; ', '') || 'id INT'
                      when 2 then 'id INT; ts TIMESTAMP' when 3 then 'a INT; b INT'
                      when 4 then 's STRUCT<X:INT COMMENT ''' || brand || ', (Q''' || if(big, ',Y:INT', '')
                                  || '> of s; t ARRAY<STRUCT<`A b`:INT>>'
                      when 5 then 'a INT; b ' || if(big, 'BIGINT', 'INT') || ' -- no /* comment'
                      when 6 then if(big, '', 'a INT') else 'a INT' end as cols,
               case when k = 2 then 'bucket(' || if(big, '32', '16') || ',id); days(ts); id' else '' end as parts,
               case when k = 7 then if(big, 'primary key (a); unique (a)', 'check (a > 0); primary key (a)')
                    else '' end as cons,
               case when k = 3 then 'cluster by (' || if(big, 'b', 'a') || ')' end as clustered,
               case when k = 3 then brand end as table_comment,
               case when k = 6 and big then 'text after the name or the column list that was not read' end
                 as reject_reason
        from st""",
    "probe_diff": """
        , st as (select 'x_' || p_partkey as tbl, p_partkey % 8 as k, lower(p_brand) as brand,
                        cast(2 as integer) as v from part where p_size > 25)
        select tbl, v, 'columns' as section, 'changed' as change, 'check' as name,
               'check INT' as old, 'check BIGINT' as new from st where k = 0
        union all select tbl, v, 'columns', 'added', 'extra', null, 'extra INT' from st where k = 1
        union all select tbl, v, 'part_columns', 'deleted', 'bucket(16,id)', 'bucket(16,id)', null from st where k = 2
        union all select tbl, v, 'part_columns', 'added', 'bucket(32,id)', null, 'bucket(32,id)' from st where k = 2
        union all select tbl, v, 'clustered', 'changed', null, 'cluster by (a)', 'cluster by (b)' from st where k = 3
        union all select tbl, v, 'columns', 'changed', 's',
                         's STRUCT<X:INT COMMENT ''' || brand || ', (Q''> COMMENT ''of s''',
                         's STRUCT<X:INT COMMENT ''' || brand || ', (Q'',Y:INT> COMMENT ''of s''' from st where k = 4
        union all select tbl, v, 'columns', 'changed', 'b', 'b INT COMMENT ''-- no /* comment''',
                         'b BIGINT COMMENT ''-- no /* comment''' from st where k = 5
        union all select tbl, v, 'constraints', 'deleted', 'check (a > 0)', 'check (a > 0)', null from st where k = 7
        union all select tbl, v, 'constraints', 'added', 'unique (a)', null, 'unique (a)' from st where k = 7""",
    "view_diff": """
        select 'x_' || p_partkey as tbl, cast(2 as integer) as v,
               concat('create or replace view s.x_', p_partkey, ' as select * from s.base where brand = ''',
                      lower(p_brand), '''') as old,
               concat('create or replace view s.x_', p_partkey, ' as select * from s.base where brand = ''',
                      lower(p_brand), ''' and size > 25') as new
        from part where p_partkey % 4 = 0 and p_size > 25""",
    "statement_diff": "select 'x_' || p_partkey as tbl, cast(2 as integer) as v, "
                      "case p_partkey % 4 when 0 then 'view_text' else 'options' end as section, "
                      "'changed' as change from part where p_partkey % 4 in (0, 1) and p_size > 25",
    # diff
    "version_pairs": "select n.db, n.tbl, n.v, o.v as v_prev from ver n join ver o "
                     "on n.tbl = o.tbl and n.v = o.v + 1",
    "col_diff": _COL_DIFF.format(rel="col_diff", where=""),
    "cols_added": _COL_DIFF.format(rel="col_diff", where=" where change = 'added'"),
    "cols_deleted": _COL_DIFF.format(rel="col_diff", where=" where change = 'deleted'"),
    "cols_changed": _COL_DIFF.format(rel="col_diff", where=" where change = 'changed'"),
    "pcol_diff": _COL_DIFF.format(rel="pcol_diff", where=""),
    "pcols_added": _COL_DIFF.format(rel="pcol_diff", where=" where change = 'added'"),
    "pcols_deleted": _COL_DIFF.format(rel="pcol_diff", where=" where change = 'deleted'"),
    "pcols_changed": _COL_DIFF.format(rel="pcol_diff", where=" where change = 'changed'"),
    "constraint_diff": "select db, tbl, v, text, change from constraint_diff",
    "attr_diff": "select db, tbl, v, section, old, new from attr_diff",
    "def_diff": "select db, tbl, v, section, change, name, old, new from def_diff",
    "gap_pairs": "select db, tbl, v, pv as v_prev from pairs",
    "gap_diff": "select db, tbl, v, section, change, name, old, new from def_diff",
    "gap_stream": "select db, tbl, v, section, change, name, old, new from def_diff",
    "gap_report": "select db, tbl, v, body from change_report",
    "gap_versions": "select db, tbl, v, vid, valid_from, "
                    "lead(valid_from) over (partition by tbl order by v) as valid_to from kept",
    "change_flags": """
        select p.db, p.tbl, p.v,
               coalesce(bool_or(d.section = 'columns'), false) as columns,
               coalesce(bool_or(d.section = 'part_columns'), false) as part_columns,
               coalesce(bool_or(d.section = 'kind'), false) as kind,
               coalesce(bool_or(d.section = 'identity'), false) as identity,
               coalesce(bool_or(d.section = 'clustered'), false) as clustered,
               coalesce(bool_or(d.section = 'skewed'), false) as skewed,
               coalesce(bool_or(d.section = 'skewed_on'), false) as skewed_on,
               coalesce(bool_or(d.section = 'skewed_dirs'), false) as skewed_dirs,
               coalesce(bool_or(d.section = 'as_sql'), false) as as_sql,
               coalesce(bool_or(d.section = 'options_tail'), false) as options_tail,
               coalesce(bool_or(d.section = 'like_table'), false) as like_table,
               coalesce(bool_or(d.section = 'constraints'), false) as constraints,
               coalesce(bool_or(d.section = 'view_text'), false) as view_text,
               coalesce(bool_or(d.section = 'provider'), false) as provider,
               coalesce(bool_or(d.section = 'table_comment'), false) as table_comment,
               coalesce(bool_or(d.section = 'options'), false) as options
        from ver p left join def_diff d on d.tbl = p.tbl and d.v = p.v
        where p.v > 1 group by p.db, p.tbl, p.v""",
    "changed_versions": "select distinct db, tbl, v from def_diff",
    # history
    "latest_def": "select db, tbl, v, vid from ver x where v = "
                  "(select max(v) from ver y where y.tbl = x.tbl)",
    "new_tables": "select db, tbl from new_t",
    "deleted_tables": "select db, tbl from del_t",
    "table_status": """
        select coalesce(lp.db, lc.db) as db, coalesce(lp.tbl, lc.tbl) as tbl,
               case when lp.tbl is null then 'new' when lc.tbl is null then 'deleted'
                    when lp.s <> lc.s then 'changed' else 'unchanged' end as status
        from (select s.db, s.tbl, s.s from sig s
              where s.captured_at < timestamp '1998-01-01 00:00:00'
                and s.v = (select max(v) from ver y where y.tbl = s.tbl
                           and y.captured_at < timestamp '1998-01-01 00:00:00')) lp
        full outer join
             (select s.db, s.tbl, s.s from sig s join cur_t c on c.tbl = s.tbl
              where s.v = (select max(v) from ver y where y.tbl = s.tbl)) lc
          on lp.tbl = lc.tbl""",
    "last_seen": "select db, tbl, kind, options_tail, max(cast(captured_at as date)) as last_seen "
                 "from attrs group by db, tbl, kind, options_tail",
    "distinct_versions": "select db, tbl, v, vid, valid_from from kept",
    "version_intervals": "select db, tbl, v, vid, valid_from, "
                         "lead(valid_from) over (partition by tbl order by v) as valid_to from kept",
    # reports
    "col_lines": "select db, tbl, v, concat(name, ' ', type, coalesce(' COMMENT ''' || comment || '''', '')) "
                 "as line from cols",
    "change_report": "select db, tbl, v, body from change_report",
    "alert_outbox": "select r.db, r.tbl, r.v, s.recipient, r.body from change_report r "
                    "join told s on s.db = r.db and s.tbl = r.tbl",
    "alerts_delivered": "select r.db, r.tbl, r.v, s.recipient, r.body from change_report r "
                        "join told s on s.db = r.db and s.tbl = r.tbl where r.v in (2, 3)",
    "drift_run": _RUNS + """,
        st as (
          select n.run, n.db, n.tbl,
                 case when o.tbl is null then 'new' when n.how = 'none' then 'not_captured'
                      when n.how = 'bad' then 'unreadable'
                      when k.s is null then 'readable' when k.s <> n.s then 'changed'
                      else 'unchanged' end as status
          from caught n left join caught o on o.tbl = n.tbl and o.run = n.run - 1
          left join (select c.tbl, a.run, max_by(c.s, c.run) as s from caught c, runs a
                     where c.how = 'read' and c.run < a.run group by c.tbl, a.run) k
            on k.tbl = n.tbl and k.run = n.run
          union all
          select o.run + 1, o.db, o.tbl, 'dropped' from caught o
          where o.run < 4 and not exists
            (select 1 from caught n where n.tbl = o.tbl and n.run = o.run + 1))
        select cast(run as integer) as run, db, tbl, status,
               case when status in ('unchanged', 'not_captured', 'unreadable') then 0 else
                 (select count(*) from told t where t.db = st.db and t.tbl = st.tbl) end as n_told,
               case when status not in ('unchanged', 'not_captured', 'unreadable') and exists
                 (select 1 from told t where t.db = st.db and t.tbl = st.tbl) then status end as kind
        from st""",
    "drift_seen": _RUNS + """
        select db, tbl, cast(min(captured_at) as date) as first_seen,
               cast(max(captured_at) as date) as last_seen, count(*) as n_runs
        from caught where how = 'read' group by db, tbl, s""",
    "new_table_alerts": "select db, tbl, concat('new table ', db, '.', tbl) as body from new_t",
    "deleted_alert": "select db, tbl, concat('table dropped from the catalog: ', db, '.', tbl) as body "
                     "from del_t",
    # functions
    "fn_normalise": r"""
        select doc_id, translate(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm_text
        from documents""",
    "fn_version_stamp": """
        select o_orderkey, strftime(o_orderdate, '%d_%m_%Y_%H_%M_%S') as stamp,
               strptime(strftime(o_orderdate, '%d_%m_%Y_%H_%M_%S'), '%d_%m_%Y_%H_%M_%S') = o_orderdate as back_ok
        from orders""",
    # migration (the Spark side copies / reloads real tables, then reads back)
    "backup_copy": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2",
    "compacted_write": "select cast(4 as bigint) as n_files, count(*) as n_rows from lineitem",
    "compacted_by_size": "select cast(2 as bigint) as n_untouched, true as within, true as fewer, "
                         "count(*) as n_rows, cast(sum(l_orderkey) as bigint) as keys from lineitem",
    "reconcile_counts": "select count(*) as n_source, count(*) as n_backup, true as equal from lineitem",
    "reconcile_content": "select count(*) filter (where l_orderkey % 1000 in (1, 3)) as n_missing, "
                         "count(*) filter (where l_orderkey % 1000 in (2, 3)) as n_extra from lineitem",
    "migration_faults": """
        select 'same_location' as "case", 'check' as stage, 'shared_location' as status,
               count(*) as n_live, cast(6 as integer) as n_columns, cast(0 as integer) as n_left from part
        union all select 'parent_location', 'check', 'shared_location', count(*), 6, 0 from part
        union all select 'child_location', 'check', 'shared_location', count(*), 6, 0 from part
        union all select 'bad_type', 'check', 'bad_definition', count(*), 6, 0 from part
        union all select 'extra_column', 'load', 'failed', count(*), 6, 0 from part
        union all select 'failing_select', 'load', 'failed', count(*), 6, 0 from part
        union all select 'filtered', 'done', 'ok', count(*) filter (where p_partkey % 2 = 0), 2, 0 from part
        union all select 'aggregated', 'done', 'ok', count(distinct p_brand), 2, 0 from part
        union all select 'killed_backup', 'backup', 'clean', count(*), 6, 0 from part
        union all select 'killed_reconcile', 'reconcile', 'removed', count(*), 6, 0 from part
        union all select 'killed_load', 'load', 'removed', count(*), 6, 0 from part
        union all select 'killed_verify', 'verify', 'removed', count(*), 6, 0 from part
        union all select 'killed_swap', 'swap', 'removed', count(*), 6, 0 from part
        union all select 'killed_cleanup', 'cleanup', 'removed', count(*), 2, 0 from part
        union all select 'late_' || s, 'done', 'ok', count(*) + count(*) filter (where p_partkey % 10 = 0), 2, 0
          from part, (values ('load'), ('verify'), ('swap')) x(s) group by s
        union all select 'second_run_' || i, 'check', 'refused', 0, 0, 0 from (values (0), (1), (2)) y(i)""",
    "reload_select": """
        select p_partkey as part_id, p_name as part_name, upper(p_brand) as brand, p_type as part_type,
               cast(p_size as bigint) as size, cast(round(p_retailprice * 100) as bigint) as price_cents
        from part""",
    "swap_in": """
        select p_partkey as part_id, p_name as part_name, upper(p_brand) as brand, p_type as part_type,
               cast(p_size as bigint) as size, cast(round(p_retailprice * 100) as bigint) as price_cents
        from part""",
    "migration_summary": "select count(*) as n_source, count(*) as n_backup, count(*) as n_new, "
                         "'ok' as status from part",
    # whole runs
    "drift_report": """
        select db, tbl, v,
               cast(count(*) filter (where section = 'columns' and change = 'added') as bigint) as n_added,
               cast(count(*) filter (where section = 'columns' and change = 'deleted') as bigint) as n_deleted,
               cast(count(*) filter (where section = 'columns' and change = 'changed') as bigint) as n_changed,
               cast(count(*) filter (where section <> 'columns') as bigint) as n_attr
        from def_diff group by db, tbl, v""",
    "stream_drift": "select db, tbl, v, section, change, name, old, new from def_diff",
}


def _relations() -> dict[str, str]:
    """The common relations by name, in order."""
    heads = list(re.finditer(r"^(?:with )?(\w+) as (?:materialized )?\(", BASE, re.M))
    ends = [m.start() for m in heads[1:]] + [len(BASE)]
    return {m.group(1): BASE[m.start():end].strip().removeprefix("with ").rstrip(",")
            for m, end in zip(heads, ends)}


def _needed(text: str, relations: dict[str, str]) -> list[str]:
    """Relations that ``text`` names, directly or through others, in order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = words & relations.keys() - found
        found |= new
        todo += [relations[n] for n in new]
    return [n for n in relations if n in found]


#: The relations over the corpus with unreadable versions: pairs go over gaps,
#: and ``kept`` begins with the first readable version.
GAPS = {
    "pairs": """gap_ver as materialized (
  select db, tbl, v, vid, captured_at from ver
  where vid % 5 not in (2, 3) and not (v = 1 and vid % 11 = 0) and not (v >= 3 and tbl like '%7')),
pairs as materialized (
  select db, tbl, v, pv from (
    select db, tbl, v, lag(v) over (partition by tbl order by v) as pv from gap_ver) x
  where pv is not null)""",
    "kept": """kept as (
  select db, tbl, v, vid, cast(captured_at as date) as valid_from from gap_ver x
  where not exists (select 1 from pairs p where p.tbl = x.tbl and p.v = x.v)
     or exists (select 1 from def_diff d where d.tbl = x.tbl and d.v = x.v))""",
}


def oracle_sql() -> dict[str, str]:
    """Full SQL per query: the relations it needs and the query's SELECT (which
    may begin with relations of its own)."""
    out = {}
    for k, q in Q.items():
        relations = _relations() | (GAPS if k.startswith("gap_") else {})
        q = q.strip()
        own = q.startswith(",")
        parts = [relations[n] for n in _needed(q, relations)]
        text = ",\n".join(parts) + ("\n" + q if own and parts else q[1:] if own else "")
        out[k] = f"with {text}" + ("" if own else f"\n{q}") if text.strip() else q
    return out
