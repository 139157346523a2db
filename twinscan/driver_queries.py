"""Queries of the core library over the driver's tables, each with the SQL that must give the same rows.

The first part runs single operators on plain tables, where SQL can say the same. The second runs whole modes on
source files and unit tables; SQL cannot express those. Tests hold functions, types, classes and overlaps against nested
loops over all pairs, and the labelled corpus holds all but overlaps against its labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan import corpus
from twinscan.engine import Analysis, analyze
from twinscan.functions import likeness as S
from twinscan.functions.normalize import norm_path, valid_score
from twinscan.functions.type_text import overlap_of_words, type_likeness
from twinscan.operators.classes_mode import similar_classes
from twinscan.operators.extract import extract_units
from twinscan.operators.heavy_keys import heavy_keys, key_summaries
from twinscan.operators.overlap_mode import code_segment, multiplicity
from twinscan.operators.pairs import band_pairs, close_names, edit_pairs, exact_classes, overlap_pairs, scope_condition, subset_pairs, without_contained
from twinscan.operators.types_mode import similar_types
from twinscan.options import Options
from twinscan.plans.scratch import cut
from twinscan.sources.tables import table

FLAGSHIP = "files_similar_functions"


def _pair_keys() -> dict:
    return {"file_path": norm_path(F.col("left_loc.file_path")), "symbol_name": F.col("left_loc.symbol_name")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "unit_pairs"), F.col("pair_id"), _pair_keys(), share=0.03).select("key_field", "key_value")


def p4_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = key_summaries(table(spark, d, "unit_pairs"), F.col("pair_id"), _pair_keys(), valid_score(F.col("score")))
    return out.withColumns({"sum_score": F.round("sum_score", 6), "mean_score": F.round("mean_score", 10)})


# Single operators.


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "type_units").select("name").where("name is not null and name <> ''").distinct()


def name_likeness_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = S.name_likeness(F.col("l.name"), F.col("r.name"))
    return edit_pairs(_names(spark, d), "name", 0.75).where(s >= 0.75).select(F.col("l.name").alias("l"), F.col("r.name").alias("r"), F.round(s, 6).alias("score"))


def property_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "type_units").select(F.explode("properties").alias("p")).select(F.col("p.name").alias("name")).where("name is not null").distinct()
    return close_names(names, 0.8).select("l", "r", F.round(S.property_name_likeness(F.col("l"), F.col("r")), 6).alias("score"))


def size_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "n_chars", "series")
    pairs = band_pairs(docs, "uid", "n_chars", 0.99, keys=["series"])
    return pairs.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"))


def exact_text_classes(spark: SparkSession, d: str) -> DataFrame:
    return exact_classes(table(spark, d, "documents"), "doc_id", F.col("text"))


def property_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "type_units").select("unit_id", "properties").dropDuplicates(["unit_id"])
    sets = units.select(F.col("unit_id").alias("uid"), F.array_distinct(F.transform("properties", lambda p: p["name"])).alias("names"))
    tokens = sets.select("uid", F.explode("names").alias("token")).where("token is not null")
    sizes = tokens.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    # Jaccard of at least 0.5 means that two thirds of the mean number of names is shared.
    near = overlap_pairs(tokens, sizes, 2 / 3)
    both = near.join(sets.toDF("l", "ln"), "l").join(sets.toDF("r", "rn"), "r")
    s = S.jaccard(F.col("ln"), F.col("rn"), empty=0.0)
    return both.where(s >= 0.5).select("l", "r", F.round(s, 6).alias("score"))


def parameter_subset_pairs(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "function_units").dropDuplicates(["unit_id"]).where("function_type = 'method' and size(parameters) > 1")
    sets = units.select(F.col("unit_id").alias("uid"), F.col("parameters").alias("tokens"), F.coalesce("class_name", F.lit("")).alias("class_name"))
    return subset_pairs(sets, ["class_name"])


def edit_likeness_scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("n1"), (F.col("l_linenumber") * 7).cast("double").alias("n2"), (F.col("l_discount") * 40).alias("extra"))
    l = l.withColumn("d", F.round(F.abs(F.col("n1") - F.col("n2")) + F.when(F.col("extra") > 1, F.col("extra")).otherwise(0.0), 4))
    s = S.edit_likeness(F.col("d"), F.col("n1"), F.col("n2"))
    return l.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


def short_factor_scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    s = S.short_function_factor(F.col("l_tax") * 12, F.col("l_linenumber"), F.col("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


def atom_cap_scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    s = S.atom_cap(F.col("l_discount") * 10, F.col("l_returnflag") == "R", F.col("l_linenumber") % 4, F.floor(F.col("l_quantity")).cast("int") % 5)
    return l.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


def _scored(spark: SparkSession, pairs: DataFrame, f) -> DataFrame:
    """``pairs``(unit_id, l, r, a, b) with the scalar likeness of the texts a and b, each distinct pair scored once."""
    pairs = cut(pairs, "texts")
    known = pairs.select("a", "b").distinct().withColumn("score", F.round(S.scalar(f)(F.col("a"), F.col("b")), 6))
    return pairs.join(known, ["a", "b"]).select("unit_id", "l", "r", "score")


def signature_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "class_units").dropDuplicates(["unit_id"]).select("unit_id", F.posexplode("methods").alias("pos", "m"))
    rows = m.select("unit_id", F.struct("pos", F.concat_ws(",", "m.parameters", F.coalesce("m.return_type", F.lit(""))).alias("sig")).alias("u"))
    met = rows.withColumnRenamed("u", "x").join(rows.withColumnRenamed("u", "y"), "unit_id").where("x.pos < y.pos")
    return _scored(spark, met.select("unit_id", F.col("x.pos").alias("l"), F.col("y.pos").alias("r"), F.col("x.sig").alias("a"), F.col("y.sig").alias("b")), overlap_of_words)


def union_type_scores(spark: SparkSession, d: str) -> DataFrame:
    """The likeness of two annotations of a class of which one at least is a union."""
    u = table(spark, d, "class_units").dropDuplicates(["unit_id"]).select("unit_id", F.explode("properties").alias("p"))
    rows = u.select("unit_id", F.struct(F.col("p.name").alias("name"), F.col("p.type_annotation").alias("t")).alias("u")).distinct()
    met = rows.withColumnRenamed("u", "x").join(rows.withColumnRenamed("u", "y"), "unit_id").where("x.name < y.name and (x.t like '% | %' or y.t like '% | %')")
    return _scored(spark, met.select("unit_id", F.col("x.name").alias("l"), F.col("y.name").alias("r"), F.col("x.t").alias("a"), F.col("y.t").alias("b")), type_likeness)


def _scoped(spark: SparkSession, d: str, scope: str) -> DataFrame:
    f = table(spark, d, "function_units").select("unit_id", "file_path", "name", "start_line", "end_line").dropDuplicates(["unit_id"]).where("name is not null")
    f = f.withColumn("n", S.line_count(F.col("start_line"), F.col("end_line"))).where("n >= 3")
    met = band_pairs(f, "unit_id", "n", 0.0, scope_condition(scope, F.col("l.file_path"), F.col("r.file_path")), keys=["name"])
    return met.groupBy(F.col("l.name").alias("name")).agg(F.count(F.lit(1)).alias("n_pairs"), F.max(S.impact(F.col("l.n"), F.col("r.n"))).alias("max_impact"))


def scope_same_file(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d, "same_file")


def scope_cross_file(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d, "cross_file")


def contained_overlaps_dropped(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "partial_overlaps").where("source_lines.s is not null and source_lines.e is not null and target_lines.s is not null and target_lines.e is not null and score is not null and not isnan(score)")
    ranges = o.groupBy("overlap_id").agg(*(F.first(c).alias(c) for c in ("source_file_id", "target_file_id", "source_lines", "target_lines", "score")))
    ranges = ranges.select("overlap_id", "source_file_id", "target_file_id", F.struct((-F.col("score")).alias("s"), "overlap_id").alias("rank"), F.col("source_lines.s").alias("s1"), F.col("source_lines.e").alias("e1"), F.col("target_lines.s").alias("s2"), F.col("target_lines.e").alias("e2"))
    return without_contained(ranges, ["source_file_id", "target_file_id"], "rank").select("overlap_id")


def subtree_hash_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three lines as parts of files: file pairs, across repositories, by the number of different runs they share."""
    f = table(spark, d, "project_files").select("file_id", "content").where("content is not null").dropDuplicates(["file_id"])
    lines = f.select("file_id", F.split("content", "\n", -1).alias("l")).where(F.size("l") >= 3)
    runs = lines.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.unhex(F.md5(F.array_join(F.slice("l", i, 3), "\n"))))).alias("hash"))
    return multiplicity(runs, "hash", "file_id")


def overlap_code_segments(spark: SparkSession, d: str) -> DataFrame:
    """The source lines that the overlap reports name, cut out of their files."""
    o = table(spark, d, "partial_overlaps").select("overlap_id", F.col("source_file_id").alias("file_id"), F.col("source_lines.s").alias("s"), F.col("source_lines.e").alias("e")).where("s between 1 and e").distinct()
    f = table(spark, d, "project_files").select("file_id", "content").where("content is not null").dropDuplicates(["file_id"])
    return o.join(f, "file_id").select("overlap_id", F.md5(code_segment(F.col("content"), F.col("s"), F.col("e"))).alias("code"))


def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a report over the tables: files that no parse warning names, and the distinct pairs reported."""
    files = table(spark, d, "project_files").select(norm_path(F.col("file_path")).alias("file_path"))
    failed = table(spark, d, "analyze_warnings").where("message like '%arse%'").select(norm_path(F.col("file_path")).alias("file_path"))
    pairs = table(spark, d, "unit_pairs").select("pair_id").distinct()
    return Analysis(Options(), files, files, pairs, failed.distinct()).counts()


def corpus_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The engine on the labelled corpus, which needs no table."""
    return corpus.confusion(corpus.verdicts(spark))


# Whole modes.


def type_units_similar(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "type_units").dropDuplicates(["unit_id"]).withColumnRenamed("unit_id", "uid")
    return similar_types(u.select("uid", "file_path", "name", "kind", "has_ignore", "properties"), 0.8)


def class_units_similar(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "class_units").dropDuplicates(["unit_id"]).withColumnRenamed("unit_id", "uid")
    return similar_classes(u, 0.8)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Every file once, under a path of its own in its run."""
    f = table(spark, d, "project_files").select("run_id", "file_path", "content").distinct()
    return f.select(F.concat_ws("/", F.concat(F.lit("run"), F.col("run_id").cast("string")), "file_path").alias("file_path"), "content")


def files_units(spark: SparkSession, d: str) -> DataFrame:
    u = extract_units(_files(spark, d), literals=True)
    return u.select("file_path", "unit_kind", "seq", F.coalesce("fn.display_name", "ty.name", "cl.name").alias("name"), "start_line", "end_line", "has_ignore", F.size("fn.tree.labels").alias("tree_size"), "error")


def _mode(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return analyze(_files(spark, d), Options(modes=(mode,))).pairs.drop("l", "r")

    query.__name__ = f"files_similar_{mode}"
    return query


_ALL = [
    p4_found, p4_summaries, name_likeness_pairs, property_name_pairs, size_band_pairs, exact_text_classes, property_jaccard_pairs, parameter_subset_pairs,
    edit_likeness_scores, short_factor_scores, atom_cap_scores, signature_token_overlap, union_type_scores, scope_same_file, scope_cross_file,
    contained_overlaps_dropped, subtree_hash_multiplicity, overlap_code_segments, report_counts, corpus_confusion, type_units_similar, class_units_similar, files_units, *map(_mode, ("functions", "types", "classes", "overlap")),
]
QUERIES = {f.__name__: f for f in _ALL}

SQL_PATH = r"regexp_replace(replace(left_loc.file_path, '\', '/'), '^(\./)+', '')"
SQL_SCORE = "case when not isnan(score) and score between 0 and 1 then score end"

_P4_ROWS = f"""
rows as (select distinct pair_id, {SQL_PATH} as file_path, left_loc.symbol_name as symbol_name, {SQL_SCORE} as score
         from unit_pairs where pair_id is not null),
stacked as (select pair_id, 'file_path' as key_field, file_path as key_value, score from rows
            union all select pair_id, 'symbol_name', symbol_name, score from rows)
"""
_SCOPED = """
with f as (select distinct unit_id, file_path, name, start_line, end_line, end_line - start_line + 1 as n from function_units where name is not null)
select a.name, count(*) as n_pairs, max(least(a.n, b.n)) as max_impact from f a join f b on a.name = b.name and a.unit_id < b.unit_id and a.file_path {op} b.file_path
where a.n >= 3 and b.n >= 3 group by a.name"""

SQL = {
    "p4_found": f"""with {_P4_ROWS}
select key_field, key_value from stacked where key_value is not null group by 1, 2
having count(distinct pair_id) >= 0.03 * (select count(distinct pair_id) from unit_pairs)""",
    "p4_summaries": f"""with {_P4_ROWS}
select key_field, key_value, count(*) as n_rows, count(score) as n_scored, min(score) as min_score, max(score) as max_score,
       round(sum(score), 6) as sum_score, round(sum(score) / nullif(count(score), 0), 10) as mean_score
from stacked where key_value is not null group by 1, 2""",
    "name_likeness_pairs": """
with n as (select distinct name from type_units where name is not null and name <> ''),
p as (select a.name as l, b.name as r, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) as s from n a join n b on a.name < b.name)
select l, r, round(s, 6) as score from p where s >= 0.75""",
    "property_name_pairs": """
with n as (select distinct p.name as name from (select unnest(properties) as p from type_units) where p.name is not null),
p as (select a.name as l, b.name as r, case when trim(lower(a.name)) = trim(lower(b.name)) then 0.95
        else greatest(0, 1 - levenshtein(trim(lower(a.name)), trim(lower(b.name))) / greatest(strlen(trim(lower(a.name))), strlen(trim(lower(b.name))))) end as s from n a join n b on a.name < b.name)
select l, r, round(s, 6) as score from p where s >= 0.8""",
    "size_band_pairs": """
select a.doc_id as l, b.doc_id as r from documents a join documents b on a.series = b.series and a.doc_id < b.doc_id
where least(a.n_chars, b.n_chars) >= 0.99::double * greatest(a.n_chars, b.n_chars)""",
    "exact_text_classes": """
select doc_id as uid, coalesce(min(doc_id) over (partition by text), doc_id) as class_id from documents where text is not null
union all select doc_id, doc_id from documents where text is null""",
    "property_jaccard_pairs": """
with u as (select distinct unit_id, list_distinct([p.name for p in properties]) as n from type_units),
p as (select a.unit_id as l, b.unit_id as r, len(list_intersect(a.n, b.n)) / len(list_distinct(list_concat(a.n, b.n))) as s
      from u a join u b on a.unit_id < b.unit_id where len(a.n) > 0 and len(b.n) > 0)
select l, r, round(s, 6) as score from p where s >= 0.5""",
    "parameter_subset_pairs": """
with u as (select distinct unit_id, parameters as p, coalesce(class_name, '') as c from function_units where function_type = 'method' and len(parameters) > 1)
select a.unit_id as l, b.unit_id as r from u a join u b on a.c = b.c and a.unit_id < b.unit_id where list_has_all(a.p, b.p) or list_has_all(b.p, a.p)""",
    "edit_likeness_scores": """
with x as (select l_orderkey, l_linenumber, l_quantity as n1, l_linenumber * 7.0::double as n2, l_discount * 40 as extra from lineitem),
y as (select *, round(abs(n1 - n2) + case when extra > 1 then extra else 0 end, 4) as d, greatest(n1, n2) as hi, least(n1, n2) as lo from x),
z as (select *, d / hi as nd, lo / hi as r, greatest(0, 1 - d / hi) as base from y),
w as (select *, case when d = 0 and hi <> lo and hi - lo > 10 then base * 0.5 when d = 0 and hi <> lo and (r < 0.95 or hi - lo > 3) then base * sqrt(r) else base end as s0 from z)
select l_orderkey, l_linenumber, round(s0
  * case when d > 0 and hi < 8 then 0.55 when d > 0 and hi < 16 then 0.92 + 0.08 * least(greatest(1 - 8 * nd, 0), 1) else 1 end
  * case when d > 0 and lo < 10 then greatest(0.25, pow(lo / 10, 0.7)) * case when nd > 0.04 then 0.6 else 1 end
         when d > 0 and lo < 20 then (0.92 + 0.08 * least(greatest(1 - 4 * nd, 0), 1)) * case when nd > 0.18 then 0.85 else 1 end
         when d > 0 and lo < 30 then (0.95 + 0.05 * least(greatest(1 - 4 * nd, 0), 1)) * case when nd > 0.13 then 0.88 else 1 end
         when d = 0 and lo < 8 then least(greatest((lo + 4) / 12, 0.7), 0.95) else 1 end
  * case when nd > 0.16 then greatest(0.3, 1 - 4 * (nd - 0.16)) else 1 end * case when r < 0.5 then sqrt(r) else 1 end, 6) as score from w""",
    "short_factor_scores": """
with x as (select l_orderkey, l_linenumber, l_tax * 12 as s, (l_linenumber + l_quantity) / 2.0 as m from lineitem)
select l_orderkey, l_linenumber, round(case when m < 10 then s * (greatest(0.1, m / 10) + (1 - greatest(0.1, m / 10)) * least(greatest((s - 0.6) / 0.32, 0), 1)) else s end, 6) as score from x""",
    "atom_cap_scores": """
with x as (select l_orderkey, l_linenumber, l_discount * 10 as s, l_returnflag = 'R' as c, l_linenumber % 4 as a, cast(floor(l_quantity) as int) % 5 as b from lineitem)
select l_orderkey, l_linenumber, round(case when s > 0.6 and c then least(s, 0.72::double) when s > 0.6 and a > 0 and b > 0 then least(s, greatest(0.55::double, 0.75 - 0.03 * (a + b - 2)))
  when s > 0.6 and a + b >= 4 then least(s, 0.85::double) else s end, 6) as score from x""",
    "signature_token_overlap": """
with u as (select distinct unit_id, methods from class_units),
m as (select unit_id, unnest(methods) as m, generate_subscripts(methods, 1) - 1 as pos from u),
t as (select unit_id, pos, list_distinct(regexp_extract_all(array_to_string(m.parameters, ',') || ',' || coalesce(m.return_type, ''), '[A-Za-z]+')) as k from m)
select a.unit_id, cast(a.pos as int) as l, cast(b.pos as int) as r, round(case when len(list_distinct(list_concat(a.k, b.k))) = 0 then 1.0 else len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) end, 6) as score
from t a join t b on a.unit_id = b.unit_id and a.pos < b.pos""",
    "union_type_scores": """
with u as (select distinct unit_id, properties from class_units),
p as (select distinct unit_id, p.name as name, p.type_annotation as t, list_distinct([trim(x) for x in string_split(p.type_annotation, '|')]) as m from (select unit_id, unnest(properties) as p from u)),
s as (select a.unit_id, a.name as l, b.name as r, 2 * len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m)) as d from p a join p b on a.unit_id = b.unit_id and a.name < b.name where a.t like '% | %' or b.t like '% | %')
select unit_id, l, r, round(case when d >= 1 then 1.0 else d * 0.6 end, 6) as score from s""",
    "scope_same_file": _SCOPED.format(op="="),
    "scope_cross_file": _SCOPED.format(op="<>"),
    "contained_overlaps_dropped": """
with o as (select distinct overlap_id, source_file_id as f, target_file_id as g, source_lines.s as s1, source_lines.e as e1, target_lines.s as s2, target_lines.e as e2, score
           from partial_overlaps where source_lines.s is not null and source_lines.e is not null and target_lines.s is not null and target_lines.e is not null and score is not null and not isnan(score))
select a.overlap_id from o a where not exists (select 1 from o b where a.f is not distinct from b.f and a.g is not distinct from b.g and b.s1 <= a.s1 and a.e1 <= b.e1 and b.s2 <= a.s2 and a.e2 <= b.e2
  and (b.score > a.score or b.score = a.score and b.overlap_id < a.overlap_id))""",
    "subtree_hash_multiplicity": """
with f as (select distinct file_id, string_split(content, chr(10)) as l from project_files where content is not null),
r as (select distinct file_id, md5(array_to_string(l[i : i + 2], chr(10))) as h from (select file_id, l, unnest(range(1, len(l) - 1)) as i from f))
select a.file_id as l, b.file_id as r, count(*) as shared from r a join r b on a.h = b.h and a.file_id < b.file_id group by 1, 2""",
    "overlap_code_segments": """
with f as (select distinct file_id, case when content = '' then [] when ends_with(content, chr(10)) then string_split(content, chr(10))[:-2] else string_split(content, chr(10)) end as l from project_files where content is not null),
o as (select distinct overlap_id, source_file_id as file_id, source_lines.s as s, source_lines.e as e from partial_overlaps where source_lines.s between 1 and source_lines.e)
select overlap_id, case when s <= len(l) and e <= len(l) then md5(array_to_string([regexp_replace(x, chr(13) || '$', '') for x in l[s : e]], chr(10))) end as code from o join f using (file_id)""",
    "report_counts": r"""
with f as (select distinct regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as p from project_files),
w as (select distinct regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as p from analyze_warnings where message like '%arse%')
select (select count(*) from f where not exists (select 1 from w where w.p = f.p)) as file_count, (select count(distinct pair_id) from unit_pairs) as pair_count""",
    "corpus_confusion": corpus.labels_sql(),
}
