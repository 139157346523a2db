"""One analysis: files in, one ranked table of duplicate pairs out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.operators.classes_mode import similar_classes
from twinscan.operators.extract import extract_units, with_uid
from twinscan.operators.functions_mode import similar_functions
from twinscan.operators.overlap_mode import overlaps
from twinscan.operators.types_mode import similar_types
from twinscan.options import MODES, Options
from twinscan.plans.scratch import cut

_LOC = "struct<file_path:string,start_line:int,end_line:int,symbol_name:string,kind:string>"
PAIRS = ["mode", "score", "left_loc", "right_loc", "details", "l", "r"]


@dataclass
class Analysis:
    """Lazy results: ``pairs`` in no order (``ranked`` sorts), ``units``, ``skipped`` files with their error."""

    options: Options
    files: DataFrame
    units: DataFrame
    pairs: DataFrame
    skipped: DataFrame

    def ranked(self) -> DataFrame:
        """All pairs, best first; ties by mode, impact and discovery order."""
        rank = F.create_map(*(x for i, m in enumerate(MODES) for x in (F.lit(m), F.lit(i))))[F.col("mode")]
        return self.pairs.orderBy(F.col("score").desc(), rank, F.col("details.impact").desc_nulls_last(), "l", "r", "left_loc.start_line", "right_loc.start_line").drop("l", "r")

    def counts(self) -> DataFrame:
        """file_count (files that parse) and pair_count."""
        n = self.files.select("file_path").distinct().join(self.skipped, "file_path", "left_anti").agg(F.count(F.lit(1)).alias("file_count"))
        return n.withColumn("pair_count", self.pairs.agg(F.count(F.lit(1)).alias("n")).scalar())


def _details(**given: Column) -> Column:
    kinds = {"impact": "int", "structural_score": "double", "naming_score": "double", "node_count": "int", "node_type": "string"}
    return F.struct(*((given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def _loc(unit: str, kind: Column, start: Column | None = None, end: Column | None = None) -> Column:
    at = lambda c, given: (given if given is not None else F.col(f"{unit}.{c}")).cast("int").alias(c)
    return F.struct(F.col(f"{unit}.file_path").alias("file_path"), at("start_line", start), at("end_line", end), F.col(f"{unit}.symbol_name").alias("symbol_name"), kind.alias("kind"))


def analyze(files: DataFrame, options: Options | None = None) -> Analysis:
    """Duplicate pairs of ``files`` (file_path, content) in the modes of ``options``.

    Files are parsed once; the units are written before the self-joins, so no branch parses again. A file that
    does not parse has no units and is listed as skipped.
    """
    o = options or Options()
    needed = {"functions": "function", "overlap": "function", "types": "type", "classes": "class"}
    kinds = tuple({needed[m] for m in o.modes})
    units = cut(with_uid(extract_units(files, literals=o.type_literals, kinds=kinds, parts="overlap" in o.modes, trees="functions" in o.modes)), "units")
    place = units.select("uid", "file_path", "start_line", "end_line", F.coalesce("fn.display_name", "ty.name", "cl.name").alias("symbol_name"), F.coalesce("fn.function_type", "ty.kind", F.lit("class")).alias("kind"), "unit_kind")
    out: DataFrame | None = None

    def add(mode: str, unit_kind: str, found: DataFrame, details: Column, kind: Column | None = None, lines: bool = False) -> None:
        nonlocal out
        side = place.where(F.col("unit_kind") == unit_kind).select("uid", F.struct("file_path", "start_line", "end_line", "symbol_name", "kind").alias("u"))
        a, b = side.toDF("l", "a"), side.toDF("r", "b")
        rows = found.join(a, "l").join(b, "r")
        at = [(F.col("s1"), F.col("e1")), (F.col("s2"), F.col("e2"))] if lines else [(None, None)] * 2
        rows = rows.select(
            F.lit(mode).alias("mode"), "score", _loc("a", kind if kind is not None else F.col("a.kind"), *at[0]).alias("left_loc"),
            _loc("b", kind if kind is not None else F.col("b.kind"), *at[1]).alias("right_loc"), details.alias("details"), "l", "r",
        )
        out = rows if out is None else out.unionByName(rows)

    if "functions" in o.modes:
        add("functions", "function", similar_functions(units, o.threshold, o.scope, o.min_lines, o.min_tokens, o.size_penalty), _details(impact=F.col("impact")))
    scored = _details(structural_score=F.col("structural_score"), naming_score=F.col("naming_score"))
    if "types" in o.modes:
        types = units.where(F.col("unit_kind") == "type").select("uid", "file_path", F.col("ty.name").alias("name"), F.col("ty.kind").alias("kind"), "has_ignore", F.col("ty.properties").alias("properties"))
        add("types", "type", similar_types(types, o.threshold, o.scope, o.types_only, o.allow_cross_kind), scored)
    if "classes" in o.modes:
        classes = units.where(F.col("unit_kind") == "class").select("uid", "file_path", "cl.*")
        add("classes", "class", similar_classes(classes, o.threshold, o.scope), scored)
    if "overlap" in o.modes:
        found = overlaps(units, o.threshold, o.scope, o.overlap_min_window, o.overlap_max_window, o.overlap_size_tolerance)
        add("overlap", "function", found, _details(node_count=F.col("node_count"), node_type=F.col("node_type")), F.lit("token-window"), lines=True)
    assert out is not None
    skipped = units.where(F.col("unit_kind") == "error").select("file_path", "error").distinct()
    return Analysis(o, files.select("file_path"), units, out, skipped)
