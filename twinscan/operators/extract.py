"""Units of source files as a table: one parse per file, written once before any self-join."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = "struct<s:int,e:int>"
FUNCTION = (
    "struct<name:string,display_name:string,function_type:string,method_kind:string,class_name:string,parent_function:string,parameters:array<string>,"
    f"body_span:{_SPAN},params_span:{_SPAN},body_block_span:{_SPAN},is_arrow_expression:boolean,is_async:boolean,is_generator:boolean,is_static:boolean,"
    "tree:struct<labels:array<string>,kinds:array<string>,kids:array<int>>,tree_hash:string,value_atoms:array<string>,control_atoms:array<string>,"
    "counted_atoms:map<string,int>,statements:array<struct<hash:string,names:array<string>>>,"
    "subtrees:array<struct<weight:int,start_line:int,end_line:int,node_type:string,depth:int,hash:bigint,child_hashes:array<bigint>>>>"
)
TYPE = "struct<name:string,kind:string,properties:array<struct<name:string,type_annotation:string,optional:boolean,readonly:boolean>>,generics:array<string>,extends_names:array<string>>"
CLASS = (
    "struct<name:string,is_abstract:boolean,extends_name:string,implements_names:array<string>,constructor_params:array<string>,"
    "properties:array<struct<name:string,type_annotation:string,is_static:boolean,is_private:boolean,is_readonly:boolean,is_optional:boolean>>,"
    "methods:array<struct<name:string,parameters:array<string>,return_type:string,is_static:boolean,is_private:boolean,is_async:boolean,is_generator:boolean,kind:string,body_fingerprint:bigint>>>"
)
UNITS = f"file_path string, unit_kind string, seq int, start_line int, end_line int, has_ignore boolean, fn {FUNCTION}, ty {TYPE}, cl {CLASS}, error string"
_COLUMNS = ["file_path", "unit_kind", "seq", "start_line", "end_line", "has_ignore", "fn", "ty", "cl", "error"]


def _units(batches: Iterator[pd.DataFrame], literals: bool, kinds: tuple[str, ...], parts: bool, trees: bool) -> Iterator[pd.DataFrame]:
    from twinscan.ts.units import Extractor, ParseError

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    for batch in batches:
        rows: list[tuple] = []
        for path, text in zip(batch["file_path"], batch["content"]):
            try:
                e = Extractor(path, text or "", parts, trees)
                read = (("function", "fn", e.functions), ("type", "ty", lambda e=e: e.types(literals)), ("class", "cl", e.classes))
                found = [(kind, column, get()) for kind, column, get in read if kind in kinds]
            except (ParseError, RecursionError) as problem:
                rows.append((path, "error", 0, None, None, None, None, None, None, f"Parse errors: {problem}"))
                continue
            for kind, column, units in found:
                for seq, u in enumerate(units):
                    place = (path, kind, seq, u.pop("start_line"), u.pop("end_line"), u.pop("has_ignore"))
                    rows.append((*place, *(u if c == column else None for c in ("fn", "ty", "cl")), None))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def extract_units(files: DataFrame, path: Column | None = None, content: Column | None = None, literals: bool = False, tasks: int | None = None, kinds: tuple[str, ...] = ("function", "type", "class"), parts: bool = True, trees: bool = True) -> DataFrame:
    """Units of all files (schema ``UNITS``); a file that does not parse gives one row of kind ``error``.

    ``kinds`` names the units wanted; ``parts`` says whether functions carry the subtrees that overlaps need, ``trees``
    whether they carry the canonical tree, its hash, atoms and statements, which similar functions need.

    Parsing costs far more than moving a text, so the files are spread evenly first, over ``tasks`` tasks (by
    default three a core, or the session's shuffle partitions if those are more).

    A null path takes no part, a null content is an empty file; a path delivered twice is read once per row.
    """
    rows = files.select((path if path is not None else F.col("file_path")).alias("file_path"), (content if content is not None else F.col("content")).alias("content"))
    spark = files.sparkSession
    tasks = tasks or max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.where("file_path is not null").repartition(tasks, F.xxhash64("file_path"))
    return rows.mapInPandas(lambda it: _units(it, literals, kinds, parts, trees), UNITS)


def with_uid(units: DataFrame) -> DataFrame:
    """A stable id, ordered by path and then by place in the file; a map, without a sort or a number line."""
    return units.withColumn("uid", F.concat("file_path", F.lit("\0"), F.lpad(F.col("seq").cast("string"), 9, "0")))
