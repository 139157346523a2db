"""Similar types: interfaces, aliases and type literals matched property by property."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions import likeness as S
from twinscan.functions.type_text import normal_type, parts, property_likeness, type_likeness
from twinscan.operators.pairs import band_pairs, greedy_matching, overlap_pairs, scope_condition, spread
from twinscan.plans.scratch import cut

SHAPE = "uid {id}, names array<string>, types array<string>, optional array<boolean>, tokens array<string>"
MATCH = "l {id}, r {id}, matched int, quality_sum double, name_sum double"


def shape(properties: list[tuple[str, str, bool]]) -> tuple[list[str], list[str], list[bool]]:
    """Names in order, normal types and optionality of a type's properties; a repeated name keeps the last.

    A top-level ``undefined`` in a union makes the property optional and goes.
    """
    kept: dict[str, tuple[str, bool]] = {}
    optional_names: set[str] = set()
    for name, annotation, optional in properties:
        name, text = name.strip(), normal_type(annotation)
        members = parts(text, "|")
        if len(members) > 1 and "undefined" in members:
            rest = [m for m in members if m != "undefined"]
            if rest:
                text, optional = " | ".join(rest), True
        if optional:
            optional_names.add(name)
        kept[name] = (text, name in optional_names)
    names = sorted(kept)
    return names, [kept[n][0] for n in names], [kept[n][1] for n in names]


def matches(a: tuple, b: tuple) -> list[tuple[str, str, float, float]]:
    """Matched properties as (name, name, name likeness, quality).

    Equal names first, by type likeness; then leftovers of equal type, each in order of name with the most
    similar name still free, at 0.95. Index signatures match by name only. Unequal optionality halves.
    """
    n1, t1, o1 = a
    other = {n: (t, o) for n, t, o in zip(*b)}
    out, free = [], dict(other)
    left = []
    for n, t, o in zip(n1, t1, o1):
        if n in other:
            t2, o2 = free.pop(n)
            out.append((n, n, 1.0, type_likeness(t, t2) * (1.0 if o == o2 else 0.5)))
        elif not n.startswith("["):
            left.append((n, t, o))
    free = {n: x for n, x in sorted(free.items()) if not n.startswith("[")}
    for n, t, o in left:
        alike = [m for m, (t2, _) in free.items() if t2 == t]
        if alike:
            best = max(alike, key=lambda m: property_likeness(n, m))  # the first of equals
            o2 = free.pop(best)[1]
            out.append((n, best, property_likeness(n, best), 0.95 * (1.0 if o == o2 else 0.5)))
    return out


def differences(a: tuple, b: tuple) -> dict[str, list]:
    """What separates two shapes: missing, extra, types that differ and optionality that differs."""
    met = matches(a, b)
    x, y = ({n: (t, o) for n, t, o in zip(*s)} for s in (a, b))
    return {
        "missing": sorted(set(x) - {m[0] for m in met}),
        "extra": sorted(set(y) - {m[1] for m in met}),
        "types": [(p, x[p][0], y[q][0]) for p, q, _, _ in met if x[p][0] != y[q][0]],
        "optionality": [(p, q) for p, q, _, _ in met if x[p][1] != y[q][1]],
    }


def tokens(names: list[str], types: list[str]) -> list[str]:
    """What a match shares: the name, or the type (the k-th property of a type has a token of its own)."""
    seen: dict[str, int] = {}
    for t in types:
        seen[t] = seen.get(t, 0) + 1
    return [f"n:{n}" for n in names] + [f"t:{t}#{k}" for t, n in seen.items() for k in range(n)]


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uid, props in zip(batch["uid"], batch["properties"]):
            s = shape([(p["name"] or "", p["type_annotation"] or "", bool(p["optional"])) for p in (props if props is not None else [])])
            rows.append((uid, *s, tokens(s[0], s[1])))
        yield pd.DataFrame(rows, columns=["uid", "names", "types", "optional", "tokens"])


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for l, r, *x in batch.itertuples(index=False, name=None):
            met = matches(tuple(map(list, x[:3])), tuple(map(list, x[3:])))
            rows.append((l, r, len(met), float(sum(m[3] for m in met)), float(sum(m[2] for m in met))))
        yield pd.DataFrame(rows, columns=["l", "r", "matched", "quality_sum", "name_sum"])


def similar_types(units: DataFrame, threshold: float = 0.8, scope: str = "all", kinds: str = "all", allow_cross_kind: bool = True) -> DataFrame:
    """Pairs of types at or above ``threshold``: l, r (uid), score, structural_score, naming_score.

    ``units``: uid, file_path, name, kind, has_ignore, properties. Ignored units, two units of one name and
    file, and pairs out of scope take no part; ``kinds`` keeps interfaces, types or all. With cross-kind
    comparison off, pairs of different kinds score 0. A null name is empty, null properties are none.

    A score needs a structure of (threshold - 0.15) / 0.85, hence that share of matched properties, and
    a match shares its name or its type: such pairs come from a join on their rarest shared names and
    types. Types without properties can only match each other, by name length band.
    """
    if kinds not in ("all", "interface", "type"):
        raise ValueError("kinds must be all, interface or type")
    rows = units.where(~F.coalesce("has_ignore", F.lit(False)))
    if kinds != "all":
        rows = rows.where(F.col("kind") == kinds)
    shapes, info = _prepared(rows)
    out = _compared(shapes, info, threshold, allow_cross_kind=allow_cross_kind)
    out = out.where(scope_condition(scope, F.col("lfile"), F.col("rfile")) & ~((F.col("lfile") == F.col("rfile")) & (F.col("lname") == F.col("rname"))))
    return out.select("l", "r", "score", "structural_score", "naming_score")


def _prepared(rows: DataFrame, side: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Written shapes and the names, files, kinds, lines and side (0 for all, or one of two) of types."""
    id_type = rows.schema["uid"].dataType.simpleString()
    lines = [F.col(c) if c in rows.columns else F.lit(None).cast("int").alias(c) for c in ("start_line", "end_line")]
    rows = rows.select("uid", "file_path", F.coalesce("name", F.lit("")).alias("name"), "kind", *lines, "properties", (side if side is not None else F.lit(0)).cast("int").alias("side"))
    shapes = cut(rows.select("uid", "properties").mapInPandas(_shapes, SHAPE.format(id=id_type)), "shapes")
    return shapes, rows.drop("properties")


def _compared(shapes: DataFrame, info: DataFrame, threshold: float, allow_cross_kind: bool = True, sides: bool = False) -> DataFrame:
    """Scored pairs at or above the threshold, of different sides only if ``sides``: l, r, score..., lname, lfile, llines, rname..."""
    id_type = info.schema["uid"].dataType.simpleString()
    least = max(0.0, (threshold - 0.15) / 0.85)
    other = (F.col("l.side") != F.col("r.side")) if sides else None
    # Every match shares a token, so too few shared tokens cannot reach the structure; told by hashes where tokens meet.
    enough = F.size(F.array_intersect("l.hashes", "r.hashes")) >= least * (F.col("l.n") + F.col("r.n")) / 4 - 1e-9
    held = shapes.select("uid", F.explode("tokens").alias("token"))
    # Of the 2 n name and type tokens of a unit at least the matched number is shared: half the share.
    hashes = F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")
    sizes = shapes.select("uid", (2 * F.size("names")).alias("n"), hashes).where("n > 0").join(info.select("uid", "side"), "uid")
    # No more properties match than the smaller type has, so sizes differ less than shares of tokens would allow.
    pairs = overlap_pairs(held, sizes, least / 2, least / (2 - least), enough & other if sides else enough)
    names = info.select("uid", "name", "side").join(shapes.select("uid", (F.size("names") == 0).alias("bare")), "uid")
    pairs = pairs.unionByName(_named_pairs(names.where("bare"), (threshold - 0.51) / 0.49, other))
    if least == 0:  # types that match in nothing, or of which one is bare, still score 0.15 of their names' likeness
        pairs = pairs.unionByName(_named_pairs(names, threshold / 0.15, other)).distinct()

    a, b = shapes.toDF("l", "ln", "lt", "lo", "lk"), shapes.toDF("r", "rn", "rt", "ro", "rk")
    met = spread(pairs).join(a, "l").join(b, "r").select("l", "r", "ln", "lt", "lo", "rn", "rt", "ro").mapInPandas(_scored, MATCH.format(id=id_type))
    lines = F.struct("start_line", "end_line")
    side = shapes.select("uid", F.size("names").alias("p")).join(info, "uid").select("uid", "p", "file_path", "name", "kind", lines.alias("lines"))
    out = met.join(side.toDF("l", "p1", "lfile", "lname", "lkind", "llines"), "l").join(side.toDF("r", "p2", "rfile", "rname", "rkind", "rlines"), "r")
    alike = S.property_name_likeness(F.col("lname"), F.col("rname"))
    structure = S.type_structure(F.col("quality_sum"), F.col("matched"), F.col("p1"), F.col("p2"), alike)
    naming = S.type_naming(F.col("name_sum"), F.col("matched"), alike)
    if not allow_cross_kind:
        same = F.col("lkind") == F.col("rkind")
        structure, naming = F.when(same, structure).otherwise(0.0), F.when(same, naming).otherwise(0.0)
    out = out.withColumns({"structural_score": structure, "naming_score": naming})
    return out.withColumn("score", S.weighted(F.col("structural_score"), F.col("naming_score"))).where(F.col("score") >= threshold)


def duplicate_types(units: DataFrame, threshold: float = 0.8, **kw) -> DataFrame:
    """Similar types at 0.9 or the threshold, whichever is higher."""
    return similar_types(units, max(threshold, 0.9), **kw)


def similar_type_literals(units: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Type literals like a named type: literal, definition (uid), score, structural_score, naming_score.

    ``units`` as of ``similar_types`` with start_line and end_line. A literal and a definition of one file whose
    lines overlap are one text and make no pair; neither names nor the ignore directive exclude any. Only pairs of a
    literal and a definition are proposed.
    """
    shapes, info = _prepared(units, (F.col("kind") == "typeLiteral").cast("int"))
    pairs = _compared(shapes, info, threshold, sides=True)
    apart = (F.col("lfile") != F.col("rfile")) | (F.col("llines.end_line") < F.col("rlines.start_line")) | (F.col("rlines.end_line") < F.col("llines.start_line"))
    first = F.col("lkind") == "typeLiteral"
    ends = F.when(first, F.col("l")).otherwise(F.col("r")).alias("literal"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("definition")
    return pairs.where(apart).select(*ends, "score", "structural_score", "naming_score")


def similar_literal_pairs(units: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of type literals like each other: l, r (uid), score, structural_score, naming_score."""
    return similar_types(units.where(F.col("kind") == "typeLiteral"), threshold)


def _named_pairs(rows: DataFrame, need: float, residual: Column | None) -> DataFrame:
    """Pairs of types whose names' likeness is at least ``need``: two without properties score 0.51 + 0.49 of it."""
    need = min(1.0, max(0.0, need))
    rows = rows.select("uid", "name", "side", F.octet_length("name").alias("n"))
    close = S.property_name_likeness(F.col("l.name"), F.col("r.name")) >= need - 1e-9
    # Names equal but for blanks may differ in length, so only a loose band is safe.
    pairs = band_pairs(rows, "uid", "n", need / 2, close & residual if residual is not None else close)
    return pairs.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"))


def type_groups(pairs: DataFrame) -> DataFrame:
    """Groups of similar types, best pairs first, no type in two groups: so each holds two types (l, r, score)."""
    return greedy_matching(pairs)


def type_signatures(units: DataFrame) -> DataFrame:
    """uid, signature: the normal properties in order of name, with readonly and ? marks.

    A property declared twice keeps its last type; a mark on any of the declarations counts.
    """
    id_type = units.schema["uid"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, props in zip(batch["uid"], batch["properties"]):
                props = list(props) if props is not None else []
                fixed = {(p["name"] or "").strip() for p in props if p["readonly"]}
                kept = zip(*shape([(p["name"] or "", p["type_annotation"] or "", bool(p["optional"])) for p in props]))
                out.append((uid, "{ " + "; ".join(f"{'readonly ' if n in fixed else ''}{n}{'?' if o else ''}: {t}" for n, t, o in kept) + " }"))
            yield pd.DataFrame(out, columns=["uid", "signature"])

    return units.select("uid", "properties").mapInPandas(rows, f"uid {id_type}, signature string")
