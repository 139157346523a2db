"""Similar functions: canonical trees compared by edit distance, then capped by what the functions do."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions import likeness as S
from twinscan.operators.edit_distance import BEYOND, Flat, distance
from twinscan.operators.extract import extract_units, with_uid
from twinscan.operators.pairs import band_pairs, scope_condition, spread, subset_pairs
from twinscan.plans.scratch import cut
from twinscan.ts.parse import ParseError

INPUTS = "l string, r string, n1 int, n2 int, d double, control boolean, missing1 int, missing2 int, permuted boolean"


def permuted(a: list[tuple[str, set[str]]], b: list[tuple[str, set[str]]]) -> bool:
    """Whether two bodies hold the same statements with two that share a name in another order."""
    x, y = [h for h, _ in a], [h for h, _ in b]
    if len(x) < 2 or x == y or sorted(x) != sorted(y):
        return False
    places: dict[str, list[int]] = {}
    for i, h in enumerate(y):
        places.setdefault(h, []).append(i)
    at = [places[h].pop(0) for h in x]
    return any(at[i] > at[j] and a[i][1] & a[j][1] for i in range(len(at)) for j in range(i + 1, len(at)))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for t, values, control, counted, rows in zip(batch["tree"], batch["value_atoms"], batch["control_atoms"], batch["counted_atoms"], batch["statements"]):
            tree = (list(t["labels"]), list(t["kinds"]), [int(k) for k in t["kids"]])
            out.append(pickle.dumps((tree, set(values), set(control), dict(counted), [(s["hash"], set(s["names"])) for s in rows])))
        yield batch[["tree_hash", "n", "value_atoms", "control_atoms", "counted_atoms"]].assign(packed=out)


def _compared(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, known = [], {}
        for l, r, p, q in zip(batch["l"], batch["r"], batch["a"], batch["b"]):
            for key, data in ((l, p), (r, q)):
                if key not in known:
                    tree, *rest = pickle.loads(data)
                    known[key] = (Flat(*tree), *rest)
            a, va, ctl1, ca, s1 = known[l]
            b, vb, ctl2, cb, s2 = known[r]
            n1, n2 = len(a.labels), len(b.labels)
            # Penalties only lower a score, so a distance that alone brings it under the threshold ends the pair.
            budget = max(n1, n2) * (1 - threshold) + 1e-9 if threshold > 0 else None
            d = distance(a, b, budget)
            if d == BEYOND:
                continue
            m1 = len(vb - va) + sum(max(0, n - ca.get(k, 0)) for k, n in cb.items())
            m2 = len(va - vb) + sum(max(0, n - cb.get(k, 0)) for k, n in ca.items())
            rows.append((l, r, n1, n2, d, ctl1 != ctl2, m1, m2, permuted(s1, s2)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INPUTS.split(", ")])


def contained(l: str, r: str) -> Column:
    """Whether one of two functions of a file lies inside the other, by lines and by the text it spans."""

    def inside(a: str, b: str) -> Column:
        lines = (F.col(f"{a}.start_line") >= F.col(f"{b}.start_line")) & (F.col(f"{a}.end_line") <= F.col(f"{b}.end_line"))
        s, e = F.col(f"{a}.span.s"), F.col(f"{a}.span.e")
        text = (s >= F.col(f"{b}.span.s")) & (e <= F.col(f"{b}.span.e")) & ((s > F.col(f"{b}.span.s")) | (e < F.col(f"{b}.span.e")))
        return lines & text

    return (F.col(f"{l}.file_path") == F.col(f"{r}.file_path")) & (inside(l, r) | inside(r, l))


def _candidates(trees: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tree classes that may reach the threshold: l, r (tree_hash), a, b (packed)."""
    if threshold <= 0.75:
        near = band_pairs(trees.select("tree_hash", "n"), "tree_hash", "n", max(0.0, threshold))
        return _with_trees(near.select(F.col("l.tree_hash").alias("l"), F.col("r.tree_hash").alias("r")), trees)
    counted = F.flatten(F.transform(F.map_entries("counted_atoms"), lambda e: F.transform(F.sequence(F.lit(1), e["value"]), lambda i: F.concat(F.lit("#"), e["key"], F.lit("#"), i.cast("string")))))
    sets = trees.select(F.col("tree_hash").alias("uid"), F.concat("value_atoms", counted).alias("tokens"), F.array_join(F.array_sort("control_atoms"), " ").alias("control"), "n")
    return _with_trees(subset_pairs(sets, ["control"], "n", threshold), trees)


def _with_trees(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    a, b = trees.select(F.col("tree_hash").alias("l"), F.col("packed").alias("a")), trees.select(F.col("tree_hash").alias("r"), F.col("packed").alias("b"))
    return spread(pairs).join(a, "l").join(b, "r").select("l", "r", "a", "b")


def similar_functions(units: DataFrame, threshold: float = 0.8, scope: str = "all", min_lines: int = 3, min_tokens: int | None = None, size_penalty: bool = True) -> DataFrame:
    """Pairs of functions at or above ``threshold``: l, r (uid), score, impact.

    ``units``: uid, file_path, start_line, end_line, has_ignore and ``fn``. Ignored and too small functions
    and those without a tree take no part; neither does a function paired with one inside it.

    Functions of equal canonical tree form one class. Distances are computed once per pair of classes and spread
    to the members; members of one class need no distance. Everything that depends on lines is a column expression.

    Candidates: a score above 0.75 is only possible with equal control flow and with all operations of one
    function among the other's (any other difference caps it lower), so the classes join by each one's rarest
    operation. Lower thresholds join by bands of tree size, below whose ratio no pair can reach the threshold.
    """
    n = F.size("fn.tree.labels")
    rows = units.where((F.col("unit_kind") == "function") & F.col("fn.tree").isNotNull() & ~F.coalesce("has_ignore", F.lit(False)))
    rows = rows.where(n >= min_tokens) if min_tokens is not None else rows.where(S.line_count(F.col("start_line"), F.col("end_line")) >= min_lines)
    rows = cut(rows.select("uid", "file_path", "start_line", "end_line", n.alias("n"), F.col("fn.body_span").alias("span"), F.col("fn.tree_hash").alias("tree_hash"), "fn"), "functions")
    members = rows.select("uid", "file_path", "start_line", "end_line", "span", "tree_hash", "n")

    keep = ("tree", "tree_hash", "value_atoms", "control_atoms", "counted_atoms", "statements")
    trees = rows.groupBy("tree_hash").agg(F.min_by(F.struct("n", *(F.col(f"fn.{c}").alias(c) for c in keep if c != "tree_hash")), "uid").alias("x")).select("tree_hash", "x.*")
    # Packed once a class: a pair then moves two byte strings, and a task unpacks each tree once a batch.
    trees = cut(trees.mapInPandas(_packed, "tree_hash string, n int, value_atoms array<string>, control_atoms array<string>, counted_atoms map<string,int>, packed binary"), "trees")
    pairs = _candidates(trees, threshold)
    known = pairs.mapInPandas(lambda it: _compared(it, threshold), INPUTS)
    none = F.lit(0)
    alike = trees.select(F.col("tree_hash").alias("l"), F.col("tree_hash").alias("r"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(0.0).alias("d"), F.lit(False).alias("control"), none.alias("missing1"), none.alias("missing2"), F.lit(False).alias("permuted"))
    known = known.unionByName(alike).withColumn("s", S.edit_likeness(F.col("d"), F.col("n1"), F.col("n2"), size_penalty))
    # Written, or the threshold below would be pushed into the formula and outgrow what one method can hold.
    known = cut(known.drop("d", "n1", "n2"), "compared")
    a, b = members.select(F.struct("*").alias("a"), F.col("tree_hash").alias("l")), members.select(F.struct("*").alias("b"), F.col("tree_hash").alias("r"))
    both = known.join(a, "l").join(b, "r").where((F.col("l") != F.col("r")) | (F.col("a.uid") < F.col("b.uid")))
    swap = F.col("a.uid") > F.col("b.uid")
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "s", "control", "missing1", "missing2", "permuted")
    both = both.where(scope_condition(scope, F.col("a.file_path"), F.col("b.file_path")) & ~contained("a", "b"))
    lines1, lines2 = (S.line_count(F.col(f"{s}.start_line"), F.col(f"{s}.end_line")) for s in "ab")
    out = both.select(F.col("a.uid").alias("l"), F.col("b.uid").alias("r"), "s", "control", "missing1", "missing2", "permuted", lines1.alias("lines1"), lines2.alias("lines2"))
    if size_penalty:
        out = out.withColumn("s", S.short_function_factor(F.col("s"), F.col("lines1"), F.col("lines2")))
    out = out.withColumn("s", S.atom_cap(F.col("s"), F.col("control"), F.col("missing1"), F.col("missing2")))
    score = F.when((F.col("s") >= 0.8) & F.col("permuted"), F.col("s") * 0.85).otherwise(F.col("s"))
    return out.select("l", "r", score.alias("score"), S.impact(F.col("lines1"), F.col("lines2")).alias("impact")).where(F.col("score") >= threshold)


def similar_functions_in_file(spark: SparkSession, path: str, text: str, threshold: float = 0.8, **options) -> DataFrame:
    """Pairs of functions of one text: l, r (uid), score, impact; raises ``ParseError`` if it does not parse."""
    files = spark.createDataFrame([(path, text)], "file_path string, content string")
    units = cut(with_uid(extract_units(files, kinds=("function",), parts=False)), "units")
    failed = units.where("unit_kind = 'error'").select("error").first()  # at most one row: there is one file
    if failed:
        raise ParseError(failed["error"])
    return similar_functions(units, threshold, "same_file", **options)
