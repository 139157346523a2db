"""Partial overlaps: parts of functions that occur in other functions.

Pass one is an equality join on the hashes of natural subtrees. Pass two compares sliding windows of the left
function's subtrees with the right one's subtrees by the Jaccard index of their child hashes. It works on distinct
windows and distinct subtrees, which meet by one of their rarest hashes (a prefix filter), and only the matches
are spread to the functions. Ranking and containment are windows and an anti-join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscan.functions import likeness as S
from twinscan.operators.edit_distance import Flat, distance
from twinscan.operators.extract import extract_units, with_uid
from twinscan.operators.pairs import salted_join, scope_condition, spread, without_contained
from twinscan.plans.scratch import cut, release

WINDOW = "key long, uid {id}, start_line int, end_line int, weight int, low int, high int, hashes array<long>, prefix array<long>"
EPS = 1e-9


def weight_windows(weights: list[int], low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows over items in order of their start: for each first item and each size from ``low`` to ``high``, the
    shortest run that weighs at least the size.

    Yields (first item, last item, weight, least size served, greatest size served). Items of all depths take
    part, so a parent and its children both add weight.
    """
    for i in range(len(weights)):
        weight, served = 0, low - 1
        for j in range(i, len(weights)):
            weight += weights[j]
            if weight > served:
                yield i, j, weight, served + 1, min(weight, high)
                served = weight
            if served >= high:
                break


def _windows(batches: Iterator[pd.DataFrame], low: int, high: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Windows that may reach the threshold; a batch gives the hashes of equal windows once."""
    names = [x.split()[0] for x in WINDOW.split(", ")]
    need = [max(1, math.ceil(threshold * m - EPS)) for m in range(high + 2)]  # by distinct hashes; a window has no more than ``high`` items
    for batch in batches:
        rows, known = [], set()
        for uid, first, last, weights, hashes, frequency, indexed in zip(*(batch[c] for c in ("uid", "first", "last", "weights", "hashes", "df", "indexed"))):
            own, place = np.unique(hashes, return_inverse=True)
            df, usable = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            df[place], usable[place] = frequency, np.asarray(indexed) > 0
            order = np.lexsort((own, df))  # rarest first, as the subtrees' hashes are ranked
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own))
            ranks, usable, unheld = rank[place].tolist(), usable[order].tolist(), int((df == 0).sum())  # ranks below ``unheld`` are in no subtree
            at, upto, seen, missing = -1, -1, set(), 0
            for i, j, weight, least, most in weight_windows(weights.tolist(), low, high):
                if i != at:
                    at, upto, seen, missing = i, i - 1, set(), 0
                for r in ranks[upto + 1 : j + 1]:
                    if r not in seen:
                        seen.add(r)
                        missing += r < unheld
                upto = j
                spare = len(seen) - need[len(seen)]
                if missing > spare or not any(usable[r] for r in sorted(seen)[: spare + 1]):
                    continue
                held = sorted(hashes[i : j + 1].tolist())
                digest = blake2b(np.array([least, most, *held], np.int64).tobytes(), digest_size=8).digest()
                key = int.from_bytes(digest, "little", signed=True)
                new = key not in known
                known.add(key)
                prefix = [int(own[order[r]]) for r in sorted(seen)[: spare + 1] if usable[r]] if new else None
                rows.append((key, uid, first[i], last[j], weight, least, most, held if new else None, prefix))
        yield pd.DataFrame(rows, columns=names)


def _items(natural: DataFrame, df: Column, indexed: Column) -> DataFrame:
    """The subtrees of every function (bounded by its text) as arrays in order of start and place, for ``_windows``."""
    rows = natural.select("uid", F.struct("start_line", "pos", "end_line", "weight", "hash", df.cast("long").alias("df"), indexed.cast("long").alias("indexed")).alias("t"))
    rows = rows.groupBy("uid").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("uid", *(F.col(f"t.{a}").alias(b) for a, b in (("start_line", "first"), ("end_line", "last"), ("weight", "weights"), ("hash", "hashes"), ("df", "df"), ("indexed", "indexed"))))


def shared_parts(parts: DataFrame, key: str = "hash", uid: str = "uid") -> DataFrame:
    """Pairs of parts of equal ``key`` in two units: l and r (all columns of the part), l's unit before r's.

    The pairs are the result, so a key on many units gives many; hot keys are split over tasks.
    """
    whole = F.struct(*parts.columns)
    a = parts.select(key, whole.alias("l"))
    b = parts.select(key, whole.alias("r"))
    return salted_join(a, b, [key]).where(F.col(f"l.{uid}") < F.col(f"r.{uid}")).select("l", "r")


def multiplicity(parts: DataFrame, key: str = "hash", uid: str = "uid", pairs_per_task: int = 500_000) -> DataFrame:
    """Number of distinct keys two units share: l, r (unit ids), shared.

    Every part moves once, to the units of its key; keys of the same units become one row with their number. Units
    fall into blocks by hash, and a task gets all rows of a pair of blocks, cut to these: it makes the pairs and counts
    them, so that none moves. The result may grow as the square of the units, and with it the number of blocks.
    """
    held = parts.select(F.col(key).alias("key"), F.col(uid).alias("unit")).where("key is not null and unit is not null")
    sets = held.repartition("key").groupBy("key").agg(F.sort_array(F.collect_set("unit")).alias("units")).where(F.size("units") > 1)
    sets = cut(sets.groupBy("units").agg(F.count(F.lit(1)).alias("keys")), "sharing")
    n = F.size("units").cast("double")
    blocks = max(1, math.ceil(math.sqrt(2 * (sets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) / pairs_per_task)))  # one number
    block = lambda u: F.pmod(F.xxhash64(u), F.lit(blocks)).cast("int")
    pieces = F.transform(F.array_distinct(F.transform("units", block)), lambda b: F.struct(b.alias("block"), F.filter("units", lambda u: block(u) == b).alias("units")))
    sides = sets.select("keys", pieces.alias("pieces")).select("keys", "pieces", F.explode("pieces").alias("x"))
    sides = sides.select("keys", "x", F.explode(F.filter("pieces", lambda y: y["block"] >= F.col("x.block"))).alias("y"))
    sides = sides.select(F.col("x.block").alias("b1"), F.col("y.block").alias("b2"), "keys", F.col("x.units").alias("x"), F.col("y.units").alias("y"))
    met = sides.repartition(blocks * (blocks + 1) // 2, "b1", "b2").select("b1", "b2", "keys", F.explode("x").alias("u"), "y")
    met = met.select("b1", "b2", "keys", "u", F.explode("y").alias("v")).where((F.col("b1") < F.col("b2")) | (F.col("u") < F.col("v")))
    met = met.groupBy("b1", "b2", F.least("u", "v").alias("l"), F.greatest("u", "v").alias("r")).agg(F.sum("keys").alias("shared"))
    return met.select("l", "r", "shared")


def _loose(natural: DataFrame, id_type: str, threshold: float, low: int, high: int, tolerance: float) -> DataFrame:
    """Pass two: l, r, score, s1, e1, s2, e2, node_count, node_type."""
    # A subtree without children is alike to any window at 0.5, which sizes allow only for windows of a node or two.
    childless = threshold <= 0.5 and low <= 2
    targets = natural.where(F.col("weight").between(int(low * (1 - tolerance)), int(high * (1 + tolerance))))
    shapes = cut(targets.where(F.size("child_hashes") > 0).groupBy("hash").agg(F.first("weight").alias("tw"), F.first("child_hashes").alias("children")), "shapes")
    held = shapes.select("hash", F.explode(F.array_distinct("children")).alias("token"))
    frequency = cut(held.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "frequency")
    order = Window.partitionBy("hash")
    ranked = held.join(frequency, "token").withColumn("place", F.row_number().over(order.orderBy("df", "token"))).withColumn("n", F.count(F.lit(1)).over(order))
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - EPS))
    index = cut(ranked.where(F.col("place") <= F.col("n") - need + 1).select("token", "hash", "n"), "index")
    known = frequency.join(index.groupBy("token").agg(F.count(F.lit(1)).alias("indexed")), "token", "left")

    items = natural.select("uid", "pos", "start_line", "end_line", "weight", "hash").join(known.withColumnRenamed("token", "hash"), "hash", "left")
    items = _items(items, F.coalesce("df", F.lit(0)), F.coalesce("indexed", F.lit(0)))
    schema = WINDOW.format(id=id_type)
    windows = cut(spread(items).mapInPandas(lambda it: _windows(it, low, high, threshold), schema), "windows")
    release(frequency)

    classes = windows.where("hashes is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("weight", "low", "high", "hashes", "prefix")))
    w = classes.select("key", "weight", "low", "high", F.size(F.array_distinct("hashes")).alias("m"), F.explode("prefix").alias("token"))
    t = index.join(shapes.select("hash", "tw"), "hash")
    tw, ww = F.col("tw"), F.col("weight")
    near = (tw >= F.floor(F.col("low") * (1 - tolerance))) & (tw <= F.floor(F.col("high") * (1 + tolerance))) & (ww / tw).between(1 - tolerance, 1 + tolerance)
    sizes = F.least("m", "n") >= F.lit(threshold) * F.greatest("m", "n") - EPS
    met = salted_join(w, t, ["token"]).where(near & sizes).select("key", "hash").distinct()
    x, y = F.col("hashes"), F.col("children")
    enough = F.size(F.filter(x, lambda h: F.array_contains(y, h))) / F.least(F.size(x), F.size(y)) > 0.5
    met = met.join(classes.select("key", "weight", "hashes"), "key").join(shapes, "hash").where(enough & (S.jaccard(x, y) >= threshold))
    met = cut(met.select("key", "hash", S.jaccard(x, y).alias("score")), "matches")
    release(index)
    release(shapes)
    # Their hashes have been met, and only the windows that matched are wanted from here on.
    found = windows.select("key", "uid", "start_line", "end_line", "weight").join(met.select("key").distinct(), "key", "left_semi")
    found = cut(found.distinct(), "found")
    release(windows)

    # A window class meets few subtrees, so adaptive execution can split the windows of a hot one.
    left = found.select("key", F.col("uid").alias("l"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"), F.col("weight").alias("node_count")).join(met, "key")
    right = targets.select("hash", F.col("uid").alias("r"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"), "node_type").distinct()
    columns = ["l", "r", "score", "s1", "e1", "s2", "e2", "node_count", "node_type"]
    out = salted_join(left.distinct(), right, ["hash"]).where("l < r").select(columns)
    if childless:
        leaves = targets.where(F.size("child_hashes") == 0).select(F.col("weight").alias("tw"), F.col("uid").alias("r"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"), "node_type").distinct()
        every = _items(natural, F.lit(1), F.lit(1)).mapInPandas(lambda it: _windows(it, low, high, 0.0), schema).where(F.col("weight") <= 1 + tolerance)
        every = every.select(F.col("uid").alias("l"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"), F.col("weight").alias("node_count"), F.col("low"), F.col("high"), F.lit(1).alias("tw")).distinct()
        fits = (F.col("tw") >= F.floor(F.col("low") * (1 - tolerance))) & (F.col("tw") <= F.floor(F.col("high") * (1 + tolerance))) & (F.col("node_count") / F.col("tw")).between(1 - tolerance, 1 + tolerance)
        both = salted_join(every, leaves, ["tw"]).where(fits & (F.col("l") < F.col("r"))).withColumn("score", F.lit(0.5))
        out = out.unionByName(both.select(columns))
    return out.distinct()


def overlaps(units: DataFrame, threshold: float = 0.8, scope: str = "all", min_window: int = 8, max_window: int = 30, tolerance: float = 0.2) -> DataFrame:
    """Overlaps of function pairs: l, r (uid), score, s1, e1, s2, e2 (lines), node_count, node_type.

    ``units`` as of ``extract_units`` with uid. Functions whose lines do not parse alone (methods) take no
    part, nor do pairs of which one lies in the other. An overlap whose two ranges lie in those of a better one of
    the same pair is dropped.

    A Jaccard index of t between two sets needs ceil(t * n) of either set in common, so each holds a shared hash
    among its n - ceil(t * n) + 1 rarest: distinct windows and subtrees meet by those only. Hashes are compared
    by 64 bits.
    """
    f = units.where((F.col("unit_kind") == "function") & F.col("fn.subtrees").isNotNull())
    f = f.select("uid", "file_path", "start_line", "end_line", F.col("fn.subtrees").alias("subtrees"))
    total = F.aggregate("subtrees", F.lit(1), lambda acc, t: acc + F.when(t["depth"] == 1, t["weight"]).otherwise(0))
    info = f.select("uid", "file_path", "start_line", "end_line", total.alias("total"))
    natural = f.select("uid", F.posexplode("subtrees").alias("pos", "t")).select("uid", "pos", "t.*")
    sized = natural.where(F.col("weight").between(min_window, max_window)).select("uid", "hash", "start_line", "end_line", "weight", "node_type")

    exact = shared_parts(sized).select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"), F.lit(1.0).alias("score"), *_lines("l", "1"), *_lines("r", "2"), F.col("l.weight").alias("node_count"), F.col("r.node_type").alias("node_type"))
    if min_window < 8:
        many = multiplicity(sized).select("l", "r", (F.col("shared") >= 3).alias("many"))
        exact = exact.join(many, ["l", "r"])
    else:  # only smaller parts need company
        exact = exact.withColumn("many", F.lit(False))
    exact = _placed(exact, info, scope).where(_kept(F.col("many"))).drop("many")

    loose = _loose(natural, units.schema["uid"].dataType.simpleString(), threshold, min_window, max_window, tolerance)
    loose = _placed(loose, info, scope).where(_kept(F.lit(False)) | (F.col("score") < 0.999))

    both = exact.unionByName(loose).where(F.col("score") >= threshold).drop("smaller").distinct()
    rank = Window.partitionBy("l", "r").orderBy(F.col("score").desc(), "s1", "e1", "s2", "e2", F.col("node_count").desc(), "node_type")
    ranked = cut(both.withColumn("rank", F.row_number().over(rank)), "ranked")
    return without_contained(ranked, ["l", "r"], "rank").drop("rank")


def _lines(side: str, n: str) -> list[Column]:
    return [F.col(f"{side}.start_line").alias(f"s{n}"), F.col(f"{side}.end_line").alias(f"e{n}")]


def _kept(many: Column) -> Column:
    """A tiny part of two sizeable functions counts only with a quarter of the smaller, or in company."""
    return (F.col("node_count") >= 8) | (F.col("smaller") < 30) | many | (F.col("node_count") / F.col("smaller") >= 0.25)


def _placed(pairs: DataFrame, info: DataFrame, scope: str) -> DataFrame:
    """Pairs in scope and not nested, with lines of the file instead of the function, within the function."""
    a, b = info.toDF("l", "file1", "from1", "to1", "total1"), info.toDF("r", "file2", "from2", "to2", "total2")
    out = pairs.join(a, "l").join(b, "r")
    nested = ((F.col("from1") >= F.col("from2")) & (F.col("to1") <= F.col("to2"))) | ((F.col("from2") >= F.col("from1")) & (F.col("to2") <= F.col("to1")))
    equal = (F.col("from1") == F.col("from2")) & (F.col("to1") == F.col("to2"))
    out = out.where(scope_condition(scope, F.col("file1"), F.col("file2")) & ~((F.col("file1") == F.col("file2")) & nested & ~equal))
    for c, n in (("s1", "1"), ("e1", "1"), ("s2", "2"), ("e2", "2")):
        out = out.withColumn(c, F.least(F.greatest(F.col(c) + F.col(f"from{n}") - 1, F.col(f"from{n}")), F.col(f"to{n}")))
    return out.withColumn("smaller", F.greatest(F.least("total1", "total2"), F.lit(1))).drop("file1", "file2", "from1", "from2", "to1", "to2", "total1", "total2")


# Two texts, and overlaps scored again.


def text_overlaps(spark: SparkSession, source: str, target: str | None = None, **options) -> DataFrame:
    """Overlaps of the functions of two texts, or within one text: the columns of ``overlaps`` with file_path1 and 2.

    Two texts are two files even if they are equal; without ``target`` the pairs lie within the one text. A text
    that does not parse has no overlaps.
    """
    rows = [("source.ts", source)] + ([("target.ts", target)] if target is not None else [])
    units = cut(with_uid(extract_units(spark.createDataFrame(rows, "file_path string, content string"), kinds=("function",), trees=False)), "units")
    found = overlaps(units, scope="same_file" if target is None else "cross_file", **options)
    path = units.select("uid", "file_path")
    return found.join(path.toDF("l", "file_path1"), "l").join(path.toDF("r", "file_path2"), "r")


def code_segment(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, inclusive) of a text; null where the text has fewer lines.

    A line feed at the very end begins no further line; a carriage return before a line feed goes.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    n = F.size(lines) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)
    return F.when((first <= n) & (last <= n), F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), last - F.greatest(first, F.lit(1)) + 1), "\n"))


def _redone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from functools import lru_cache

    from twinscan.ts.parse import ParseError, parse
    from twinscan.ts.tree import literal_tree

    @lru_cache(maxsize=4096)
    def flat(text: str, path: str) -> Flat | None:
        try:
            nodes = list(literal_tree(parse(text, path)).walk())
        except (ParseError, RecursionError):
            return None
        return Flat([n.label for n in nodes], [n.kind for n in nodes], [len(n.kids) for n in nodes])

    for batch in batches:
        rows = []
        for a, b in zip(batch["code1"], batch["code2"]):
            x, y = (flat(a, "source.ts"), flat(b, "target.ts")) if a is not None and b is not None else (None, None)
            rows.append((None, None, None) if x is None or y is None else (distance(x, y), len(x.labels), len(y.labels)))
        yield batch.assign(d=[r[0] for r in rows], n1=[r[1] for r in rows], n2=[r[2] for r in rows]).astype({"d": "float64", "n1": "Int64", "n2": "Int64"})


def rescored(found: DataFrame, files: DataFrame, size_penalty: bool = True) -> DataFrame:
    """Overlaps with ``exact_score``, code1 and code2: those above 0.9 compared again by tree distance.

    ``found`` holds file_path1, file_path2, s1, e1, s2, e2 and score; ``files``(file_path, content) each path once. The
    code of both ranges is cut out and parsed; where a range does not parse alone, and up to 0.9, the
    score stays, and up to 0.9 the code is empty.
    """
    high = F.col("score") > 0.9
    a, b = (files.select(F.col("file_path").alias(f"file_path{n}"), F.col("content").alias(f"t{n}")) for n in "12")
    cutout = {f"code{n}": code_segment(F.col(f"t{n}"), F.col(f"s{n}"), F.col(f"e{n}")) for n in "12"}
    rows = found.where(high).join(a, "file_path1").join(b, "file_path2").withColumns(cutout).drop("t1", "t2")
    codes = cut(rows.select("code1", "code2").distinct(), "codes")
    scored = spread(codes).mapInPandas(_redone, "code1 string, code2 string, d double, n1 long, n2 long")
    exact = scored.select("code1", "code2", F.when(F.col("d").isNotNull() & ~F.isnan("d"), S.edit_likeness(F.col("d"), F.col("n1"), F.col("n2"), size_penalty)).alias("exact_score"))
    exact = cut(exact, "rescored")
    done = rows.join(exact, rows["code1"].eqNullSafe(exact["code1"]) & rows["code2"].eqNullSafe(exact["code2"]), "left").drop(exact["code1"]).drop(exact["code2"])
    done = done.withColumn("exact_score", F.coalesce("exact_score", "score"))
    return done.unionByName(found.where(~high).withColumns({"code1": F.lit(""), "code2": F.lit(""), "exact_score": F.col("score")}))
