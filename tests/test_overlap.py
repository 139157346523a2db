"""Overlap mode against a nested loop over all pairs of functions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinscan.operators.extract import extract_units, with_uid
from twinscan.operators.overlap_mode import code_segment, multiplicity, overlaps, rescored, text_overlaps

LINES = [
    "const {a} = load({b}, 3);", "if ({a} > {b}) {{ return {b}; }}", "for (const x of {a}) {{ {b}.push(x * 2); }}", "save({a}, {b});", "{b} = {a} + 1;",
    "while ({a} < 10) {{ {a} += step({b}); }}", "log('{a}', {b});", "const {b} = [1, 2, {a}].map((v) => v + {b});", "throw new Error({a});", "break_({a});",
]


def sources(n_functions=32, seed=3):
    rng = random.Random(seed)
    blocks = ["\n".join("  " + rng.choice(LINES).format(a=rng.choice("pqrs"), b=rng.choice("tuvw")) for _ in range(rng.randrange(2, 5))) for _ in range(10)]
    files = {}
    for f in range(4):
        out = []
        for k in range(n_functions // 4):
            body = [rng.choice(blocks) if rng.random() < 0.7 else "  " + rng.choice(LINES).format(a="k", b=f"n{f}{k}") for _ in range(rng.randrange(1, 4))]
            inner = "  function inner() {\n    keep(1, 2, 3);\n    return drop(4, 5, 6);\n  }\n" if k == 0 else ""
            out.append(f"function f{f}_{k}(p, q, r, s, t, u, v, w) {{\n{inner}" + "\n".join(body) + "\n}\n")
        files[f"d/f{f}.ts"] = "\n".join(out)
    return files


def nested_loop(units, threshold, low, high, tolerance):
    """The definition: every pair of functions, every window size, every window and subtree."""
    out = set()
    for a, b in itertools.combinations(sorted(units, key=lambda u: u["uid"]), 2):
        inside = lambda x, y: x["start_line"] >= y["start_line"] and x["end_line"] <= y["end_line"]
        lines = lambda u: (u["start_line"], u["end_line"])
        if a["file_path"] == b["file_path"] and (inside(a, b) or inside(b, a)) and lines(a) != lines(b):
            continue
        x, y = a["subtrees"], b["subtrees"]
        smaller = max(1, min(1 + sum(t["weight"] for t in z if t["depth"] == 1) for z in (x, y)))
        place = lambda u, t: tuple(min(max(t[c] + u["start_line"] - 1, u["start_line"]), u["end_line"]) for c in ("start_line", "end_line"))
        natural = [t for t in x if low <= t["weight"] <= high]
        equal = {}
        for t in y:
            if low <= t["weight"] <= high:
                equal.setdefault(t["hash"], []).append(t)
        many = len({t["hash"] for t in natural} & set(equal)) >= 3
        rows = []
        for t in natural:
            for u in equal.get(t["hash"], []):
                if t["weight"] >= 8 or smaller < 30 or many or t["weight"] / smaller >= 0.25:
                    rows.append((1.0, *place(a, t), *place(b, u), t["weight"], u["node_type"]))
        ordered = sorted(x, key=lambda t: t["start_line"])
        for size in range(low, high + 1):
            targets = [t for t in y if int(size * (1 - tolerance)) <= t["weight"] <= int(size * (1 + tolerance))]
            for i in range(len(ordered)):
                weight = 0
                for j in range(i, len(ordered)):
                    weight += ordered[j]["weight"]
                    if weight >= size:
                        break
                else:
                    continue
                hashes = [t["hash"] for t in ordered[i : j + 1]]
                for t in targets:
                    if not 1 - tolerance <= weight / t["weight"] <= 1 + tolerance:
                        continue
                    kids = t["child_hashes"]
                    if kids and sum(h in kids for h in hashes) / min(len(hashes), len(kids)) <= 0.5:
                        continue
                    score = len(set(hashes) & set(kids)) / len(set(hashes) | set(kids)) if kids else 0.5
                    if score < threshold or score >= 0.999 and weight < 8 and smaller >= 30 and weight / smaller < 0.25:
                        continue
                    window = {"start_line": ordered[i]["start_line"], "end_line": ordered[j]["end_line"]}
                    rows.append((score, *place(a, window), *place(b, t), weight, t["node_type"]))
        kept = []
        for r in sorted(set(rows), key=lambda r: (-r[0], r[1:5], -r[5], r[6])):
            if r[0] >= threshold and not any(k[1] <= r[1] and r[2] <= k[2] and k[3] <= r[3] and r[4] <= k[4] for k in kept):
                kept.append(r)
        out |= {(a["uid"], b["uid"], round(r[0], 9), *r[1:]) for r in kept}
    return out


@pytest.fixture(scope="module")
def units(spark):
    df = spark.createDataFrame(list(sources().items()), "file_path string, content string")
    return with_uid(extract_units(df, kinds=("function",))).cache()


@pytest.mark.parametrize(("threshold", "low", "high", "tolerance"), [(0.8, 8, 30, 0.2), (0.4, 8, 30, 0.2), (0.6, 3, 12, 0.3), (0.3, 1, 4, 0.4)])
def test_overlaps_equal_the_nested_loop(units, threshold, low, high, tolerance):
    rows = [r.asDict(True) for r in units.where("unit_kind = 'function'").select("uid", "file_path", "start_line", "end_line", "fn.subtrees").collect()]
    want = nested_loop([r for r in rows if r["subtrees"] is not None], threshold, low, high, tolerance)
    found = overlaps(units, threshold, min_window=low, max_window=high, tolerance=tolerance).collect()
    got = {(r["l"], r["r"], round(r["score"], 9), r["s1"], r["e1"], r["s2"], r["e2"], r["node_count"], r["node_type"]) for r in found}
    assert len(found) == len(got) and len(want) > 30
    assert got == want


def test_two_texts_and_scores_by_distance(spark):
    block = "  const clean = input.trim().toLowerCase();\n  if (clean.length === 0 || clean.length > 40) {\n    throw new RangeError('bad length: ' + clean.length);\n  }\n"
    a = f"function first(input) {{\n{block}  return save(clean, 1);\n}}\n"
    b = f"function second(input, other) {{\n  audit(other);\n{block}  return drop(other, clean);\n}}\n"
    found = text_overlaps(spark, a, b)
    assert found.count() and {r["file_path1"] for r in found.collect()} == {"source.ts"}
    assert text_overlaps(spark, a, a).count()  # equal texts are two files
    assert text_overlaps(spark, a + "\n" + b).where("file_path1 = file_path2").count() and text_overlaps(spark, "function (", b).count() == 0
    files = spark.createDataFrame([("source.ts", a), ("target.ts", b)], "file_path string, content string")
    rows = rescored(found, files).collect()
    whole = [r for r in rows if r["score"] > 0.9 and r["code1"].lstrip().startswith("if") and r["code1"] == r["code2"]]
    assert len(rows) == found.count() and whole and all(r["exact_score"] == 1.0 for r in whole)
    assert all(r["exact_score"] == r["score"] and r["code1"] == "" for r in rows if r["score"] <= 0.9)


def test_code_segments(spark):
    df = spark.createDataFrame([("a\r\nb\nc\n", 2, 3), ("a\nb", 1, 1), ("a\nb", 2, 3), ("", 1, 1), (None, 1, 1)], "t string, s int, e int")
    assert [r[0] for r in df.select(code_segment(F.col("t"), F.col("s"), F.col("e"))).collect()] == ["b\nc", "a", None, None, None]


def test_multiplicity_counts_distinct_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (None, "b")], "uid long, hash string")
    assert {tuple(r) for r in multiplicity(df).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}


def test_overlap_alone_writes_no_trees_and_keeps_no_windows(spark):
    from twinscan.engine import analyze
    from twinscan.options import Options
    from twinscan.plans.scratch import release_all, written

    body = "\n".join(f"  const v{i} = load(a, {i}).map((x) => x + {i});" for i in range(6))
    files = [(f"f{k}.ts", f"export function f{k}(a) {{\n{body}\n  return done{k}(a);\n}}\n") for k in range(3)]
    before = written(spark)
    found = analyze(spark.createDataFrame(files, "file_path string, content string"), Options(modes=("overlap",)))
    assert found.pairs.count() > 0
    names = {p.rsplit("/", 1)[1].split("-")[1] for p in written(spark) - before}
    assert names == {"units", "matches", "found", "ranked"}
    units = found.units.where("unit_kind = 'function'")
    assert units.count() == 3 and units.where("fn.tree is not null or size(fn.value_atoms) > 0 or size(fn.statements) > 0").count() == 0
    assert units.where("fn.subtrees is not null").count() == 3
    release_all(spark, before)
