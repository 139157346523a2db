"""The four modes end to end on small projects, and the kernel against its definition."""

import itertools
import random

import pytest

from twinscan.engine import analyze
from twinscan.operators.edit_distance import BEYOND, Flat, distance, lower_bound, rename_cost
from twinscan.operators.functions_mode import permuted
from twinscan.operators.overlap_mode import weight_windows
from twinscan.options import Options
from twinscan.ts.units import DIRECTIVE

LOAD = """export async function loadAccount(id: string, cache: Map<string, Account>) {
  const known = cache.get(id);
  if (known !== undefined) {
    return known;
  }
  const response = await request(`/accounts/${id}`);
  if (!response.ok) {
    throw new Error('not found');
  }
  const account = parseAccount(response.body);
  cache.set(id, account);
  return account;
}
"""
FETCH = """const fetchProfile = async (key: string, store: Map<string, Account>) => {
  const hit = store.get(key);
  if (hit !== undefined) { return hit; }
  const answer = await request('/accounts/' + key);
  if (!answer.ok) throw new Error('not found');
  const value = parseAccount(answer.body);
  store.set(key, value);
  return value;
};
"""
OTHER = """export function total(items: Item[], rate: number) {
  let sum = 0;
  for (const item of items) {
    sum += item.price * rate;
  }
  while (sum > 1000) {
    sum = discount(sum);
  }
  return Math.round(sum);
}
"""
TYPES = "export interface User { id: string; name: string; email?: string; tags: Array<string> }\n"
TWINS = "type Person = { tags: string[]; email: string | undefined; name: string; id: string };\ninterface Point { x: number; y: number }\n"
STORE = "export class UserStore {\n  private items: Map<string, User> = new Map();\n  get(id: string): User { const x = this.items.get(id); if (!x) { throw new Error('none'); } return x; }\n  put(id: string, v: User): void { this.items.set(id, v); }\n}\n"
SHELF = "export class OrderStore {\n  private items: Map<string, Order> = new Map();\n  get(key: string): Order { const r = this.items.get(key); if (!r) { throw new Error('none'); } return r; }\n  put(key: string, v: Order): void { this.items.set(key, v); }\n}\n"


def run(spark, files, **kw):
    result = analyze(spark.createDataFrame(list(files.items()), "file_path string, content string"), Options(**kw))
    return [r.asDict(True) for r in result.ranked().collect()], result


def names(rows, mode):
    return {tuple(sorted((r["left_loc"]["symbol_name"], r["right_loc"]["symbol_name"]))) for r in rows if r["mode"] == mode}


def test_twins_are_found_across_files(spark):
    files = {"a.ts": LOAD + TYPES + STORE, "b.ts": FETCH + TWINS + SHELF, "c.ts": OTHER, "bad.ts": "function ("}
    rows, result = run(spark, files)
    assert ("fetchProfile", "loadAccount") in names(rows, "functions")
    assert not any("total" in n for n in names(rows, "functions"))
    assert names(rows, "types") == {("Person", "User")}
    assert names(rows, "classes") == {("OrderStore", "UserStore")}
    assert [r["file_path"] for r in result.skipped.collect()] == ["bad.ts"]
    counts = result.counts().first()
    assert counts["file_count"] == 3 and counts["pair_count"] == len(rows)
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    twin = next(r for r in rows if r["mode"] == "functions" and r["left_loc"]["symbol_name"] == "loadAccount")
    assert twin["left_loc"]["start_line"] == 1 and twin["left_loc"]["end_line"] == 13 and twin["details"]["impact"] == 9


def test_scope_gates_and_ignore(spark):
    files = {"a.ts": LOAD, "b.ts": f"// {DIRECTIVE}\n" + FETCH}
    assert not names(run(spark, files, modes=("functions",))[0], "functions")
    files = {"a.ts": LOAD, "b.ts": FETCH}
    assert not names(run(spark, files, modes=("functions",), same_file_only=True)[0], "functions")
    assert names(run(spark, {"a.ts": LOAD + FETCH}, modes=("functions",), same_file_only=True)[0], "functions")
    assert not names(run(spark, files, modes=("functions",), min_lines=20)[0], "functions")
    assert not names(run(spark, files, modes=("functions",), min_tokens=5000)[0], "functions")
    nested = {"a.ts": "function outer() {\n  function inner() {\n    a();\n    b();\n  }\n  inner();\n}\n"}
    assert not names(run(spark, nested, modes=("functions",), threshold=0.1)[0], "functions")


def test_different_functions_stay_apart(spark):
    other = LOAD.replace("loadAccount", "readAccount").replace("cache.set(id, account)", "cache.delete(id)")
    rows, _ = run(spark, {"a.ts": LOAD, "b.ts": other}, modes=("functions",), threshold=0.8)
    assert not names(rows, "functions")
    a = "function f(xs) {\n  start();\n  const a = load(xs);\n  log(a);\n  save(a);\n  use(xs, a);\n  stop();\n  more(a, xs);\n  end();\n  again(xs);\n}\n"
    b = a.replace("log(a);\n  save(a);", "save(a);\n  log(a);").replace("function f", "function g")
    rows, _ = run(spark, {"a.ts": a, "b.ts": b}, modes=("functions",), threshold=0.3)
    assert rows and rows[0]["score"] < 0.9


def test_overlap_of_a_shared_block(spark):
    block = "  const clean = input.trim().toLowerCase();\n  if (clean.length === 0 || clean.length > 40) {\n    throw new RangeError('bad length: ' + clean.length);\n  }\n"
    a = f"function first(input) {{\n{block}  return save(clean, 1);\n}}\n"
    b = f"function second(input, other) {{\n  audit(other);\n  notify(other.name, other.id);\n{block}  return drop(other, clean);\n}}\n"
    rows, _ = run(spark, {"a.ts": a, "b.ts": b}, modes=("overlap",))
    assert rows and {r["mode"] for r in rows} == {"overlap"}
    assert any(r["left_loc"]["start_line"] >= 2 and r["right_loc"]["start_line"] >= 4 for r in rows)
    for x, y in itertools.permutations(rows, 2):  # none lies within another
        assert not all(y[s]["start_line"] <= x[s]["start_line"] and x[s]["end_line"] <= y[s]["end_line"] for s in ("left_loc", "right_loc"))


def test_empty_project(spark):
    rows, result = run(spark, {})
    assert rows == [] and result.counts().first()["file_count"] == 0


def test_options_are_checked():
    for bad in ({"modes": ("x",)}, {"modes": ()}, {"threshold": 2}, {"min_lines": 0}, {"same_file_only": True, "cross_file_only": True}, {"types_only": "x"}, {"overlap_min_window": 9, "overlap_max_window": 8}, {"overlap_size_tolerance": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


# The kernel.


def tree(rng, n):
    labels, kinds, kids = [], [], []

    def grow(left):
        labels.append(rng.choice("abc"))
        kinds.append(rng.choice(["Identifier", "CallExpression"]))
        at, left = len(kids), left - 1
        kids.append(0)
        while left > 0 and rng.random() < 0.8:
            take = rng.randrange(1, left + 1)
            kids[at] += 1
            grow(take)
            left -= take

    grow(n)
    return Flat(labels, kinds, kids)


def plain(a, b, i=0, j=0):
    cost = rename_cost(a.labels[i], a.kinds[i], b.labels[j], b.kinds[j])
    p, q = a.children[i], b.children[j]
    if not p and not q:
        return cost

    def align(x, y):
        if x == len(p):
            return sum(b.size[k] for k in q[y:])
        if y == len(q):
            return sum(a.size[k] for k in p[x:])
        return min(a.size[p[x]] + align(x + 1, y), b.size[q[y]] + align(x, y + 1), plain(a, b, p[x], q[y]) + align(x + 1, y + 1))

    return min(a.size[i] + b.size[j], cost + align(0, 0))


def test_distance_equals_its_definition_and_bounds():
    rng = random.Random(1)
    for _ in range(300):
        a, b = tree(rng, rng.randrange(1, 8)), tree(rng, rng.randrange(1, 8))
        d = distance(a, b)
        assert abs(d - plain(a, b)) < 1e-9 and abs(d - distance(b, a)) < 1e-9
        assert lower_bound(a, b) <= d + 1e-9 and distance(a, a) == 0
        assert distance(a, b, d + 1e-9) == d and (d == 0 or distance(a, b, d - 1e-6) == BEYOND)


def test_rename_costs():
    assert rename_cost("x", "Identifier", "y", "Identifier") == 0.3
    assert rename_cost("map", "Identifier", "filter", "Identifier") == pytest.approx(1.98)
    assert rename_cost("Addition", "BinaryExpression", "Subtraction", "BinaryExpression") == 0.6
    assert rename_cost("x", "Identifier", "x", "CallExpression") == pytest.approx(0.9)


def test_permuted_statements_that_depend_on_each_other():
    a, b, c = ("1", {"x"}), ("2", {"x"}), ("3", {"y"})
    assert permuted([a, b], [b, a]) and not permuted([a, c], [c, a]) and not permuted([a, b], [a, b]) and not permuted([a, b], [a, c])


def test_weight_windows_equal_one_pass_per_size():
    rng = random.Random(2)
    for _ in range(50):
        items = sorted((rng.randrange(9), 9, rng.randrange(1, 6), str(k)) for k in range(rng.randrange(0, 9)))
        want = set()
        for size in range(4, 9):
            for i in range(len(items)):
                weight = 0
                for j in range(i, len(items)):
                    weight += items[j][2]
                    if weight >= size:
                        want.add((size, weight, tuple(x[3] for x in items[i : j + 1])))
                        break
        got = {(size, w[2], tuple(x[3] for x in items[w[0] : w[1] + 1])) for w in weight_windows([x[2] for x in items], 4, 8) for size in range(w[3], w[4] + 1)}
        assert got == want


def test_function_candidates_equal_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tests.test_overlap import sources
    from twinscan.operators import functions_mode as M
    from twinscan.operators.extract import extract_units, with_uid

    rows = list(sources().items()) + [("e.ts", "".join(f"function e{i}(a) {{\n{'  ;' * i}\n\n}}\n" for i in range(6)))]
    units = with_uid(extract_units(spark.createDataFrame(rows, "file_path string, content string"), kinds=("function",), parts=False)).cache()
    result = lambda t: {(r["l"], r["r"]): round(r["score"], 9) for r in M.similar_functions(units, t).collect()}
    got = {t: result(t) for t in (0.5, 0.8, 0.9)}
    every = lambda trees, threshold: M._with_trees(trees.select(F.col("tree_hash").alias("l")).join(trees.select(F.col("tree_hash").alias("r")), F.col("l") < F.col("r")), trees)
    monkeypatch.setattr(M, "_candidates", every)
    monkeypatch.setattr(M, "distance", lambda a, b, budget=None: distance(a, b))
    assert got == {t: result(t) for t in got} and len(got[0.8]) > 5


def test_one_text_raises_if_it_does_not_parse(spark):
    from twinscan.operators.functions_mode import similar_functions_in_file
    from twinscan.ts.parse import ParseError

    twin = LOAD.replace("loadAccount", "again")
    assert similar_functions_in_file(spark, "a.ts", LOAD + twin).count() == 1
    with pytest.raises(ParseError):
        similar_functions_in_file(spark, "a.ts", "function (")


def test_labelled_corpus_has_no_errors(spark):
    from twinscan.corpus import cases, verdicts

    rows = verdicts(spark).collect()
    assert len(rows) == len(list(cases())) > 150
    assert [(r["case_id"], r["found"]) for r in rows if r["found"] != r["expected"]] == []
