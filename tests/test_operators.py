"""Core operators on small tables: edge cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinscan.functions import likeness as S
from twinscan.functions.type_text import levenshtein, normal_type, overlap_of_words, plain_likeness, property_likeness, type_likeness
from twinscan.operators.heavy_keys import heavy_keys, key_summaries
from twinscan.operators.pairs import band_pairs, exact_classes, greedy_matching, overlap_pairs, salted_join, scope_condition, subset_pairs, without_contained
from twinscan.operators.types_mode import differences, matches, shape, similar_type_literals, similar_types, type_groups, type_signatures

ROWS = "id long, key string, other string, score double, key_field string, __id int, n_rows long"


def keyed(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS)


def test_key_summaries_and_heavy_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", "o" if i < 50 else None, [0.5, None, float("nan")][i % 3]) for i in range(100)]
    rows += [rows[0], rows[0], (None, "hot", "o", 1.0), (200, None, None, None)]
    df = keyed(spark, rows)
    keys = {"key": F.col("key"), "other": F.col("other")}
    value = F.when(~F.isnan("score"), F.col("score"))
    got = {(r["key_field"], r["key_value"]): r for r in key_summaries(df, F.col("id"), keys, value).collect()}
    hot = got["key", "hot"]
    assert (hot["n_rows"], hot["n_scored"], hot["min_score"], hot["sum_score"], hot["mean_score"]) == (34, 34, 0.5, 17.0, 0.5)
    assert got["other", "o"]["n_rows"] == 50 and got["key", "k1"]["mean_score"] is None and (("key", None) not in got)
    heavy = {(r["key_field"], r["key_value"]): r["share"] for r in heavy_keys(df, F.col("id"), keys, share=0.3).collect()}
    assert heavy == {("key", "hot"): 34 / 101, ("other", "o"): 50 / 101}
    assert key_summaries(df.limit(0), F.col("id"), keys, value).count() == 0 and heavy_keys(df.limit(0), F.col("id"), keys).count() == 0


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.77, 0.8, 1.0])
def test_band_pairs_equal_the_nested_loop(spark, ratio):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, 3, 4, 5, 7, 10, 13, 100, 125]), rng.choice("ab")) for i in range(60)] + [(99, None, "a")]
    df = spark.createDataFrame(rows, "uid long, n long, g string")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows[:-1], 2) if min(a[1], b[1]) >= ratio * max(a[1], b[1])}
    assert {(r["l"]["uid"], r["r"]["uid"]) for r in band_pairs(df, "uid", "n", ratio).collect()} == want
    keyed_pairs = {(r["l"]["uid"], r["r"]["uid"]) for r in band_pairs(df, "uid", "n", ratio, keys=["g"]).collect()}
    assert keyed_pairs == {(a, b) for a, b in want if rows[a][2] == rows[b][2]}


def test_overlap_and_subset_pairs_lose_nothing(spark):
    rng = random.Random(6)
    sets = {i: sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))}) for i in range(50)}
    df = spark.createDataFrame([(i, s, i % 2) for i, s in sets.items()], "uid long, tokens array<string>, k int")
    held = df.select("uid", F.explode("tokens").alias("token"))
    sizes = held.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    for share in (0.4, 2 / 3, 1.0):
        got = {(r["l"], r["r"]) for r in overlap_pairs(held, sizes, share).collect()}
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= share * (len(sets[a]) + len(sets[b])) / 2 - 1e-9}
        assert want <= got
    got = {(r["l"], r["r"]) for r in subset_pairs(df, ["k"]).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sets, 2) if a % 2 == b % 2 and (set(sets[a]) <= set(sets[b]) or set(sets[b]) <= set(sets[a]))}


def test_containment_equals_the_greedy_pass(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        s, t = rng.randrange(9), rng.randrange(9)
        rows.append((i % 3, i, s, s + rng.randrange(5), t, t + rng.randrange(5)))
    kept: list = []
    for r in rows:
        if not any(k[0] == r[0] and k[2] <= r[2] and r[3] <= k[3] and k[4] <= r[4] and r[5] <= k[5] for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "g int, rank int, s1 int, e1 int, s2 int, e2 int")
    assert {r["rank"] for r in without_contained(df, ["g"], "rank").collect()} == {k[1] for k in kept}


def test_exact_classes_and_scope(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "uid long, t string")
    assert {r["uid"]: r["class_id"] for r in exact_classes(df, "uid", F.col("t")).collect()} == {3: 1, 1: 1, 2: 2, 4: 4}
    with pytest.raises(ValueError):
        scope_condition("x", F.col("a"), F.col("b"))


def test_names_agree_between_columns_and_python(spark):
    words = ["", "name", "Name ", "nombre", "naïve", "userId", "userID", "user_id", "x"]
    rows = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", S.property_name_likeness(a, b).alias("p"), S.name_likeness(a, b).alias("n"), S.scalar(overlap_of_words)(a, b).alias("t")).collect():
        assert r["p"] == pytest.approx(property_likeness(r["a"], r["b"])) and r["n"] == pytest.approx(plain_likeness(r["a"], r["b"])) and r["t"] == pytest.approx(overlap_of_words(r["a"], r["b"]))
    assert levenshtein("kitten", "sitting") == 3


def test_normal_types():
    same = [("Array<string>", "string[]"), ("b | a | b", "a|b"), ("(x: number, y?: String) => Promise<A|B>", "(a: number, b: string) => Promise<B | A>"), ("Array<B | A>", "(A | B)[]"), ("B & A", "A & B"), ("Map< string , Number >", "Map<string, number>")]
    for x, y in same:
        assert normal_type(x) == normal_type(y)
    assert normal_type("PhoneNumber") == "PhoneNumber" and normal_type("'a|b' | \"c\"") == '"c" | \'a|b\''


@pytest.mark.parametrize(
    "a,b,score",
    [
        ("string", "String", 1.0), ("User", "Order", 0.2), ("a | b", "a | c", 0.3), ("a & b", "a & c", 0.5), ("A[]", "A", 0.2), ("A[]", "B[]", 0.2), ("Promise<A>", "Promise<B>", 0.43),
        ("Map<a, b>", "Map<b, a>", 0.25), ("Map<a, b>", "Set<a>", 0.2), ("() => A", "A", 0.15), ("(x: a) => A", "(y: a) => B", 0.48), ("(x: a, y: b) => A", "(x: a) => A", 0.755), ("{ a: b }", "{ a: c }", 0.875),
    ],
)
def test_type_likeness(a, b, score):
    assert type_likeness(a, b) == pytest.approx(score) and type_likeness(b, a) == pytest.approx(score)


def test_property_matching_rules():
    a = shape([("id", "string", False), ("name", "String", False), ("mail", "string | undefined", False)])
    b = shape([("id", "string", False), ("title", "string", False), ("mail", "string", True)])
    assert [(m[0], m[1], m[3]) for m in matches(a, b)] == [("id", "id", 1.0), ("mail", "mail", 1.0), ("name", "title", 0.95)]
    c = shape([("id", "string", True), ("[index: string]", "boolean", False)])
    assert [(m[0], m[3]) for m in matches(a, c)] == [("id", 0.5)] and not matches(c, shape([("enabled", "boolean", False)]))
    d = differences(a, shape([("id", "number", False), ("extra", "Date", False)]))
    assert d == {"missing": ["mail", "name"], "extra": ["extra"], "types": [("id", "string", "number")], "optionality": []}


def test_similar_types_with_nulls_empties_and_threshold_zero(spark):
    schema = "uid long, file_path string, name string, kind string, has_ignore boolean, properties array<struct<name:string,type_annotation:string,optional:boolean,readonly:boolean>>"
    p = [("a", "string", False, False), ("b", "number", False, False)]
    rows = [(1, "x", "A", "interface", None, p), (2, "y", "B", "type", False, p[::-1]), (3, "y", "EmptyOne", "type", False, []), (4, "z", "EmptyTwo", "interface", False, None), (5, "z", None, "type", True, p), (6, "x", "A", "interface", False, p)]
    df = spark.createDataFrame(rows, schema)
    got = {(r["l"], r["r"]): r["score"] for r in similar_types(df, 0.7).collect()}
    assert set(got) == {(1, 2), (2, 6), (3, 4)} and got[1, 2] == pytest.approx(0.85 + 0.15 * 0.8)
    apart = similar_types(df, 0.7, allow_cross_kind=False).collect()
    assert apart == []
    zero = {(r["l"], r["r"]) for r in similar_types(df, 0.0).collect()}
    assert {(1, 2), (2, 6), (3, 4)} <= zero
    assert similar_types(df.limit(0), 0.8).count() == 0


def scalar_edit(d, n1, n2):
    hi, lo = max(n1, n2), min(n1, n2)
    s, nd, r = max(0.0, 1 - d / hi), d / hi, lo / hi
    if d > 0 and hi < 8:
        s *= 0.55
    elif d > 0 and hi < 16:
        s *= 0.92 + 0.08 * min(1, max(0, 1 - 8 * nd))
    if d > 0 and lo < 10:
        s *= max(0.25, (lo / 10) ** 0.7) * (0.6 if nd > 0.04 else 1)
    elif d > 0 and lo < 20:
        s *= (0.92 + 0.08 * min(1, max(0, 1 - 4 * nd))) * (0.85 if nd > 0.18 else 1)
    elif d > 0 and lo < 30:
        s *= (0.95 + 0.05 * min(1, max(0, 1 - 4 * nd))) * (0.88 if nd > 0.13 else 1)
    elif d == 0 and lo < 8:
        s *= min(0.95, max(0.7, (lo + 4) / 12))
    if nd > 0.16:
        s *= max(0.3, 1 - 4 * (nd - 0.16))
    return s * (r**0.5 if r < 0.5 else 1)


def test_edit_likeness_against_scalar(spark):
    rng = random.Random(8)
    rows = [(float(round(abs(a - b) + rng.choice([0, 0.3, 0.6, 2.1, 7]), 2)), a, b) for a, b in ((rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(400))] + [(0.0, n, n) for n in (1, 5, 8, 40)]
    df = spark.createDataFrame([r for r in rows if r[0] > 0 or r[1] == r[2]], "d double, a int, b int")
    for r in df.withColumn("s", S.edit_likeness(F.col("d"), F.col("a"), F.col("b"))).collect():
        assert r["s"] == pytest.approx(scalar_edit(r["d"], r["a"], r["b"])), r


def test_similar_classes_equal_brute_force(spark):
    from twinscan.operators import classes_mode as C

    rng = random.Random(9)
    types, names = ["string", "number", "Map<string, User>", "Map<string, Order>", ""], ["items", "rows", "count", "getItem", "getItems", "add", "addAll", "remove", "x"]
    rows = []
    for i in range(45):
        fields = [(n, rng.choice(types), rng.random() < 0.2, False, False, False) for n in rng.sample(names, rng.randrange(0, 4))]
        methods = [(n, [f"a: {rng.choice(types)}"], rng.choice([None, "void", "User"]), rng.random() < 0.1, False, False, False, rng.choice(["method", "getter"]), rng.choice([None, 1, 2])) for n in rng.sample(names, rng.randrange(0, 4))]
        rows.append((i, f"f{i % 5}.ts", rng.choice(["UserStore", "OrderStore", "Cache", None]), rng.choice([None, "Base"]), rng.choice([None, ["I"], []]), fields or None, methods))
    schema = (
        "uid long, file_path string, name string, extends_name string, implements_names array<string>, "
        "properties array<struct<name:string,type_annotation:string,is_static:boolean,is_private:boolean,is_readonly:boolean,is_optional:boolean>>, "
        "methods array<struct<name:string,parameters:array<string>,return_type:string,is_static:boolean,is_private:boolean,is_async:boolean,is_generator:boolean,kind:string,body_fingerprint:long>>"
    )
    df = spark.createDataFrame(rows, schema)
    units = df.collect()
    for threshold in (0.5, 0.8):
        want = {}
        for a, b in itertools.combinations(units, 2):
            f, g, m, n = C.fields(a["properties"]), C.fields(b["properties"]), C.methods(a["methods"]), C.methods(b["methods"])
            total = len(f) + len(g) + len(m) + len(n)
            same = a["extends_name"] == b["extends_name"] and (a["implements_names"] or []) == (b["implements_names"] or [])
            s = min(1.0, (C.field_credit(f, g) + C.method_credit(m, n)) / total) if total else 0.85 if same else 0.3
            score = 0.85 * s + 0.15 * plain_likeness(a["name"] or "", b["name"] or "")
            if score >= threshold:
                want[a["uid"], b["uid"]] = pytest.approx(score)
        assert {(r["l"], r["r"]): r["score"] for r in C.similar_classes(df, threshold).collect()} == want
    assert C.similar_classes(df.limit(0)).count() == 0


def test_type_literals_against_definitions_and_each_other(spark):
    from twinscan.operators.types_mode import similar_literal_pairs, similar_type_literals

    schema = "uid long, file_path string, name string, kind string, has_ignore boolean, start_line int, end_line int, properties array<struct<name:string,type_annotation:string,optional:boolean,readonly:boolean>>"
    p = [("a", "string", False, False), ("b", "number", False, False)]
    rows = [(1, "x", "User", "interface", False, 1, 4, p), (2, "y", "f (return type)", "typeLiteral", False, 3, 3, p), (3, "x", "user (variable)", "typeLiteral", False, 9, 9, p), (4, "x", "User (x)", "typeLiteral", False, 2, 3, p)]
    df = spark.createDataFrame(rows, schema)
    assert {(r["literal"], r["definition"]) for r in similar_type_literals(df, 0.8).collect()} == {(2, 1), (3, 1)}
    assert {(r["l"], r["r"]) for r in similar_literal_pairs(df, 0.8).collect()} == {(2, 3), (2, 4), (3, 4)}


def test_literals_ignore_names_and_directives_and_equal_the_nested_loop(spark):
    from twinscan.functions import likeness
    rng = random.Random(12)
    rows = []
    for i in range(40):
        props = [(rng.choice("abcdef"), rng.choice(["string", "number", "Date", "string | undefined"]), rng.random() < 0.2, False) for _ in range(rng.randrange(0, 4))]
        at = rng.randrange(1, 30)
        rows.append((i, rng.choice("xy"), rng.choice(["User", "Users", "Row"]), rng.choice(["typeLiteral", "interface"]), rng.random() < 0.3, at, at + rng.randrange(0, 4), props))
    schema = "uid long, file_path string, name string, kind string, has_ignore boolean, start_line int, end_line int, properties array<struct<name:string,type_annotation:string,optional:boolean,readonly:boolean>>"
    df = spark.createDataFrame(rows, schema)

    def score(a, b):
        x, y = (shape([p[:3] for p in u[7]]) for u in (a, b))
        met, names, n = matches(x, y), property_likeness(a[2], b[2]), len(x[0]) + len(y[0])
        structure = 0.6 + 0.4 * names if n == 0 else 0.0 if not met or not x[0] or not y[0] else sum(m[3] for m in met) / len(met) * 2 * len(met) / n
        return 0.85 * structure + 0.15 * (0.8 * sum(m[2] for m in met) / len(met) + 0.2 * names if met else names)

    for threshold in (0.1, 0.6, 0.8):
        want = {}
        for a, b in itertools.combinations(rows, 2):
            if (a[3] == b[3]) or (a[1] == b[1] and a[5] <= b[6] and b[5] <= a[6]):
                continue
            if score(a, b) >= threshold:
                want[(a[0], b[0]) if a[3] == "typeLiteral" else (b[0], a[0])] = pytest.approx(score(a, b))
        assert {(r["literal"], r["definition"]): r["score"] for r in similar_type_literals(df, threshold).collect()} == want
        plain = [r for r in rows if not r[4]]
        want = {(a[0], b[0]): pytest.approx(score(a, b)) for a, b in itertools.combinations(plain, 2) if (a[1], a[2]) != (b[1], b[2]) and score(a, b) >= threshold}
        assert {(r["l"], r["r"]): r["score"] for r in similar_types(df, threshold).collect()} == want
    assert likeness is S


def test_matching_takes_the_best_pairs_first(spark):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(120)})
    rows = [(a, b, rng.choice([0.8, 0.9, 0.95])) for a, b in pairs]
    want, used = set(), set()
    for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b, s))
    df = spark.createDataFrame(rows, "l long, r long, score double")
    assert {tuple(r) for r in type_groups(df).collect()} == want
    assert greedy_matching(df.limit(0)).count() == 0


def test_type_signatures_and_class_differences(spark):
    from twinscan.operators.classes_mode import class_differences, fields, methods

    schema = "uid long, properties array<struct<name:string,type_annotation:string,optional:boolean,readonly:boolean>>"
    df = spark.createDataFrame([(1, [("b", "Array<string>", False, True), ("a", "number | undefined", False, False)]), (2, None)], schema)
    assert {r["uid"]: r["signature"] for r in type_signatures(df).collect()} == {1: "{ a?: number; readonly b: string[] }", 2: "{  }"}
    f = lambda n, t: {"name": n, "type_annotation": t, "is_static": False}
    m = lambda n, p, r: {"name": n, "parameters": p, "return_type": r, "is_static": False, "kind": "method", "body_fingerprint": None}
    a = fields([f("id", "string"), f("rows", "Row[]"), f("gone", "Date")]), methods([m("load", ["k: string"], "void"), m("save", [], "void")])
    b = fields([f("id", "number"), f("rowz", "Row[]"), f("new", "Map")]), methods([m("load", ["k: number"], "void"), m("store", ["x: string"], "Row")])
    d = class_differences(a, b)
    assert d["property_types"] == [("id", "string", "number")] and [x[0] for x in d["method_signatures"]] == ["load"]
    assert (d["missing_properties"], d["extra_properties"]) == (["gone"], ["new"]) and d["missing_methods"] == ["save"] and d["extra_methods"] == ["store"]


def test_salted_join_is_a_join(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(90)]
    a, b = spark.createDataFrame(rows, "k string, x int"), spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, y int")
    for how in ("inner", "left"):
        want = sorted((tuple(r) for r in a.join(b, "k", how).collect()), key=str)
        assert sorted((tuple(r) for r in salted_join(a, b, ["k"], how, rows_per_salt=7).select("k", "x", "y").collect()), key=str) == want


def test_names_meet_by_rare_letters_and_none_is_lost(spark):
    from twinscan.operators.pairs import edit_pairs

    rng = random.Random(14)
    stems = ["userName", "orderLine", "aaaa", "total", "x", "naïveÜ"]
    names = sorted({"".join(c for c in rng.choice(stems) if rng.random() < 0.9) + rng.choice(["", "s", "Id", "aa"]) for _ in range(60)} - {""})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for least in (0.4, 0.75, 0.9, 1.0):
        want = {(a, b) for a, b in itertools.combinations(names, 2) if plain_likeness(a, b) >= least}
        got = {(r["l"]["name"], r["r"]["name"]) for r in edit_pairs(df, "name", least).collect()}
        assert want <= got


def test_names_meet_by_segments_and_none_is_lost(spark):
    from twinscan.operators.pairs import close_names

    rng = random.Random(23)
    stems = ["userName", "orderLineTotal", "aaaa", "total", "x", "naïveÜberschrift", "数据库连接名", "configurationManagerFactoryBean" * 3]
    letters = lambda stem: "".join(rng.choice("aeÜ数") if rng.random() < 0.06 else c for c in stem if rng.random() < 0.95)
    names = sorted({letters(rng.choice(stems)) + rng.choice(["", "s", "Id", "  ", "aa"]) for _ in range(150)} | {"", " ", "Id", "id         ", "ID"})
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def likeness(a, b):
        x, y = a.lower().strip(" "), b.lower().strip(" ")
        return 0.95 if x == y else 1 - levenshtein(x, y) / max(len(x.encode()), len(y.encode()))

    for least in (0.8, 1.0):
        want = {(a, b) for a, b in itertools.combinations(names, 2) if likeness(a, b) >= least}
        assert {tuple(r) for r in close_names(df, least).collect()} == want


def test_property_names_that_differ_in_outer_blanks_are_found(spark, tmp_path):
    from twinscan.driver_queries import property_name_pairs

    schema = "properties array<struct<name:string>>"
    spark.createDataFrame([([("id",), ("id      ",), (None,)],), (None,)], schema).write.parquet(str(tmp_path / "type_units.parquet"))
    assert [tuple(r) for r in property_name_pairs(spark, str(tmp_path)).collect()] == [("id", "id      ", 0.95)]


def test_units_share_keys_counted_without_moving_pairs(spark):
    from twinscan.operators.overlap_mode import multiplicity

    rng = random.Random(4)
    rows = [(u, rng.choice("abcdefgh")) for u in range(40) for _ in range(4)] + [(u, "all") for u in range(40)] + [(None, "all"), (3, None), (99, "alone")]
    held = {u: {k for v, k in rows if v == u and k is not None} for u, _ in rows if u is not None}
    want = {(a, b, len(held[a] & held[b])) for a, b in itertools.combinations(sorted(held), 2) if held[a] & held[b]}
    df = spark.createDataFrame(rows, "uid long, hash string")
    assert all({tuple(r) for r in multiplicity(df, pairs_per_task=n).collect()} == want for n in (50, 500_000))
    plan = multiplicity(df, pairs_per_task=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # blocks of units move, their pairs are counted where they are made
    assert multiplicity(df.limit(0)).count() == 0


def test_classes_without_a_common_name_meet_by_their_types(spark):
    from twinscan.operators import classes_mode as C

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    types = ["string", "number", "Date", "User", "Map<string, User>"]
    base = [[(word(), rng.choice(types), rng.random() < 0.2, False, False, False) for _ in range(n)] for n in (1, 2, 4, 7, 9) * 3]
    method = lambda n, body: (n, ["a: string"], "void", False, False, False, False, "method", body)
    rows = []
    for i in range(120):
        fields = [(n[:-1] + str(i % 10), *rest) for n, *rest in base[i % len(base)]][: rng.choice([2, 9, 9])]
        methods = [method(word(), rng.choice([None, i])) for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append((i, "f.ts", rng.choice(["UserStore", "UserStores", word()]), fields, methods))
    schema = (
        "uid long, file_path string, name string, "
        "properties array<struct<name:string,type_annotation:string,is_static:boolean,is_private:boolean,is_readonly:boolean,is_optional:boolean>>, "
        "methods array<struct<name:string,parameters:array<string>,return_type:string,is_static:boolean,is_private:boolean,is_async:boolean,is_generator:boolean,kind:string,body_fingerprint:long>>"
    )
    empty = {"extends_name": F.lit(None).cast("string"), "implements_names": F.array().cast("array<string>")}
    units = [(r[0], r[2], C.fields([dict(zip(("name", "type_annotation", "is_static"), p)) for p in r[3]]), C.methods([dict(zip(("name", "parameters", "return_type", "is_static", "is_private", "is_async", "is_generator", "kind", "body_fingerprint"), m)) for m in r[4]])) for r in rows]
    scores, strange = {}, set()
    for (i, x, f, m), (j, y, g, n) in itertools.combinations(units, 2):
        s = min(1.0, (C.field_credit(f, g) + C.method_credit(m, n)) / (len(f) + len(g) + len(m) + len(n)))
        scores[i, j] = 0.85 * s + 0.15 * plain_likeness(x, y)
        if not set(f) & set(g) and not set(m) & set(n):
            strange.add((i, j))
    df = spark.createDataFrame(rows, schema).withColumns(empty)
    for threshold in (0.3, 0.8, 0.85):
        want = {p: pytest.approx(s) for p, s in scores.items() if s >= threshold}
        assert strange & want.keys()
        assert {(r["l"], r["r"]): r["score"] for r in C.similar_classes(df, threshold).collect()} == want

    # Many classes of one size that have nothing but hot types in common: few of all pairs may meet.
    many = [(i, "f.ts", word(), [(word(), t, False, False, False, False) for t in rng.choices(types[:3], k=4)], [method(word(), i) for _ in range(2)]) for i in range(3000)]
    packed = spark.createDataFrame(many, schema).mapInPandas(lambda it: C._packed(it), C.PACKED.format(id="bigint"))
    hashed = [F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("of_fields", "of_methods", "held", "kinds")]
    sized = packed.select("uid", "n_fields", "n_methods", "bare", *hashed, F.lit("f.ts").alias("file_path"), F.col("uid").cast("string").alias("name"))
    assert C._candidates(sized, 0.8, (0.8 - 0.15) / 0.85, "all").count() < 3000 * 2999 / 2 / 20
