import random

import pytest
from pyspark.sql import functions as F

from twinscan.llm.components import connected_groups
from twinscan.llm.topn import top_n_per_group

SCHEMA = "g string, score double, id long, salt string, rank int, __g0 string, __tie long"


def top(df, **kw):
    out = top_n_per_group(df, {"g": F.col("g")}, F.col("score"), F.col("id"), **kw)
    return sorted((r["g"], r["rank"], r["tie"], r["score"]) for r in out.collect())


def brute(rows, n):
    best = {}
    for g, s, i in {(g, s, i) for g, s, i in rows if g is not None and s is not None and s == s and i is not None}:
        best.setdefault(g, []).append((-s, i))
    return sorted((g, k + 1, i, -s) for g, v in best.items() for k, (s, i) in enumerate(sorted(v)[:n]))


@pytest.mark.parametrize("hot", [1, 20, 50, 10**9, None])
def test_hot_and_light_groups_agree_with_brute_force(spark, hot):
    rng = random.Random(str(hot))
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([0.1, 0.5, 0.5, 1.0, None, float("nan")]), rng.randrange(200)) for _ in range(600)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    assert top(df, n=3, hot_rows=hot) == brute(rows, 3)


def test_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 3, "", 0, "", 0), ("a", 1.0, 1, "", 0, "", 0), ("a", 1.0, 1, "", 0, "", 0), ("a", 1.0, 2, "", 0, "", 0)], SCHEMA)
    assert top(df, n=2) == [("a", 1, 1, 1.0), ("a", 2, 2, 1.0)]
    assert top(df.limit(0)) == []


def groups(df, scope=None):
    return sorted((r["scope"], r["unit_id"], r["group_id"]) for r in connected_groups(df, F.col("l"), F.col("r"), scope).collect())


def brute_groups(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, a, b in rows:
        if s is not None and a is not None and b is not None:
            x, y = find((s, a)), find((s, b))
            up[max(x, y)] = min(x, y)
    return sorted((s, v, find((s, v))[1]) for s, v in up)


def test_chains_stars_loops_and_scopes(spark):
    rng = random.Random(4)
    rows = [("a", i, i + 1) for i in range(40)] + [("b", 0, i) for i in range(60)] + [("c", 7, 7), ("c", 7, 7), (None, 1, 2), ("a", None, 3), ("d", 9, 8), ("d", 8, 9)]
    rows += [("e", rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "s string, l long, r long, h string, m int")
    assert groups(df, F.col("s")) == brute_groups(rows)


def test_extreme_ids_and_empty_table(spark):
    rows = [(None, 2**63 - 1, -(2**63)), (None, 5, 5)]
    df = spark.createDataFrame(rows, "s string, l long, r long")
    assert groups(df) == [("", -(2**63), -(2**63)), ("", 5, 5), ("", 2**63 - 1, -(2**63))]
    assert groups(df.limit(0)) == []
    assert groups(spark.createDataFrame([("a", None, 1)], "s string, l long, r long"), F.col("s")) == []


def test_the_tenth_of_all_rows_in_one_file_goes_the_hot_way(spark, tmp_path):
    import re

    from twinscan.llm.queries import p1_found

    rows = [(i, "functions", "hot.ts" if i % 10 == 0 else f"f{i % 97}.ts", (i * 37 % 101) / 100) for i in range(4000)]
    loc = "struct<file_path:string,start_line:int,end_line:int,symbol_name:string,kind:string>"
    df = spark.createDataFrame([(i, m, s, (p, 1, 2, "s", "k")) for i, m, p, s in rows], f"pair_id long, mode string, score double, left_loc {loc}")
    df.write.parquet(str(tmp_path / "unit_pairs.parquet"))
    found = p1_found(spark, str(tmp_path))
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((m, p, i) for (m, p) in {(m, p) for _, m, p, _ in rows} for _, i in sorted((-s, i) for i, _, q, s in rows if q == p)[:5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"rangepartitioning\(", plan)
    counts = df.groupBy("left_loc.file_path").count().where("count > 4000 / (4 * 4)").collect()
    assert [r["file_path"] for r in counts] == ["hot.ts"]
