import random

from pyspark.sql import functions as F

from twinscan.llm.neardup import expand_links, near_duplicate_groups, near_duplicates
from twinscan.llm.shingles import shingle_sets
from twinscan.llm.spans import chains, shared_passages, shared_ranges, shared_shares

SCHEMA = "id long, t string, h long, other string, blocks int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def lines_of(t):
    out = t.split("\n")
    return out[:-1] if out[-1] == "" else out


def brute_ranges(rows, k):
    texts = {i: t for i, t in rows if i is not None and t is not None}
    where = {}
    for i, t in texts.items():
        ls = lines_of(t)
        for a in range(len(ls) - k + 1):
            where.setdefault(tuple(ls[a : a + k]), set()).add((i, a))
    covered = {}
    for v in where.values():
        if len({i for i, _ in v}) > 1:
            for i, a in v:
                covered.setdefault(i, set()).update(range(a + 1, a + k + 1))
    return sorted((i, min(run), max(run)) for i, c in covered.items() for run in runs(sorted(c)))


def runs(xs):
    out = [[xs[0]]]
    for x in xs[1:]:
        if x == out[-1][-1] + 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def test_shared_ranges_agree_with_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}\r" if i % 5 == 0 else f"w{i}" for i in range(6)]
    block = [rng.choice(words) for _ in range(9)]
    rows = []
    for i in range(25):
        ls = [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            ls += block[rng.randrange(3) :] + [rng.choice(words) for _ in range(rng.randrange(0, 4))]
        rows.append((i, "\n".join(ls) + rng.choice(["", "\n"])))
    rows += [(3, rows[3][1]), (90, None), (None, rows[4][1]), (91, ""), (92, "\n"), (93, "same\n" * 30), (94, "same\n" * 9)]
    df = frame(spark, rows)
    passages = shared_passages(df, F.col("id"), F.col("t"), k=4)
    got = sorted((r["record_id"], r["start_line"], r["end_line"]) for r in shared_ranges(passages).collect())
    assert got == brute_ranges(rows, 4)
    shares = {r["record_id"]: r for r in shared_shares(df, F.col("id"), F.col("t"), shared_ranges(passages)).collect()}
    assert shares[91]["n_lines"] == 0 and shares[91]["share"] == 0 and shares[92]["n_lines"] == 1 and 90 not in shares
    assert shares[93]["share"] == 1.0


def test_repeats_of_one_record_never_match_each_other(spark):
    df = frame(spark, [(1, "a\nb\nc\nd\n" * 3), (1, "a\nb\nc\nd\n" * 3)])
    assert shared_passages(df, F.col("id"), F.col("t"), k=4).count() == 0
    assert shared_passages(df.limit(0), F.col("id"), F.col("t"), k=4).count() == 0


def brute_chain(blocks, k, gap):
    best = []
    for j, (a, b, s) in enumerate(blocks):
        top = 0.0
        for i, (p, q, r) in enumerate(blocks):
            if p + r + k - 2 < a and q + r + k - 2 < b:
                top = max(top, best[i] - gap * ((a - p - r - k + 1) + (b - q - r - k + 1)) if i < len(best) else 0)
        best.append(s + k - 1 + top)
    return max(best)


def test_fenwick_chaining_equals_quadratic_chaining():
    rng = random.Random(7)
    for _ in range(200):
        blocks = sorted({(rng.randrange(40), rng.randrange(40), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 12))})
        found = chains(blocks, 3, 0.25)
        assert abs(found[0][0] - brute_chain(blocks, 3, 0.25)) < 1e-9
        assert sorted(i for _, c in found for i in c) == list(range(len(blocks)))


def brute_pairs(rows, k, threshold):
    texts = {i: t for i, t in rows if i is not None and t is not None}
    ids = sorted(texts)
    sets = dict(zip(ids, (set(x.tolist()) for x in shingle_sets([texts[i] for i in ids], k))))
    return sorted((a, b) for a in ids for b in ids if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold)


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(3)
    base = [[f"t{rng.randrange(5000)}" for _ in range(150)] for _ in range(8)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 10)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(5, rows[5][1]), (70, rows[6][1]), (71, rows[6][1].replace(" ", "\n ")), (80, None), (None, "a b c d e f"), (81, ""), (82, "a b c"), (83, "x y z w v"), (84, "x y z w v"), (85, "long " * 30000)]
    df = frame(spark, rows)
    links, members = near_duplicates(df, F.col("id"), F.col("t"), k=5, threshold=0.7)
    links = links.cache()
    got = sorted((r["left_id"], r["right_id"]) for r in expand_links(links, members).collect())
    assert got == brute_pairs(rows, 5, 0.7)
    group = {r["record_id"]: r for r in near_duplicate_groups(links, members).collect()}
    assert group[83]["group_id"] == group[84]["group_id"] == 83 and group[84]["n_links"] == 0 and 82 not in group
    assert all(group[a]["group_id"] == group[b]["group_id"] for a, b in got)


def test_near_duplicates_of_nothing(spark):
    links, members = near_duplicates(frame(spark, []), F.col("id"), F.col("t"))
    assert links.count() == 0 and members.count() == 0


def test_tokens_are_word_runs_and_single_marks():
    a, b, c = shingle_sets(["foo_1(x) é9", "foo_1 ( x\n)é9", "﻿foo_1(x)é9"], 2)
    assert a.tolist() == b.tolist() and len(c) == len(a) + 1
