import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscan.llm.passages import Text, aligned, fuzzy_passages, matched_blocks
from twinscan.llm.spans import chains


def lines_of(t):
    out = t.split("\n")
    return out[:-1] if out[-1] == "" else out


def found(spark, rows, **given):
    df = spark.createDataFrame(rows, "id long, t string")
    return sorted(tuple(r) for r in fuzzy_passages(df, F.col("id"), F.col("t"), **given).collect())


def brute_blocks(a, b, seed):
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= seed:
                    out.append((i + 1, j + 1, n - seed + 1))
    return sorted(out)


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def brute(rows, k, seed, gap_cost=0.25):
    texts = {i: lines_of(t) for i, t in rows if i is not None and t is not None}
    out = set()
    for p in texts:
        for q in texts:
            blocks = brute_blocks(texts[p], texts[q], seed) if p != q else []
            for score, chain in chains(blocks, seed, gap_cost) if blocks else []:
                parts = [(blocks[i][0], blocks[i][1], blocks[i][2] + seed - 1) for i in chain]
                exact = sum(x[2] for x in parts)
                if exact >= k:
                    gaps = sum(common(texts[p][x[0] + x[2] - 1 : y[0] - 1], texts[q][x[1] + x[2] - 1 : y[1] - 1]) for x, y in zip(parts, parts[1:]))
                    s, t, e, f = parts[0][0], parts[0][1], parts[-1][0] + parts[-1][2] - 1, parts[-1][1] + parts[-1][2] - 1
                    out.add((p, q, s, e, t, f, exact, exact + gaps, 2 * (exact + gaps) / (e - s + f - t + 2), score))
    return sorted(out)


def numbered(name, n):
    return [f"{name}{i}" for i in range(n)]


def text(*parts):
    return "\n".join(x for p in parts for x in p) + "\n"


def test_every_pair_of_records_with_a_common_block_has_a_passage(spark):
    block = numbered("s", 14)
    rows = [(i, text(numbered(f"a{i}_", i), block, numbered(f"z{i}_", 3))) for i in range(1, 6)]
    got = found(spark, rows, k=12, seed=12)
    assert {r[:2] for r in got} == {(p, q) for p in range(1, 6) for q in range(1, 6) if p != q}
    assert all(r[2:8] == (r[0] + 1, r[0] + 14, r[1] + 1, r[1] + 14, 14, 14) for r in got)


def test_a_chain_runs_through_a_later_copy_of_a_repeated_block(spark):
    x, y = numbered("x", 12), numbered("y", 12)
    rows = [(1, text(x, ["m"], numbered("n", 40), x, y)), (2, text(x, ["q"], y))]
    best = max(r for r in found(spark, rows, k=12, seed=12) if r[:2] == (2, 1) and r[6] == 24)
    assert best[2:8] == (1, 25, 54, 77, 24, 24)


def test_a_passage_edited_more_often_than_every_k_lines_is_found_and_aligned(spark):
    base = numbered("s", 60)
    other = [x if i % 6 else f"edit{i}" for i, x in enumerate(base)]
    other[12:12] = ["added"]
    rows = [(1, text(base)), (2, text(numbered("h", 5), other))]
    (back, there) = found(spark, rows, k=12, seed=4)
    assert back[:2] == (1, 2) and there[:2] == (2, 1)
    assert back[2:8] == (2, 60, 7, 66, 50, 50) and back[8] == pytest.approx(100 / 119)
    rows = [(1, text(numbered("a", 8), ["g1", "same", "g2"], numbered("b", 8))), (2, text(numbered("a", 8), ["same", "o"], numbered("b", 8)))]
    assert found(spark, rows, k=12, seed=4)[0][2:9] == (1, 19, 1, 18, 16, 17, 34 / 37)


@pytest.mark.parametrize("k,seed,per_salt", [(4, 4, 1000), (6, 2, 1), (5, 2, 3)])
def test_passages_agree_with_brute_force(spark, k, seed, per_salt):
    rng = random.Random(k * 10 + seed)
    words = [f"w{i}" for i in range(9)]
    block = [rng.choice(words) for _ in range(14)]
    rows = []
    for i in range(24):
        ls = numbered(f"own{i}_", rng.randrange(0, 4))
        for _ in range(rng.randrange(0, 3)):
            ls += [x if rng.random() > 0.15 else f"e{rng.randrange(99)}" for x in block[rng.randrange(5) :]] + [rng.choice(words) for _ in range(rng.randrange(0, 4))]
        rows.append((i, "\n".join(ls) + rng.choice(["", "\n"])))
    rows += [(3, rows[3][1]), (30, rows[4][1]), (31, rows[4][1]), (90, None), (None, rows[4][1]), (91, ""), (92, "\n"), (93, "same\n" * 12), (94, "same\n" * 9)]
    # Equal scores may be chained differently seen from the other record, so one direction is compared.
    got = found(spark, rows, k=k, seed=seed, rows_per_salt=per_salt)
    want = brute(rows, k, seed)
    assert {r[:2] for r in got} == {r[:2] for r in want}
    turned = sorted((r[1], r[0], r[4], r[5], r[2], r[3], *r[6:]) for r in got)
    assert [r[:8] for r in turned] == [r[:8] for r in got] and len(set(got)) == len(got)
    for pair in {r[:2] for r in got}:
        one, two = [x for x in got if x[:2] == pair], [x for x in got if x[:2] == pair[::-1]]
        mine, theirs = [x for x in want if x[:2] == pair], [x for x in want if x[:2] == pair[::-1]]
        assert one == mine or two == theirs, pair


def test_blocks_in_pieces_and_alignment(monkeypatch):
    monkeypatch.setattr("twinscan.llm.passages.PIECE", 3)
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in "ab")
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert matched_blocks(Text(x, 2), Text(y, 2), 2) == brute_blocks(a, b, 2)
        assert aligned(x, y) == common(a, b)


def test_nothing_and_wrong_seeds(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a\nb\nc\nd\n" * 3), (1, "a\nb\nc\nd\n" * 3)], k=4, seed=2) == []
    with pytest.raises(ValueError):
        found(spark, [], k=3, seed=4)
