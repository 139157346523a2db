"""Fuzzy passages between all pairs of records that share lines.

Method: equal texts are one class. Classes that may hold a passage meet by their seeds (runs of ``seed``
lines); a passage holds at least ceil(k / seed) seeds, so each class leaves out that many less one of its
most frequent ones and no pair is lost. A frequent seed is salted by its count. Each pair of classes is then
read with all its lines: all seed matches become blocks, chained with gap costs (``spans.chains``), and the
lines in the gaps of a chain are aligned. Members of the classes take the passages of their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.llm.shingles import mix
from twinscan.llm.spans import chains, line_hashes
from twinscan.plans.scratch import cut

PASSAGE = "l long, r long, start_line long, end_line long, other_start long, other_end long, exact_lines long, aligned_lines long, identity double, score double"
PIECE = 1 << 21  # seed matches of one pair held at once; more are read in pieces


def _runs(lines: np.ndarray, seed: int) -> np.ndarray:
    """A hash of every run of ``seed`` lines."""
    n = len(lines) - seed + 1
    h = np.zeros(n, np.uint64)
    for i in range(seed):
        h = mix(h ^ lines[i : i + n])
    return h


class Text:
    """The lines of a text as hashes, with its runs of ``seed`` lines, plain and sorted: made once for all its pairs."""

    def __init__(self, lines: np.ndarray, seed: int):
        self.lines = lines
        self.runs = _runs(lines, seed) if len(lines) >= seed else np.zeros(0, np.uint64)
        self.order = np.argsort(self.runs, kind="stable")
        self.sorted = self.runs[self.order]


def matched_blocks(p: Text, q: Text, seed: int, least: int = 1) -> list[tuple[int, int, int]]:
    """All maximal diagonal runs of equal lines, ``seed`` lines or longer, as (line of p, line of q, seeds); none if
    fewer than ``least`` runs of p occur in q."""
    if not len(p.runs) or not len(q.runs):
        return []
    a, b, x, y, order = p.lines, q.lines, p.runs, q.sorted, q.order
    low = np.searchsorted(y, x)
    if (y[np.minimum(low, len(y) - 1)] == x).sum() < least:
        return []
    count = np.searchsorted(y, x, "right") - low
    some = np.flatnonzero(count)
    total = np.cumsum(count[some])
    starts, ends, at = [], [], 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(total, PIECE + (total[at - 1] if at else 0), "right")))
        rows, n = some[at:to], count[some[at:to]]
        i = np.repeat(rows, n)
        j = order[np.repeat(low[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        first = (i == 0) | (j == 0) | (a[i - 1] != b[j - 1])
        e, f = i + seed, j + seed
        last = (e == len(a)) | (f == len(b)) | (a[e % len(a)] != b[f % len(b)])
        starts.append((i[first], j[first]))
        ends.append((i[last], j[last]))
        at = to
    if not starts:
        return []
    # On one diagonal starts and ends alternate.
    (si, sj), (ei, ej) = (tuple(np.concatenate(v) for v in zip(*p)) for p in (starts, ends))
    s, e = np.lexsort((si, si - sj)), np.lexsort((ei, ei - ej))
    seeds = ei[e] - si[s] + 1
    return sorted(zip((si[s] + 1).tolist(), (sj[s] + 1).tolist(), seeds.tolist()))


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Most lines of ``a`` and ``b`` that are equal in one order (longest common subsequence)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    best = np.zeros(len(b) + 1, np.int64)
    for x in a[np.isin(a, b)]:
        best[1:] = np.maximum(best[1:], best[:-1] + (b == x))
        best = np.maximum.accumulate(best)
    return int(best[-1])


def passages_of(p: Text, q: Text, k: int, seed: int, gap_cost: float) -> list[tuple]:
    """Passages of two texts: the columns of ``PASSAGE`` from start_line on."""
    blocks = matched_blocks(p, q, seed, -(-k // seed))  # k lines in blocks of seed lines or more hold that many seeds
    a, b = p.lines, q.lines
    out = []
    for score, chain in chains(blocks, seed, gap_cost) if blocks else []:
        parts = [(blocks[i][0], blocks[i][1], blocks[i][2] + seed - 1) for i in chain]
        exact = sum(p[2] for p in parts)
        if exact < k:
            continue
        same = exact + sum(aligned(a[p[0] + p[2] - 1 : q[0] - 1], b[p[1] + p[2] - 1 : q[1] - 1]) for p, q in zip(parts, parts[1:]))
        (s, t, _), (u, v, n) = parts[0], parts[-1]
        e, f = u + n - 1, v + n - 1
        out.append((s, e, t, f, exact, same, 2 * same / (e - s + f - t + 2), score))
    return out


def _between(batches: Iterator[pd.DataFrame], k: int, seed: int, gap_cost: float) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PASSAGE.split(", ")]
    for batch in batches:
        rows, known = [], {}
        for l, r, *sides in zip(batch["l"], batch["r"], batch["la"], batch["lb"]):
            for c, lines in zip((l, r), sides):
                if c not in known:
                    known[c] = Text(np.asarray(lines, np.int64).view(np.uint64), seed)
            for s, e, t, f, *rest in passages_of(known[l], known[r], k, seed, gap_cost):
                rows.append((l, r, s, e, t, f, *rest))
                if l != r:
                    rows.append((r, l, t, f, s, e, *rest))
        yield pd.DataFrame(rows, columns=names)


def fuzzy_passages(df: DataFrame, record_id: Column, text: Column, k: int = 12, seed: int = 4, gap_cost: float = 0.25, rows_per_salt: int = 1000) -> DataFrame:
    """Passages of at least ``k`` equal lines, in exact blocks of at least ``seed``, between all records.

    Returns record_id, other_id, start_line, end_line, other_start, other_end, exact_lines (in the blocks),
    aligned_lines (those and the equal lines of the aligned gaps), identity (2 * aligned_lines / the lines
    of both extents) and score (of the chain). Every passage comes out in both directions.

    Defined results: null ids or texts take no part; repeated rows of one id count once and never match
    each other; texts under ``k`` lines have no passages; copies have passages with each other like any
    texts; an empty table gives no rows; whole texts are read whatever their length; ``seed`` must lie
    between 1 and ``k``. Other columns of ``df`` play no part.
    """
    if not 1 <= seed <= k:
        raise ValueError("seed must lie between 1 and k")
    rows = df.select(record_id.cast("long").alias("id"), text.alias("__t")).where("id is not null and __t is not null")
    hashes, n = line_hashes(F.col("__t"))
    rows = rows.select("id", F.xxhash64("__t").alias("class"), F.slice(hashes, F.lit(1), n).alias("lines")).where(F.size("lines") >= k)
    members = cut(rows.select("class", "id").distinct(), "members")
    texts = cut(rows.groupBy("class").agg(F.first("lines").alias("lines")), "lines")

    runs = F.transform(F.sequence(F.lit(1), F.size("lines") - (seed - 1)), lambda i: F.struct(F.xxhash64(F.slice("lines", i, seed)).alias("h"), i.alias("at")))
    occ = texts.select("class", F.inline(runs))
    shared = occ.groupBy("h").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "n")
    frequent = Window.partitionBy("class").orderBy(F.desc("n"), F.desc("h"), F.desc("at"))
    kept = occ.join(shared, "h").withColumn("place", F.row_number().over(frequent)).where(F.col("place") >= -(-k // seed))
    kept = kept.select("h", "class", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts")).distinct()
    a = kept.select("h", F.col("class").alias("l"), F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"))
    b = kept.select("h", F.col("class").alias("r"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["h", "salt"]).where("l < r").select("l", "r").distinct()
    copies = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("l"), F.col("class").alias("r"))
    pairs = cut(pairs.unionByName(copies), "pairs")

    left, right = texts.select(F.col("class").alias("l"), F.col("lines").alias("la")), texts.select(F.col("class").alias("r"), F.col("lines").alias("lb"))
    found = pairs.join(left, "l").join(right, "r").select("l", "r", "la", "lb").mapInPandas(lambda it: _between(it, k, seed, gap_cost), PASSAGE)
    out = found.join(members.select(F.col("class").alias("l"), F.col("id").alias("record_id")), "l").join(members.select(F.col("class").alias("r"), F.col("id").alias("other_id")), "r")
    return out.where("record_id <> other_id").select("record_id", "other_id", *(x.split()[0] for x in PASSAGE.split(", ")[2:]))
