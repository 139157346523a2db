"""Long exact spans shared between records.

Method: seeds are k-mers of lines (k = the least span wanted). Equal seeds of different records are
joined, the matches of a record pair are chained in order with gap costs through a Fenwick tree, and the
exact blocks of the chains give the verbatim ranges. Passages between all pairs of records: ``passages``.

A seed shared by very many records would give all pairs of them; instead each seed has two anchors, the
smallest and the largest record holding it, and every record is matched with an anchor other than itself.
That keeps the matches linear in the occurrences and still proves for every seed that another record has it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.plans.scratch import cut

PASSAGE = "record_id long, other_id long, start_line long, end_line long, other_start long, other_end long, exact_lines long, score double, blocks array<struct<s:long,e:long>>"


def line_hashes(text: Column) -> tuple[Column, Column]:
    """Hashes of the lines of a text and their number; nothing after the last line feed is no line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))
    return lines, F.size(lines) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)


def seeds(df: DataFrame, record_id: Column, text: Column, k: int) -> DataFrame:
    """One row per run of ``k`` lines: h, h2 (96 bits of hash), id, at (line from 1)."""
    rows = df.select(record_id.cast("long").alias("id"), text.alias("__t")).where("id is not null and __t is not null")
    hashes, n = line_hashes(F.col("__t"))
    rows = rows.select("id", hashes.alias("lh"), n.alias("n")).where(F.col("n") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.col("n") - (k - 1)), lambda i: F.struct(F.xxhash64(F.slice("lh", i, k)).alias("h"), F.hash(F.slice("lh", i, k)).alias("h2"), i.alias("at")))
    return rows.select("id", F.inline(grams)).select("h", "h2", "id", "at")


def shared_passages(df: DataFrame, record_id: Column, text: Column, k: int = 12, gap_cost: float = 0.25) -> DataFrame:
    """Chains of exact matches of at least ``k`` lines between records (schema ``PASSAGE``).

    Defined results: null ids or texts take no part; repeated rows of one id count once and never match
    each other; texts under ``k`` lines have no passages; an empty table gives no rows; whole texts are
    read whatever their length. Other columns of ``df`` play no part.
    """
    occ = seeds(df, record_id, text, k)
    shared = occ.groupBy("h", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    # Each seed has one row in ``shared``, and what follows is exchanged anew, so adaptive execution can split a seed that
    # fills a task. Written: read twice below. Re-delivered rows repeat their seeds until they are grouped by pair.
    hits = cut(occ.join(shared, ["h", "h2"]), "hits")
    anchors = hits.where("id = lo or id = hi").groupBy("h", "h2", F.col("id").alias("other")).agg(F.min("at").alias("other_at"))
    hits = hits.select("h", "h2", "id", "at", F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    matches = hits.join(anchors, ["h", "h2", "other"])
    per_pair = matches.groupBy("id", "other").agg(F.sort_array(F.collect_set(F.struct("at", "other_at"))).alias("m"))  # at most one row per line of one record
    per_pair = per_pair.select("id", "other", F.col("m.at").alias("a"), F.col("m.other_at").alias("b"))
    return per_pair.mapInPandas(lambda it: _chained(it, k, gap_cost), PASSAGE)


def blocks_of(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal diagonal runs of seeds as (a, b, number of seeds)."""
    cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    first = np.r_[0, cut]
    return [(int(a[i]), int(b[i]), int(n)) for i, n in zip(first, np.diff(np.r_[first, len(a)]))]


def chains(blocks: list[tuple[int, int, int]], k: int, gap_cost: float) -> list[tuple[float, list[int]]]:
    """Partition blocks (sorted by their first line) into collinear chains, best first.

    score(j) = lines of j + max(0, score(i) - gap_cost * gap) over blocks i that end before j in both
    records. The gap is linear, so the best i is a prefix maximum over the other record's lines, which a
    Fenwick tree answers in logarithmic time; a block enters the tree when the scan passes its end.
    """
    n = len(blocks)
    ends = [(a + s + k - 2, b + s + k - 2) for a, b, s in blocks]
    ranks = {v: i + 1 for i, v in enumerate(sorted({e[1] for e in ends}))}
    keys = sorted(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(keys) + 1)
    score, back = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: ends[i][0])
    done = 0
    for j, (a, b, s) in enumerate(blocks):
        while done < n and ends[waiting[done]][0] < a:
            i = waiting[done]
            v, x = (score[i] + gap_cost * (ends[i][0] + ends[i][1]), i), ranks[ends[i][1]]
            while x < len(tree):
                tree[x] = max(tree[x], v)
                x += x & -x
            done += 1
        x, best = bisect_left(keys, b), (float("-inf"), -1)
        while x:
            best = max(best, tree[x])
            x -= x & -x
        gain = best[0] - gap_cost * (a + b - 2)
        score[j] = s + k - 1 + max(0.0, gain)
        back[j] = best[1] if gain > 0 else -1
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        if used[j]:
            continue
        chain, i = [], j
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        out.append((score[j] - (score[i] if i >= 0 else 0.0), chain[::-1]))
    return out


def _chained(batches: Iterator[pd.DataFrame], k: int, gap_cost: float) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PASSAGE.replace("struct<s:long,e:long>", "x").split(", ")]
    for batch in batches:
        rows = []
        for rid, other, a, b in zip(batch["id"], batch["other"], batch["a"], batch["b"]):
            blocks = blocks_of(np.asarray(a), np.asarray(b))
            for score, chain in chains(blocks, k, gap_cost):
                parts = [blocks[i] for i in chain]
                spans = [{"s": p[0], "e": p[0] + p[2] + k - 2} for p in parts]
                last = parts[-1]
                exact, reached = 0, 0
                for x in spans:
                    exact += max(0, x["e"] - max(x["s"] - 1, reached))
                    reached = max(reached, x["e"])
                rows.append((rid, other, spans[0]["s"], reached, parts[0][1], last[1] + last[2] + k - 2, exact, score, spans))
        yield pd.DataFrame(rows, columns=names)


def shared_ranges(passages: DataFrame) -> DataFrame:
    """Longest unbroken ranges of lines covered by exact blocks: record_id, start_line, end_line."""
    spans = passages.select("record_id", F.inline("blocks")).distinct()
    by = Window.partitionBy("record_id").orderBy("s", "e")
    spans = spans.withColumn("far", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.count(F.when(F.col("far").isNull() | (F.col("s") > F.col("far") + 1), 1)).over(by))
    return spans.groupBy("record_id", "island").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line")).drop("island")


def shared_shares(df: DataFrame, record_id: Column, text: Column, ranges: DataFrame) -> DataFrame:
    """For every record its lines, those in shared ranges and their share (0 for a record without lines)."""
    rows = df.select(record_id.cast("long").alias("record_id"), text.alias("__t")).where("record_id is not null and __t is not null")
    n = F.size(F.split("__t", "\n", -1)) - F.when(F.col("__t").endswith("\n") | (F.col("__t") == ""), 1).otherwise(0)
    lines = rows.groupBy("record_id").agg(F.max(n).cast("long").alias("n_lines"))
    got = ranges.groupBy("record_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("shared_lines"))
    out = lines.join(got, "record_id", "left").withColumn("shared_lines", F.coalesce("shared_lines", F.lit(0)))
    return out.withColumn("share", F.when(F.col("n_lines") > 0, F.col("shared_lines") / F.col("n_lines")).otherwise(0.0))
