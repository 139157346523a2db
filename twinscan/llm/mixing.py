"""Mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. A source's token budget first takes complete epochs of the source; the
rest of the budget takes documents in the order of exponential keys scaled by quality weights, prefix-summed
up to the budget. The prefix sums work on buckets of keys: small bucket totals are accumulated, the one bucket in
which a source's budget ends is split into buckets again until it is small, and only its rows are sorted. A source
that holds a third of all rows is never gathered in one task, however its keys are spread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.llm.tokens import VOCABULARY, token_count
from twinscan.plans.scratch import cut

BUCKETS = 4096
EDGE_ROWS = 20_000  # rows of one source that are sorted in one task
MOST_SOURCES = 10_000


_LETTERS = bytes([32, *range(65, 91), *range(97, 123), *range(128, 256)])  # ASCII letters, blanks, all of any other character
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,:;!?'\"-")
_LINE_END = re.compile(rb"([^\d\s])[ \t\r]*(?:\n|\Z)")
_ENDS = frozenset(b".!?,:;-\"')]\xa6\x93\x94\xbb\x99\x9d")  # the last bytes of sentence and clause marks and closing quotes


def quality(text: str) -> float:
    """Quality weight of a document in 0.1..1: the share of its text lines that end in a mark of a sentence or clause, and the
    share of letters among letters and unusual marks, half each. Timing lines and numbers end in digits and are no text lines."""
    data = text.encode("utf-8", "surrogatepass")
    ends = _LINE_END.findall(data)
    if not ends:
        return 0.1
    letters = len(data) - len(data.translate(None, _LETTERS))
    marks = len(data) - len(data.translate(None, _MARKS)) - data.count(b"-->")
    ended = sum(e[0] in _ENDS for e in ends) / len(ends)
    return min(1.0, max(0.1, (ended + letters / max(1, letters + marks)) / 2))


def _counted(batches: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"id": batch["id"], "source": batch["source"], "tokens": [token_count(t, vocabulary) for t in batch["t"]], "weight": [quality(t) for t in batch["t"]]}
        yield pd.DataFrame(out).astype({"tokens": "int64", "weight": "float64"})


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Token budget of each target source.

    Without ``total``, the largest total at which no source with documents needs more than its most
    repeats. A target source without documents gets nothing, and its share stays empty.
    """
    real = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    most = min((int(r * available[s] / share) for s, (share, r) in real.items()), default=0)
    total = most if total is None else total
    return {s: min(int(share * total), r * available[s]) for s, (share, r) in real.items()}


def _edges(keyed: DataFrame, plan: list[tuple[str, int, int]], rows: int = EDGE_ROWS) -> DataFrame:
    """source, epochs, rest, lo, hi, before: the stretch of places in which the rest of a source's budget ends, with at most
    ``rows`` rows, and the tokens before it.

    Each round splits the stretches into buckets; only the one bucket of each source that holds the end (at most
    MOST_SOURCES rows) comes to the driver. Places that differ in nothing a double can tell stay together.
    """
    spark = keyed.sparkSession
    schema = "source string, epochs long, rest long, lo double, hi double, before long"
    known = {s: (s, e, r, 0.0, 1.0, 0) for s, e, r in plan}
    todo = dict(known)
    while todo:
        at = F.broadcast(spark.createDataFrame(list(todo.values()), schema))
        inside = keyed.join(at, "source").where("place >= lo and place < hi")
        step = (F.col("hi") - F.col("lo")) / BUCKETS
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("place") - F.col("lo")) / step).cast("int"))
        totals = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("b"), F.count(F.lit(1)).alias("n"), F.min("place").alias("least"), F.max("place").alias("most"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        totals = totals.withColumn("upto", F.col("before") + F.sum("b").over(Window.partitionBy("source").orderBy("bucket")))  # at most BUCKETS rows a source
        last = totals.where("upto > rest").groupBy("source").agg(F.min_by(F.struct("n", "least", "most", (F.col("upto") - F.col("b")).alias("before")), "bucket").alias("x")).select("source", "x.*")
        more = {}
        for x in last.collect():  # rest < available, so every source with a budget has a last bucket
            s, e, r, *_ = known[x["source"]]
            known[s] = (s, e, r, x["least"], math.nextafter(x["most"], 2.0), x["before"])
            if x["n"] > rows and x["most"] > x["least"]:
                more[s] = known[s]
        todo = more
    return spark.createDataFrame(list(known.values()), schema)


def mix(
    docs: DataFrame, doc_id: Column, text: Column, source: Column, targets: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for ``targets``(source, target_share, max_repeats).

    selection: doc_id, source, n_tokens, copies; report: source, target_share, max_repeats,
    available_tokens, budget_tokens, selected_tokens, reached_share (of all selected tokens).
    A source misses its budget by less than one document, falling short, never exceeding it.

    Defined results: null ids, null texts, texts without tokens, null sources and sources without a
    target take no part; repeated rows of one id count once; a target with a null or non-positive share
    or repeats selects nothing; empty tables give an empty selection. Other columns play no part.
    """
    named = targets.select(F.col("source").alias("s"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("r")).where("s is not null")
    wanted = named.limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    goal = {x["s"]: (x["share"] or 0.0, x["r"] or 0) for x in wanted}
    spark = docs.sparkSession
    rows = docs.select(doc_id.cast("long").alias("id"), source.alias("source"), text.alias("t")).where("id is not null and t is not null and source is not null")
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    counted = rows.join(F.broadcast(names), "source", "left_semi").mapInPandas(lambda it: _counted(it, vocabulary), "id long, source string, tokens long, weight double").where("tokens > 0")
    counted = cut(counted.dropDuplicates(["id"]), "counted")
    available = {x["source"]: x["n"] for x in counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    budget = budgets(available, goal, total)
    plan = [(s, b // available[s], b % available[s]) for s, b in budget.items()]
    unit = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    key = -F.log(unit) / F.col("weight")
    keyed = counted.withColumn("place", key / (1 + key))  # in 0..1, in order of the keys
    edges = _edges(keyed, plan)
    marked = keyed.join(F.broadcast(edges), "source")
    edge = marked.where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    order = Window.partitionBy("source").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    sides = marked.where((F.col("place") < F.col("lo")) | (F.col("place") >= F.col("hi"))).withColumn("extra", (F.col("place") < F.col("lo")).cast("int"))
    chosen = sides.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra")).where("copies > 0")
    selection = cut(chosen.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.col("copies").cast("long").alias("copies")), "selection")

    got = {x["source"]: x["n"] for x in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    everything = sum(got.values())
    lines = [(s, float(share), int(r), int(available.get(s, 0)), int(budget.get(s, 0)), int(got.get(s, 0)), got.get(s, 0) / everything if everything else 0.0) for s, (share, r) in sorted(goal.items())]
    report = spark.createDataFrame(lines, "source string, target_share double, max_repeats long, available_tokens long, budget_tokens long, selected_tokens long, reached_share double")
    return selection, report


def mixing_checks(docs: DataFrame, doc_id: Column, text: Column, source: Column, selection: DataFrame, report: DataFrame) -> DataFrame:
    """Per target source what a mixture must keep: n_documents (with text), repeats_kept (no document more often than
    allowed) and budget_kept (no more tokens than the budget)."""
    rows = docs.select(doc_id.cast("long").alias("doc_id"), source.alias("source"), text.alias("t")).where("doc_id is not null and t <> ''").select("doc_id", "source").distinct()
    have = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    used = selection.groupBy("source").agg(F.max("copies").alias("most"))
    out = report.join(have, "source", "left").join(used, "source", "left")
    kept = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    return out.select("source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), kept.alias("repeats_kept"), (F.col("selected_tokens") <= F.col("budget_tokens")).alias("budget_kept"))
