"""Near-duplicate records with small edits: min-max hashing, banding, exact verification, groups.

Min-max hashing keeps both the minimum and the maximum of the shingle hashes under each permutation, so
``PERMUTATIONS`` evaluations give twice as many signature values, each an unbiased indicator of likeness
(two values of one permutation are negatively correlated, which lowers the variance). Bands of the
signature propose pairs, one bit of every value screens them inside the join, and the exact likeness of
the whole texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.components import connected_groups
from twinscan.llm.shingles import mix, shingle_sets
from twinscan.operators.pairs import salted_join
from twinscan.plans.scratch import cut

PERMUTATIONS = 64
ROWS_PER_BAND = 4  # 32 bands: a pair of likeness 0.7 is missed with probability 1.5e-4, of 0.75 with 5e-6
SCREEN_BITS = 36  # of 128 one-bit values; likeness 0.7 differs in 19 +- 4, so 36 is beyond four deviations
LEAST = 0.7  # the bands and the screen are made for likenesses from here on
SIGNATURE = "id long, f1 long, f2 long, n int, x long, y long, bands array<long>"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919)
    return rng.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32)


def min_max(h: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minima, then maxima, of the shingle hashes under every permutation (``2 * PERMUTATIONS`` values)."""
    a, b = _multipliers()
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), block):  # a text of any length, in cache-sized pieces
        v = short[None, i : i + block] * a + b
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate([low, high])


def _signatures(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    # One permutation's two values go to different bands, so that a band's values stay independent.
    order = np.random.default_rng(104729).permutation(2 * PERMUTATIONS)
    salt = mix(np.arange(1, 2 * PERMUTATIONS // ROWS_PER_BAND + 1, dtype=np.uint64))
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        rows = []
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            for rid, h in zip(part["id"], shingle_sets(part["t"].tolist(), k)):
                if len(h) == 0:
                    continue
                sig = min_max(h)[order]
                bits = (sig >> np.uint32(13)) & np.uint32(1)
                x, y = (bits.reshape(2, 64).astype(np.uint64) * weights).sum(axis=1)
                band = salt.copy()
                for v in sig.reshape(-1, ROWS_PER_BAND).T:
                    band = mix(band ^ v)
                rows.append((rid, h.sum().view(np.int64), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64), len(h), x.view(np.int64), y.view(np.int64), band.view(np.int64)))
        yield pd.DataFrame(rows, columns=["id", "f1", "f2", "n", "x", "y", "bands"])


def _verified(batches: Iterator[pd.DataFrame], k: int, threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for at in range(0, len(batch), 128):
            part = batch.iloc[at : at + 128]
            left, right = shingle_sets(part["lt"].tolist(), k), shingle_sets(part["rt"].tolist(), k)
            for l, r, p, q in zip(part["l"], part["r"], left, right):
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                if union and both / union >= threshold:
                    keep.append((l, r, both / union))
        yield pd.DataFrame(keep, columns=["l", "r", "likeness"])


def near_duplicates(df: DataFrame, record_id: Column, text: Column, k: int = 5, threshold: float = 0.8, screen_bits: int | None = SCREEN_BITS) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal shingle sets, and the members of every class.

    Returns (links, members): links(l, r, likeness) with l < r, class ids being the smallest record id of
    the class; members(class_id, record_id). ``screen_bits`` is how many of 128 one-bit values may differ in a
    candidate; None switches that screen off. Thresholds below ``LEAST`` raise ValueError. Likeness is the Jaccard index of the distinct runs of ``k``
    tokens. Copies are one class and never proposed as pairs, so a text copied into a third of all rows
    costs one signature row per copy.

    Defined results: null ids or texts take no part; repeated rows of one id count once; a text with
    fewer than ``k`` tokens has no shingles, belongs to no class and has no links; an empty table gives
    no rows; whole texts are used whatever their length. Other columns play no part.
    """
    if threshold < LEAST:
        raise ValueError(f"the bands are made for likenesses of {LEAST} or more")
    texts = df.select(record_id.cast("long").alias("id"), text.alias("t")).where("id is not null and t is not null")
    sigs = cut(texts.mapInPandas(lambda it: _signatures(it, k), SIGNATURE), "signatures")
    ids = sigs.groupBy("f1", "f2", "n").agg(F.min("id").alias("class_id"))
    members = cut(sigs.select("id", "f1", "f2", "n").join(ids, ["f1", "f2", "n"]).select("class_id", F.col("id").alias("record_id")).distinct(), "members")

    reps = sigs.join(members.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi")
    banded = reps.select("id", "n", "x", "y", F.explode("bands").alias("band"))
    whole = F.struct("id", "n", "x", "y")
    pairs = salted_join(banded.select("band", whole.alias("l")), banded.select("band", whole.alias("r")), ["band"])
    keep = (F.col("l.id") < F.col("r.id")) & (F.col("l.n") >= threshold * F.col("r.n")) & (F.col("r.n") >= threshold * F.col("l.n"))
    if screen_bits is not None:
        keep &= (F.bit_count(F.col("l.x").bitwiseXOR(F.col("r.x"))) + F.bit_count(F.col("l.y").bitwiseXOR(F.col("r.y")))) <= screen_bits
    pairs = cut(pairs.where(keep).select(F.col("l.id").alias("l"), F.col("r.id").alias("r")).distinct(), "candidates")

    wanted = pairs.select(F.col("l").alias("id")).union(pairs.select("r")).distinct()
    bodies = texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("t").alias("t"))
    full = pairs.join(bodies.select(F.col("id").alias("l"), F.col("t").alias("lt")), "l").join(bodies.select(F.col("id").alias("r"), F.col("t").alias("rt")), "r")
    links = full.mapInPandas(lambda it: _verified(it, k, threshold), "l long, r long, likeness double")
    return links, members


def expand_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """All record pairs the links and classes stand for: left_id < right_id.

    Quadratic in the copies of a text by its nature (``near_duplicate_groups`` is linear); a class of many copies
    is split over tasks.
    """
    inside = salted_join(members.select("class_id", F.col("record_id").alias("left_id")), members.select("class_id", F.col("record_id").alias("right_id")), ["class_id"])
    inside = inside.where("left_id < right_id").select("left_id", "right_id")
    a = members.select(F.col("class_id").alias("l"), F.col("record_id").alias("p"))
    b = members.select(F.col("class_id").alias("r"), F.col("record_id").alias("q"))
    across = links.join(a, "l").join(b, "r").select(F.least("p", "q").alias("left_id"), F.greatest("p", "q").alias("right_id"))
    return inside.unionByName(across)


def near_duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """Group of every record with a copy or a near duplicate: record_id, class_id, group_id, n_links (of its class)."""
    groups = connected_groups(links, F.col("l"), F.col("r")).select(F.col("unit_id").alias("class_id"), "group_id")
    degree = links.select(F.col("l").alias("class_id")).union(links.select("r")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    out = members.join(copies, "class_id").join(groups, "class_id", "left").join(degree, "class_id", "left")
    out = out.where("n > 1 or group_id is not null")
    return out.select("record_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
