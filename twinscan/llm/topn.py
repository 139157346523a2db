"""Top N rows within every group, by a hot-cold split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 4  # a group is hot from this part of a task's even share on


def top_n_per_group(
    df: DataFrame,
    groups: dict[str, Column],
    score: Column,
    tie: Column,
    n: int = 5,
    hot_rows: int | None = None,
) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, equal scores in order of ``tie``.

    Method: exact group counts split the groups. A group with more than ``hot_rows`` rows is hot: its rows get a
    salt from ``tie``, one for every ``hot_rows`` rows, and are range-partitioned by group and salt, so that the
    group spreads over as many sorted ranges as its count needs; each range keeps its first ``n`` and one small
    window merges those. All other groups go through one ordinary window. The two results are united.

    By default ``hot_rows`` is a quarter of a task's even share: rows / (PIECES * shuffle partitions). It follows the
    input, so the split behaves alike at every size, and at most PIECES * partitions groups can be hot: the hot list
    is broadcast. A given ``hot_rows`` is raised to rows / 20,000 where it would break such a bound.

    Defined results: rows with a null group column, null or NaN score or null tie take no part; repeated
    rows (same group, score and tie) count once, which is why the windows rank densely; a group with
    fewer rows comes out whole; an empty table gives no rows. Returned columns: the groups, ``score``,
    ``tie``, ``rank`` (from 1). Other columns of ``df``, whatever their names, play no part.
    """
    names = list(groups)
    g = [f"__g{i}" for i in range(len(names))]
    rows = df.select(*(c.alias(a) for c, a in zip(groups.values(), g)), score.cast("double").alias("__score"), tie.alias("__tie"))
    need = F.col("__tie").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score")
    for a in g:
        need &= F.col(a).isNotNull()
    rows = rows.where(need)

    counts = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = PIECES * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = total / F.lit(parts) if hot_rows is None else F.greatest(F.lit(float(hot_rows)), total / F.lit(20_000))
    hot = counts.withColumn("__limit", F.greatest(F.lit(1.0), limit)).where(F.col("__n") > F.col("__limit")).withColumn("__salts", F.ceil(F.col("__n") / F.col("__limit")).cast("int")).select(*g, "__salts")
    tagged = rows.join(F.broadcast(hot), g, "left")

    order = (F.col("__score").desc(), F.col("__tie").asc())
    light = tagged.where(F.col("__salts").isNull()).select(*g, "__score", "__tie")
    light = light.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*g).orderBy(*order))).where(F.col("__rank") <= n)

    heavy = tagged.where(F.col("__salts").isNotNull()).withColumn("__salt", F.pmod(F.xxhash64("__tie"), F.col("__salts")))
    heavy = heavy.repartitionByRange(*g, "__salt")
    heavy = heavy.withColumn("__part", F.dense_rank().over(Window.partitionBy(*g, "__salt").orderBy(*order))).where(F.col("__part") <= n)
    heavy = heavy.select(*g, "__score", "__tie").withColumn("__rank", F.dense_rank().over(Window.partitionBy(*g).orderBy(*order))).where(F.col("__rank") <= n)

    both = light.unionByName(heavy).distinct()
    return both.select(*(F.col(a).alias(x) for a, x in zip(g, names)), F.col("__score").alias("score"), F.col("__tie").alias("tie"), F.col("__rank").alias("rank"))
