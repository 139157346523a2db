"""Per-key results when a few keys hold most records.

Every summary here is algebraic (count, sum, min, max), so Spark's partial aggregation is the bounded
per-task hash table: a key that fills a third of the input leaves each task as one row, and only those
compact states are shuffled. No row is ever gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, row_id: Column, keys: dict[str, Column], value: Column | None) -> DataFrame:
    """One row per record id: re-delivered rows, equal in id, keys and value, collapse.

    The one exchange is by record id, so it is even whatever the keys hold, and counts of ids reuse it.
    """
    cols = [row_id.alias("__id"), *(c.alias(f"__k{i}") for i, c in enumerate(keys.values()))]
    if value is not None:
        cols.append(value.alias("__v"))
    return df.select(*cols).where(F.col("__id").isNotNull()).repartition("__id").distinct()


def _stacked(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    pairs = ", ".join(f"'{name}', __k{i}" for i, name in enumerate(keys))
    rest = [c for c in ("__id", "__v") if c in rows.columns]
    return rows.select(*rest, F.expr(f"stack({len(keys)}, {pairs}) as (key_field, key_value)")).where(F.col("key_value").isNotNull())


def key_summaries(df: DataFrame, row_id: Column, keys: dict[str, Column], value: Column) -> DataFrame:
    """Count and summaries of ``value`` for every value of every key field.

    Returns key_field, key_value, n_rows, n_scored, min_score, max_score, sum_score, mean_score.
    A record delivered several times counts once; a record without an id or, for one field, without a
    key takes no part in it; a null value counts in n_rows only; an empty table gives no rows.
    """
    rows = _stacked(distinct_rows(df, row_id, keys, value), keys)
    agg = rows.groupBy("key_field", "key_value").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("__v").alias("n_scored"),
        F.min("__v").alias("min_score"),
        F.max("__v").alias("max_score"),
        F.sum("__v").alias("sum_score"),
    )
    return agg.withColumn("mean_score", F.when(F.col("n_scored") > 0, F.col("sum_score") / F.col("n_scored")))


def heavy_keys(df: DataFrame, row_id: Column, keys: dict[str, Column], share: float = 0.03) -> DataFrame:
    """The key values found on at least ``share`` of the distinct record ids: key_field, key_value, n_rows, share.

    At most ``1 / share`` values per field can qualify. A record counts once for a key however often it
    is delivered. The total is a scalar subquery over the same exchange, one number, never a join.
    """
    rows = distinct_rows(df, row_id, keys, None)
    total = rows.agg(F.count_distinct("__id").alias("n")).scalar()
    counts = _stacked(rows, keys).groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("__total", total).where(F.col("n_rows") >= F.lit(share) * F.col("__total")).select("key_field", "key_value", "n_rows", (F.col("n_rows") / F.col("__total")).alias("share"))
