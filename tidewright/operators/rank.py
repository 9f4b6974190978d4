"""Row numbers and running sums that never gather one key's rows in one task.

A window over (key) sorts all rows of a key in a single task. Here only keys of up to `limit` rows take that way;
the rest are range-partitioned on (key, order), numbered inside each range and shifted by the rows that came before
it. Both ways are exact; nothing is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _names(order: list[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [o if isinstance(o, tuple) else (o, "asc_nulls_last") for o in order]


def _cols(order: list[tuple[str, str]]) -> list[Column]:
    return [getattr(F.col(c), how)() for c, how in order]


def ranged_running(df: DataFrame, keys: list[str], order: list, value: Column, out: str, partitions: int | None = None) -> DataFrame:
    """Running sum of `value` (1 gives row numbers) in `order` inside `keys`, by ranges of (keys, order).

    Ties in `order` are broken as the range sort leaves them, so give a unique order. Null keys form a key of their own.
    An empty table gives an empty table.
    """
    order = _names(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k).asc_nulls_first() for k in keys] + _cols(order)
    # the range of a row must be the same in both uses below, so it is written down once
    ranged = cut(
        df.withColumn("_tw_v", value.cast("long"))
        .repartitionByRange(n, *sort)
        .withColumn("_tw_p", F.spark_partition_id())
    )
    sums = ranged.groupBy(*keys, "_tw_p").agg(F.sum("_tw_v").alias("_tw_s"))
    # at most (number of ranges) rows a key
    before = Window.partitionBy(*keys).orderBy("_tw_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(keys)], F.col("_tw_p").alias("_tw_q"), F.coalesce(F.sum("_tw_s").over(before), F.lit(0)).alias("_tw_o"))
    offsets = offsets.where("_tw_o > 0")
    inside = Window.partitionBy("_tw_p", *keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    cond = (F.col("_tw_p") == F.col("_tw_q"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_tw_k{i}"))
    return (
        ranged.withColumn("_tw_r", F.sum("_tw_v").over(inside))
        .join(offsets, cond, "left")
        .withColumn(out, F.col("_tw_r") + F.coalesce(F.col("_tw_o"), F.lit(0)))
        .drop("_tw_v", "_tw_p", "_tw_r", "_tw_q", "_tw_o", *[f"_tw_k{i}" for i in range(len(keys))])
    )


def skew_safe_row_number(df: DataFrame, key: str, size: str, order: list, out: str, limit: int = 200_000) -> DataFrame:
    """row_number() over (partition by key order by order), where `size` holds the number of rows of the key.

    Keys of more than `limit` rows are numbered by ranges. The second branch is only built if such a key exists.
    """
    ordered = _names(order)
    small = df.where(F.col(size) <= limit).withColumn(
        out, F.row_number().over(Window.partitionBy(key).orderBy(*_cols(ordered))).cast("int")
    )
    hot = df.where(F.col(size) > limit)
    if not hot.take(1):
        return small
    return small.unionByName(ranged_running(hot, [key], order, F.lit(1), out).withColumn(out, F.col(out).cast("int")))
