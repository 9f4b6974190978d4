"""Reproducible samples: rows ordered by a hash of key and seed, so that the same rows come out on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .rank import skew_safe_row_number


def hash_order(key: Column, seed: int) -> Column:
    """A hash that other engines have as well: sha256 of seed, colon and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of the least hash; repeated keys are taken together in unspecified order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


#: Parts of a stratum that are ranked by themselves first.
PARTS = 64


def first_of(df: DataFrame, stratum: str, order: list, n: Column) -> DataFrame:
    """df with `_r`: the first n rows of each stratum in `order`, numbered; n is the same in a stratum and small.

    Each of PARTS parts of a stratum keeps its first n, so that a hot one is never sorted in one task; at most n rows a
    part meet in the end.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
    inner = Window.partitionBy(stratum, "_part").orderBy(*order)
    few = df.withColumn("_part", part).withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= n).drop("_part")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= n)


def sample_per_stratum(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """The n rows of the least hash of every stratum; a null stratum is one of its own."""
    return first_of(df, stratum, [hash_order(F.col(key), seed), F.col(key)], F.lit(n)).drop("_r")


def quota_sample(df: DataFrame, key: str, bucket: str, quotas: dict[str, int], size: int, seed: int) -> DataFrame:
    """Up to its quota from every bucket, then, if rows are missing to `size`, others of the least hash of seed + 99.

    The rest is ranked by the other hash over all rows that aren't chosen; `size` rows of it are all that may be needed.
    """
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]) if quotas else F.create_map().cast("map<string,int>")
    chosen = first_of(df, bucket, [hash_order(F.col(key), seed), F.col(key)], F.coalesce(q[F.col(bucket)], F.lit(0))).drop("_r")
    chosen = cut(chosen.limit(max(1, sum(quotas.values()))))  # as many rows as the quotas allow
    missing = max(0, size - chosen.count())
    rest = df.join(F.broadcast(chosen.select(key)), key, "left_anti").orderBy(hash_order(F.col(key), seed + 99), key).limit(missing)
    return chosen.unionByName(rest)


def round_robin(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows, taken in turn from the strata in their order, inside each by hash."""
    return first_of(df, stratum, [hash_order(F.col(key), seed), F.col(key)], F.lit(n)).orderBy("_r", stratum).limit(n).drop("_r")


def first_per_label_then_fill(df: DataFrame, key: str, label: str, priority: str, n: int) -> DataFrame:
    """The first row of each label by priority and key, then the rest in the same order, n in all."""
    order = [F.col(priority), F.col(key)]
    first = first_of(df, label, order, F.lit(n)).withColumn("_f", (F.col("_r") > 1).cast("int"))
    return first.orderBy("_f", priority, key).limit(n).drop("_f", "_r")


def stratified_split(df: DataFrame, key: str, label: str, validation: float, seed: int, hot: int = 200_000) -> DataFrame:
    """df with `part`: of each label the share `validation`, rounded half to even, goes to validation.

    Labels of more than `hot` rows are ranked by ranges. A null label is one of its own.
    """
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    d = df.withColumn("_h", hash_order(F.col(key), seed)).join(sizes, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    r = skew_safe_row_number(d, label, "_n", ["_h", key], "_r", hot)
    return r.withColumn("part", F.when(F.col("_r") <= F.bround(F.col("_n") * validation), "validation").otherwise("train")).drop("_h", "_n", "_r")


def permuted(df: DataFrame, key: str, values: list[str], out: str = "permuted") -> DataFrame:
    """df with the values in an order drawn by the hash of key and value (blinding)."""
    pairs = F.array(*[F.struct(F.sha2(F.concat(F.col(key).cast("string"), F.lit(v)), 256).alias("h"), F.lit(v).alias("v")) for v in values])
    return df.withColumn(out, F.transform(F.array_sort(pairs), lambda x: x["v"]))


def next_unlabelled(df: DataFrame, position: str, complete: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(complete), F.lit(False))).orderBy(position).limit(1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def priority_selection(df: DataFrame, key: str, groups: list[tuple[str, Column, Column]], fill: tuple[str, Column, Column], n: int) -> DataFrame:
    """One unused row for each group in order of priority, then fill rows up to n (a top-n report).

    A group is (name, condition, order). Each pick excludes the keys picked before.
    """
    used: list = []
    parts = []
    for name, cond, order in groups:
        pick = df.where(cond & ~F.col(key).isin(used) if used else cond).orderBy(order, key).limit(1)
        keys = [r[0] for r in pick.select(key).collect()]  # one key
        if keys:
            used += keys
            parts.append(pick.withColumn("category", F.lit(name)))
    name, cond, order = fill
    if len(parts) < n:
        parts.append(df.where(cond & ~F.col(key).isin(used) if used else cond).orderBy(order, key).limit(n - len(parts)).withColumn("category", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
