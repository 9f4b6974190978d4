"""Checks as tables: every rule gives a row with the number of failures, so that all are seen at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rule_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures): rows for which a rule's condition is false or null, all rules in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules])).alias("r")).select("r.*")


def require(failures: DataFrame) -> None:
    """Raise one error that names every rule that failed."""
    bad = failures.where("failures > 0").orderBy("rule").collect()  # one row a rule
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['failures']}" for r in bad))


def require_columns(df: DataFrame, names: list[str], exact: bool = False) -> None:
    """All columns present, or, if exact, these in this order and no others."""
    if exact and df.columns != names:
        raise ValueError(f"columns are {df.columns}, not {names}")
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df cast column by column to a schema; what can't be cast becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def bad_values(df: DataFrame, schema: StructType) -> DataFrame:
    """(column, failures): values that are neither null nor blank and can't be cast."""
    return rule_failures(df, {f.name: F.col(f.name).isNull() | (F.trim(F.col(f.name).cast("string")) == "") | F.col(f.name).try_cast(f.dataType).isNotNull() for f in schema.fields}).withColumnRenamed("rule", "column")


def unknown_values(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Distinct values of df that the first column of `allowed` lacks."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().join(allowed.select(F.col(allowed.columns[0]).alias("value")), "value", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique on both sides."""
    for name, side in (("left", left), ("right", right)):
        if duplicate_keys(side, [key]).take(1):
            raise ValueError(f"{key} isn't unique on the {name} side")
    return left.join(right, key)


def membership(sets: dict[str, DataFrame], namespace: str | None = None) -> DataFrame:
    """(id, in_<name>...): every id of any set with a flag for each, by one union and one aggregate.

    With a namespace, ids are replaced by the sha256 of namespace, colon and id.
    """
    tagged = [d.select(F.col(d.columns[0]).cast("string").alias("id"), F.lit(n).alias("s")).where("id is not null") for n, d in sets.items()]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    key = F.sha2(F.concat(F.lit(namespace + ":"), "id"), 256) if namespace else F.col("id")
    return u.groupBy("id").agg(*[F.bool_or(F.col("s") == n).alias(f"in_{n}") for n in sets]).withColumn("id", key)


def overlap_counts(m: DataFrame, base: str) -> DataFrame:
    """One row: sizes of all sets and of their overlaps with `base`."""
    names = [c[3:] for c in m.columns if c.startswith("in_")]
    return m.agg(*[F.count_if(f"in_{n}").alias(f"n_{n}") for n in names], *[F.count_if(F.col(f"in_{base}") & F.col(f"in_{n}")).alias(f"{base}_and_{n}") for n in names if n != base])


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct rows of both, of their intersection and of either difference; and whether a is in b."""
    x, y = a.distinct().withColumn("_a", F.lit(1)), b.distinct().withColumn("_b", F.lit(1))
    j = x.join(y, a.columns, "full")
    return j.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")).withColumn("subset", F.col("only_left") == 0)


def same_order(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """Positions at which two lists differ, or that one lacks."""
    x, y = a.select(position, F.col(value).alias("left_value")), b.select(position, F.col(value).alias("right_value"))
    return x.join(y, position, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: how many keys of both tables differ in each field; nulls are equal."""
    j = before.select(key, F.struct(*fields).alias("b")).join(after.select(key, F.struct(*fields).alias("a")), key)
    return j.agg(F.count("*").alias("compared"), *[F.count_if(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))).alias(f"changed_{f}") for f in fields])


def within_tolerance(frozen: DataFrame, again: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than the tolerance or that one side lacks."""
    j = frozen.select(key, F.col(value).alias("frozen")).join(again.select(key, F.col(value).alias("again")), key, "full")
    return j.where(~F.coalesce(F.abs(F.col("frozen") - F.col("again")) <= tolerance, F.col("frozen").isNull() & F.col("again").isNull()))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, content_hash: str) -> DataFrame:
    """requests with `state`: hit, mismatch (same key, other content) or miss."""
    c = cache.select(F.col(key), F.col(content_hash).alias("_cached"))
    return requests.join(c, key, "left").withColumn("state", F.when(F.col("_cached").isNull(), "miss").when(F.col("_cached") == F.col(content_hash), "hit").otherwise("mismatch")).drop("_cached")


def upsert(current: DataFrame, update: DataFrame, key: str, now: Column, first_time: str = "labeled_at", last_time: str = "updated_at") -> DataFrame:
    """current with the rows of update taken over by key: the first time is kept, the last one moved; new keys are added."""
    cols = [c for c in update.columns if c != key]
    u = update.select(key, F.struct(*cols).alias("_u"))
    j = current.join(u, key, "full")
    hit = F.col("_u").isNotNull()
    out = []
    for c in current.columns:
        if c == first_time:
            out.append(F.when(hit, F.coalesce(F.col(c), now)).otherwise(F.col(c)).alias(c))
        elif c == last_time:
            out.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        elif c in cols:
            out.append(F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def latest(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of prior whose key new lacks."""
    return new.unionByName(prior.join(new.select(key), key, "left_anti").select(*new.columns))
