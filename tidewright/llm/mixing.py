"""Problem 9: mix sources to target shares of all tokens along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1] that integrates to its share. A document's place is
the time at which its source's cumulative demand reaches the tokens before it: the schedule is integrated and
inverted in closed form, and the documents are range-sorted by that time. Running sums of tokens go over ranges, so
no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import ranged_running
from ..session import cut

#: Up to so many sources the table of demands is broadcast; beyond, the planner joins as it sees fit.
BROADCAST_SOURCES = 100_000


def demands(sizes: DataFrame, weights: DataFrame, total_tokens: float | None = None, ramp: float = 0.5) -> DataFrame:
    """One row a listed source: share, demand in tokens, epochs and slope of its schedule.

    Shares are scaled to those sources that have tokens. Without `total_tokens` the total is the largest for which
    every source meets its share within max_repeats; with it, sources that can't are used max_repeats times whole.
    Sources that may repeat gain weight linearly, by `ramp` of their share at the end; the others lose it, so that
    the weights add up to 1 at every time.
    """
    w = weights.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = w.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("max_repeats", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))))
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    j = j.withColumn("live", F.coalesce(live, F.lit(False)))
    rep = F.col("live") & (F.col("max_repeats") > 1)
    one = j.agg(
        F.sum(F.when(F.col("live"), F.col("target_share"))).alias("whole"),
        F.min(F.when(F.col("live"), F.col("available") * F.col("max_repeats") / F.col("target_share"))).alias("least"),
        F.sum(F.when(rep, F.col("target_share")).otherwise(0.0)).alias("repeating"),
    )
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("least") * F.col("whole")
    once = F.col("whole") - F.col("repeating")
    d = j.crossJoin(F.broadcast(one))  # one row
    d = d.withColumn("share", F.when(F.col("live"), F.col("target_share") / F.col("whole")).otherwise(0.0))
    d = d.withColumn("demand", F.least(F.col("share") * total, (F.col("available") * F.col("max_repeats")).cast("double")))
    # weight(t) = share * (1 + slope * (1 - 2t)); a slope in [-1, 1] keeps it from falling below nothing
    slope = F.when((once <= 0) | (F.col("repeating") <= 0), 0.0).when(rep, -F.lit(ramp) * F.least(F.lit(1.0), once / F.col("repeating"))).otherwise(
        F.lit(ramp) * F.least(F.lit(1.0), F.col("repeating") / once)
    )
    return d.withColumn("slope", slope).withColumn("epochs", F.when(F.col("live"), F.ceil(F.col("demand") / F.col("available"))).otherwise(0).cast("int")).select(
        "source", "target_share", "max_repeats", "available", "share", "demand", "slope", "epochs"
    )


def arrival(used: Column, slope: Column) -> Column:
    """The time t at which the part `used` of a source's demand is reached: the inverse of t + slope * t * (1 - t)."""
    b = 1 + slope
    return F.coalesce(F.try_divide(2 * used, b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * slope * used))), F.lit(0.0))


def mix(docs: DataFrame, weights: DataFrame, total_tokens: float | None = None, seed: int = 7, ramp: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(placed, shares) from docs (doc_id, source, tokens) and weights (source, target_share, max_repeats).

    placed: (position, doc_id, source, repeat, tokens, at) of every use of a document, in training order. A source's
    documents come in the order of a hash, once a round, and each round is used up before the next; the last use may
    exceed the demand by less than one document. Documents without tokens, of null or unlisted sources, and beyond
    the demand aren't placed. shares: one row a source of either table with its target and actual share. Repeated
    doc_ids count as given; repeated sources in weights take the largest values; empty tables give no places.
    """
    base = cut(docs.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    sizes = base.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    sizes = cut(sizes)
    plan = cut(demands(sizes.where("source is not null"), weights, total_tokens, ramp))
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast(plan) if few else plan
    used = base.where("tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).join(small.where("epochs > 0"), "source")
    run = ranged_running(used, ["source"], ["h", "doc_id"], F.col("tokens"), "upto")
    uses = run.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    start = (F.col("repeat") - 1) * F.col("available") + F.col("upto") - F.col("tokens")
    uses = uses.withColumn("start", start).where("start < demand")
    at = arrival(F.col("start") / F.col("demand"), F.col("slope"))
    uses = uses.select("doc_id", "source", "repeat", "tokens", at.alias("at"))
    placed = ranged_running(uses, [], ["at", "source", "doc_id", "repeat"], F.lit(1), "position").select("position", "doc_id", "source", "repeat", "tokens", "at")
    got = uses.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("uses"), F.max("repeat").alias("most_repeats"))
    s = plan.select("source", "target_share", "max_repeats").join(sizes.select("source", "documents", "available").where("source is not null"), "source", "full").join(got, "source", "left")
    s = s.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    whole = s.agg(F.sum("used_tokens").alias("all_tokens"))
    shares = s.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0))).drop("all_tokens")
    return placed, shares
