"""Problem 5: one group id for all records linked directly or indirectly, by random contraction of the graph.

Every round each vertex hooks to the neighbour (or itself) whose fresh hash is least, the edges are relabelled to the
hooks and made distinct, until no edge is left; then the rounds' mappings are expanded from the last to the first.
The graph shrinks by a constant factor a round whatever its shape, so long chains need only about log(n) rounds, and
a vertex with a third of all edges is one partial aggregate a task. Nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id, id_order
from ..operators.packed import account, split_packed
from ..session import cut, drop_cut, scratch


def contract(edges: DataFrame, left: str, right: str, seed: int = 17, max_rounds: int = 200, distinct: bool = False) -> DataFrame:
    """(vertex, rep) for every vertex that has an edge to another one; equal rep means connected.

    Null ends and self-links are left out; repeated and reversed edges count once; an empty table gives no rows.
    `distinct` says that the edges are so already.
    """
    a, b = F.col(left).alias("a"), F.col(right).alias("b")
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    live = cut(live if distinct else live.distinct())
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if not live.take(1):
            break
        h = lambda c, r=r: F.xxhash64(F.lit(seed * 1_000_003 + r), c)
        # both directions from one scan; min over the closed neighbourhood, combined before the shuffle
        ends = live.select(
            F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
        ).select("e.v", "e.w")
        hook = (
            ends.groupBy("v")
            .agg(F.min(F.struct(h(F.col("w")).alias("h"), F.col("w").alias("w"))).alias("m"))
            .select("v", F.least(F.col("m"), F.struct(h(F.col("v")).alias("h"), F.col("v").alias("w")))["w"].alias("rep"))
        )
        hook = cut(hook)
        maps.append(hook)
        ha, hb = hook.select(F.col("v").alias("a"), F.col("rep").alias("ra")), hook.select(F.col("v").alias("b"), F.col("rep").alias("rb"))
        nxt = (
            live.join(ha, "a").join(hb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        nxt = cut(nxt)
        drop_cut(live)
        live = nxt
    else:
        raise RuntimeError(f"not contracted after {max_rounds} rounds")
    if not maps:
        return live.select(F.col("a").alias("vertex"), F.col("b").alias("rep"))
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        later = whole.select(F.col("v").alias("rep"), F.col("rep").alias("last"))
        whole = m.join(later, "rep", "left").select("v", F.coalesce("last", "rep").alias("rep"))
    return whole.select(F.col("v").alias("vertex"), "rep")


def group_ids(vertices: DataFrame, key: str, edges: DataFrame, left: str, right: str, out: str = "group_id") -> DataFrame:
    """(key, out): the numerically smallest key of the group for every distinct key of `vertices`.

    Links to keys that `vertices` lacks link nothing. A key that isn't a number comes after all numbers. Null keys
    give no row. An empty table gives no rows.
    """
    ids = vertices.select(F.col(key).alias("vertex")).where("vertex is not null").distinct()
    # most links are stated at both ends: once is enough, and before the lookups
    e = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b").distinct()
    known = ids.withColumnRenamed("vertex", "b")
    e = e.join(known, "b", "left_semi")
    e = e.join(known.withColumnRenamed("b", "a"), "a", "left_semi")
    with scratch(vertices.sparkSession) as kept_cuts:
        reps = cut(contract(e, "a", "b", distinct=True))
        kept_cuts.append(reps)
    least = reps.groupBy("rep").agg(F.min(id_order(F.col("vertex")))["id"].alias("m"))
    # a representative is a vertex of its group as well
    named = reps.join(least, "rep").select("vertex", F.least(id_order(F.col("m")), id_order(F.col("rep")))["id"].alias("g"))
    return ids.join(named, "vertex", "left").select(F.col("vertex").alias(key), F.coalesce("g", "vertex").alias(out))


def message_links(tweets: DataFrame) -> DataFrame:
    """(a, b) of every link that in_response_to_tweet_id and response_tweet_id state, in either direction."""
    rows = tweets.select("tweet_id", "author_id", "response_tweet_id", "in_response_to_tweet_id")
    up = rows.select(F.col("tweet_id").alias("a"), clean_id(F.col("in_response_to_tweet_id")).alias("b")).where("b is not null")
    down = split_packed(rows, "tweet_id", "response_tweet_id", account(F.col("author_id"))).select(
        F.col("tweet_id").alias("a"), clean_id(F.col("linked_id")).alias("b")
    )
    return up.unionByName(down)


def tweet_groups(tweets: DataFrame) -> DataFrame:
    """p5: (tweet_id, group_id), one row for every tweet_id."""
    return group_ids(tweets.select("tweet_id"), "tweet_id", message_links(tweets), "a", "b")
