"""Reachability and components of an undirected graph given as rows of two ends.

This is the component operator of the message tables: labels are the least id in numeric order; every round a vertex
and the vertex its label names take over the least label around, and labels jump to their labels' labels, so that
long chains need about log(n) rounds. Every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_order
from ..session import cut, drop_cut
from .rank import ranged_running


def both_ways(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b) in both directions, distinct; null ends and self-links are left out."""
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct()


def reachable(seeds: DataFrame, edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id) of all ids that a path leads to from `seeds` (id), through ids the vertex table may lack as well.

    Reachable is what shares a component with a seed, so the rounds grow with the logarithm of the longest path. Null
    seeds are left out; a seed without edges is reached by itself; an empty table gives no rows.
    """
    s = seeds.select(F.col(seeds.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
    e = edges.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).where("l is not null and r is not null")
    ends = e.select(F.explode(F.array("l", "r")).alias("id"))
    c = cut(components(s.unionByName(ends), e, "l", "r", "of"))
    return c.join(c.join(s, "id", "left_semi").select("of").distinct(), "of", "left_semi").select("id")


def components(vertices: DataFrame, edges: DataFrame, left: str, right: str, out: str = "component", max_rounds: int = 200) -> DataFrame:
    """(id, out): the least id of its component for every distinct id of `vertices` (its first column).

    Only edges of which both ends are vertices tie. Least is by number, ids that aren't numbers last. Null ids give
    no row; an empty table gives no rows. Ids are numbered in that order first, so that the rounds handle longs.
    """
    ids = vertices.select(F.col(vertices.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
    k = id_order(F.col("id"))
    numbered = cut(ranged_running(ids.select("id", k["word"].alias("w"), k["digits"].alias("d")), [], ["w", "d", "id"], F.lit(1), "n").select("id", "n"))
    of = lambda name, to: numbered.select(F.col("id").alias(name), F.col("n").alias(to))
    e = edges.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).where("l <> r")
    e = cut(both_ways(e.join(of("l", "x"), "l").join(of("r", "y"), "r"), "x", "y"))
    tied = cut(e.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    before = None
    for r in range(max_rounds + 1):
        # labels only fall, so an equal sum means that nothing changed
        now = tied.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        if r == max_rounds:
            raise RuntimeError(f"labels still fall after {max_rounds} rounds")
        before = now
        up = cut(tied.join(tied.select(F.col("v").alias("label"), F.col("label").alias("top")), "label"))
        near = cut(e.join(up.select(F.col("v").alias("b"), "top"), "b").groupBy(F.col("a").alias("v")).agg(F.min("top").alias("near")))
        # a vertex takes the least of its label's label and its neighbours'; so does the vertex that its label names
        hooked = up.join(near, "v").select(F.col("label").alias("v"), F.col("near").alias("l"))
        offers = up.select("v", F.least("label", "top").alias("l")).unionByName(near.select("v", F.col("near").alias("l"))).unionByName(hooked)
        nxt = cut(offers.groupBy("v").agg(F.min("l").alias("label")))
        for old in (tied, up, near):
            drop_cut(old)
        tied = nxt
    drop_cut(e)
    names = tied.join(of("name", "label"), "label").select(F.col("v").alias("n"), "name")
    return numbered.join(names, "n", "left").select("id", F.coalesce("name", "id").alias(out))
