"""An index of question and answer pairs, its search, and what its results tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import response_key
from ..functions.vectors import nearest
from .sampling import keep_first, sample


def build_index(pairs: DataFrame, key: str, order: list[str], text: str, response: str, embed: Callable[[Column], Column], language: str | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """(key, text, response, v, response_key): one pair a key by `order`, both texts given, of one language if asked.

    `limit` takes a sample by hash; without it all pairs are indexed. Pairs without a vector stay out.
    """
    p = keep_first(pairs, [key], order).where(F.col(text).isNotNull() & F.col(response).isNotNull())
    if language is not None:
        p = p.where(F.col("language") == language)
    if limit is not None:
        p = sample(p, key, limit, seed)
    return p.select(key, text, response, embed(F.col(text)).alias("v"), response_key(F.col(response)).alias("response_key")).where("v is not null")


def search(queries: DataFrame, index: DataFrame, key: str, k: int, query_key: str = "query_id", predicate: str | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k most similar pairs of different responses for every query vector `v`."""
    return nearest(queries, index, k, query_key, key, key="response_key", predicate=predicate)


def diagnostics(queries: DataFrame, found: DataFrame, query_key: str = "query_id", weak: float = 0.55, high: float = 0.65, right: Column | None = None) -> DataFrame:
    """One row: queries, weak ones, means of the best and of the first three scores, and similar ones that are wrong.

    A query without results has a best score of 0. `right`, a column of `queries`, says whether its label was right.
    """
    of = found.groupBy(query_key).agg(F.max("score").alias("top"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean3"))
    j = queries.select(query_key, (right if right is not None else F.lit(True)).alias("right")).join(of, query_key, "left").na.fill(0.0, ["top", "mean3"])
    return j.agg(
        F.count("*").alias("queries"), F.count_if(F.col("top") < weak).alias("weak"), F.count_if((F.col("top") >= high) & ~F.col("right")).alias("similar_but_wrong"),
        F.avg("top").alias("mean_top"), F.avg("mean3").alias("mean_top3"),
    )
