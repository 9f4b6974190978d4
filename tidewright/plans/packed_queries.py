"""Queries of problem 7: values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import account, delimiter_scores, split_packed
from ..session import table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows delivered twice count once
    return table(spark, sf_dir, "tweets").select("tweet_id", "author_id", "response_tweet_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tweet_id, pos, linked_id): every id packed in tweets.response_tweet_id."""
    return split_packed(_cells(spark, sf_dir), "tweet_id", "response_tweet_id", account(F.col("author_id")))


def p7_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores by which each source's delimiters were inferred."""
    t = _cells(spark, sf_dir).where(F.col("response_tweet_id").rlike("[0-9]"))
    s = delimiter_scores(t, F.col("response_tweet_id"), account(F.col("author_id")))
    return s.select("source", "delimiter", "cells", F.round("regular", 6).alias("regular"), F.round("consistent", 6).alias("consistent"), "accepted")


QUERIES = {"p7_found": p7_found, "p7_delimiters": p7_delimiters}

#: The same ids by one regular expression over the whole cell: plainer than inference, for comparison only.
ORACLE = {
    "p7_found": r"""
with cells as (
  select distinct tweet_id, author_id, response_tweet_id from tweets where response_tweet_id is not null
), joined as (
  select tweet_id, author_id, response_tweet_id,
    regexp_replace(regexp_replace(regexp_replace(response_tweet_id,
      '"(\d+),(\d{3})"', '"\1\2"', 'g'), '"(\d+),(\d{3})"', '"\1\2"', 'g'), '(\d+)\.0+', '\1', 'g') as c
  from cells
), ids as (
  select tweet_id, regexp_extract_all(c, '\d+') as v from joined
)
select tweet_id, cast(u.pos as integer) as pos, v[u.pos] as linked_id
from ids, unnest(generate_series(1, len(v))) as u(pos)
"""
}
