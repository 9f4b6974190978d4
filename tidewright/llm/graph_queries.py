"""Queries of problems 1 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import components, conversations


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_id, turn_number, tweet_id, speaker_role) of every message of every kept conversation, by stated links.

    Of several links stated for a message the score chooses. Nothing is inferred for one that states none: by the
    query's definition and SQL it begins a conversation. `p1_disentangled` infers."""
    return conversations.rebuild(table(spark, sf_dir, "tweets")).select("thread_id", "turn_number", "tweet_id", "speaker_role")


def p1_disentangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with likely parents for messages that state none: one row a conversation."""
    r = conversations.rebuild(table(spark, sf_dir, "tweets"), infer=True)
    return r.groupBy("thread_id").agg(
        F.count("*").alias("turns"),
        F.sum((F.col("speaker_role") == "SUPPORT").cast("int")).alias("support_turns"),
        F.round(F.avg("score"), 6).alias("mean_link_score"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tweet_id, group_id), one row for every tweet_id."""
    return components.tweet_groups(table(spark, sf_dir, "tweets"))


QUERIES = {"p1_found": p1_found, "p1_disentangled": p1_disentangled, "p5_found": p5_found}

_CLEAN = r"""case when lower(regexp_replace(trim({c}), '\.0+$', '')) in ('', 'nan', 'none', 'null') then null else regexp_replace(trim({c}), '\.0+$', '') end"""

#: Plain recursion from every root, and from every vertex.
ORACLE = {
    "p1_found": rf"""
with recursive m as (
  select tweet_id, regexp_matches(trim(author_id), '^[0-9]+$') as customer,
    regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}\x{{115f}}\x{{1160}}\x{{2800}}\x{{3164}}\x{{ffa0}}]', '', 'g') <> '' as has_text,
    {_CLEAN.format(c='in_response_to_tweet_id')} as parent,
    coalesce(epoch_us(case when regexp_matches(trim(created_at), '^[A-Za-z]{{3}} [A-Za-z]{{3}} ') then try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y')
      when regexp_matches(trim(created_at), '^\d{{4}}-\d\d') then try_cast(trim(created_at) as timestamptz) end), 4611686018427387904) as at_us
  from (select distinct tweet_id, author_id, created_at, text, in_response_to_tweet_id from tweets)
), t as (
  select tweet_id as root, tweet_id, customer, has_text, [struct_pack(a := at_us, l := length(tweet_id), i := tweet_id)] as k, false as answers from m where parent is null
  union all
  select t.root, m.tweet_id, m.customer, m.has_text,
    list_append(list_filter(t.k, lambda x: x > struct_pack(a := m.at_us, l := length(m.tweet_id), i := m.tweet_id)), struct_pack(a := m.at_us, l := length(m.tweet_id), i := m.tweet_id)),
    not m.customer and m.has_text and t.customer and t.has_text
  from m join t on m.parent = t.tweet_id
), kept as (select root from t group by root having bool_or(answers))
select root as thread_id, cast(row_number() over (partition by root order by k) as integer) as turn_number, tweet_id, case when customer then 'CUSTOMER' else 'SUPPORT' end as speaker_role
from t where root in (select root from kept)
""",
    "p5_found": rf"""
with recursive c as (
  select distinct tweet_id, {_CLEAN.format(c='in_response_to_tweet_id')} as parent,
    regexp_replace(regexp_replace(regexp_replace(coalesce(response_tweet_id, ''), '"(\d+),(\d{{3}})"', '"\1\2"', 'g'), '"(\d+),(\d{{3}})"', '"\1\2"', 'g'), '(\d+)\.0+', '\1', 'g') as r
  from tweets
), v as (select distinct tweet_id as id from c),
l as (select tweet_id as a, parent as b from c where parent is not null union select tweet_id, unnest(regexp_extract_all(r, '\d+')) from c),
e as (select a, b from l where b in (select id from v) union select b, a from l where b in (select id from v)),
t as (select id as src, id from v union select t.src, e.b from t join e on e.a = t.id)
select src as tweet_id, cast(min(cast(id as bigint)) as varchar) as group_id from t group by src
""",
}
