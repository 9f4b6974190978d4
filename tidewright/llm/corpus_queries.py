"""Queries of problems 4, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, overlap, sentences, tokenizer


def _eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_set").select(F.lit("golden").alias("split"), F.col("example_id").alias("id"), F.col("customer_message").alias("text"))
    d = table(spark, sf_dir, "dev_silver").select(F.lit("dev").alias("split"), F.col("thread_id").alias("id"), F.col("customer_text").alias("text"))
    return g.unionByName(d)


def _train_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_conversations").select(F.lit("train").alias("split"), F.col("thread_id").alias("id"), F.col("first_customer_message").alias("text"))
    r = table(spark, sf_dir, "retrieval_corpus").select(F.lit("retrieval_index").alias("split"), F.col("thread_id").alias("id"), F.col("customer_raw_text").alias("text"))
    return t.unionByName(r)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eval_split, eval_id, train_split, thread_id) of every overlap."""
    return overlap.overlap_rows(_eval_records(spark, sf_dir), _train_records(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping golden examples per audit round and training split beside the counts leakage_validation states."""
    found = p4_found(spark, sf_dir).where("eval_split = 'golden'")
    n = (
        found.withColumn("audit_round", F.regexp_extract("eval_id", r"^gold-(\d+)-", 1).try_cast("bigint"))
        .groupBy("audit_round", "train_split").agg(F.countDistinct("eval_id").alias("found"))
    )
    said = table(spark, sf_dir, "leakage_validation").select("audit_round", F.explode(F.create_map(F.lit("train"), F.col("golden_overlap_counts.train"), F.lit("retrieval_index"), F.col("golden_overlap_counts.retrieval_index"))).alias("train_split", "stated"))
    return said.join(n, ["audit_round", "train_split"], "full").select("audit_round", "train_split", "stated", F.coalesce("found", F.lit(0)).alias("found"))


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and training source: pairs, evaluation records and training threads."""
    return p4_found(spark, sf_dir).groupBy("eval_split", "train_split").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("thread_id").alias("threads")
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return tokenizer.encode_documents(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # one row a document; a repeated doc_id would double its use
    sizes = tokenizer.encode_documents(docs.select("doc_id", "text"), lengths_only=True).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    sources = docs.select("doc_id", "source").groupBy("doc_id").agg(F.min("source").alias("source"))
    return sizes.join(sources, "doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, doc_id, source, repeat, tokens, at) of every use of a document in training order."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, tokens and repeats of every source."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence."""
    return sentences.split_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "p4_found": p4_found, "p4_counts": p4_counts, "p4_sources": p4_sources, "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
}

#: Brute force over every pair of records that share a word; no pruning.
_OVERLAPS = r"""
with recs as (
  select 'e' as side, 'golden' as split, example_id as id, customer_message as text from golden_set
  union select 'e', 'dev', thread_id, customer_text from dev_silver
  union select 't', 'train', thread_id, first_customer_message from train_conversations
  union select 't', 'retrieval_index', thread_id, customer_raw_text from retrieval_corpus
), cleaned as (
  select side, split, id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)\b(?:https?://|www\.)\S+', ' ', 'g'),
    '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});', ' ', 'g'),
    '[@＠#＃][\p{L}\p{M}\p{N}_]+', ' ', 'g'),
    '[\p{Cf}''’‘ʼ]', '', 'g')) as t from recs where text is not null
), w as (
  select side, split, id, row_number() over () as rec, list_filter(regexp_split_to_array(t, '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as ws from cleaned
), tall as (
  select rec, word, row_number() over (partition by rec, word) as k from (select rec, unnest(ws) as word from w)
), common as (
  select a.rec as e, b.rec as t, count(*) as c
  from tall a join w wa on wa.rec = a.rec and wa.side = 'e'
  join tall b on a.word = b.word and a.k = b.k
  join w wb on wb.rec = b.rec and wb.side = 't'
  group by a.rec, b.rec
)
, found as (
select distinct we.split as eval_split, we.id as eval_id, wt.split as train_split, wt.id as thread_id
from common join w we on we.rec = e join w wt on wt.rec = t
where c * 10 >= (len(we.ws) + len(wt.ws) - c) * 7
)
"""

ORACLE = {
    "p4_found": _OVERLAPS + "select * from found",
    "p4_counts": _OVERLAPS
    + r""", n as (
  select try_cast(regexp_extract(eval_id, '^gold-(\d+)-', 1) as bigint) as audit_round, train_split, count(distinct eval_id) as found
  from found where eval_split = 'golden' group by 1, 2
), said as (
  select audit_round, 'train' as train_split, golden_overlap_counts.train as stated from leakage_validation
  union all select audit_round, 'retrieval_index', golden_overlap_counts.retrieval_index from leakage_validation
)
select coalesce(said.audit_round, n.audit_round) as audit_round, coalesce(said.train_split, n.train_split) as train_split, stated, coalesce(found, 0) as found
from said full join n on said.audit_round = n.audit_round and said.train_split = n.train_split
""",
    "p4_sources": _OVERLAPS + "select eval_split, train_split, count(*) as pairs, count(distinct eval_id) as eval_records, count(distinct thread_id) as threads from found group by 1, 2",
}
