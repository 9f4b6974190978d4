"""Queries of problems 2, 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mojibake, pii, residue

#: The types p2_found reports; the operator also finds payment cards and IBANs.
REPORTED = ["EMAIL", "PHONE", "IDENTITY_NUMBER", "ADDRESS", "NAME"]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are the same in all rows of an example
    return table(spark, sf_dir, "human_judge_largest_disagreements").select("example_id", "customer_message", "generated_response").distinct()


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pii.find_pii(table(spark, sf_dir, "tweets"), "tweet_id", {"tweets.text": "text"})
    h = pii.find_pii(_judged(spark, sf_dir), "example_id", {"customer_message": "customer_message", "generated_response": "generated_response"})
    return t.unionByName(h)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, pii_type, start_pos) of every piece of personal data."""
    return _spans(spark, sf_dir).where(F.col("pii_type").isin(REPORTED)).select("field_name", "record_id", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tweet_id, redacted) of every tweet."""
    t = table(spark, sf_dir, "tweets").select("tweet_id", "text").distinct()
    return pii.redact_column(t, "text", "redacted").select("tweet_id", "redacted")


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf_dir, "tweets").select("tweet_id", "text"), "tweet_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tweet_id) of every message that was, or holds a piece that was, decoded with a wrong encoding."""
    return _garbled(spark, sf_dir).select("tweet_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tweet_id, restored, states) of those messages, as first written where the characters allow it."""
    return _garbled(spark, sf_dir).select("tweet_id", "restored", F.array_join("states", " ").alias("states")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id) of every example whose response is or contains residue."""
    return residue.find_residue(_judged(spark, sf_dir), "example_id", "generated_response").select("example_id").distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by kind of residue."""
    found = residue.find_residue(_judged(spark, sf_dir), "example_id", "generated_response")
    return found.select("example_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.countDistinct("example_id").alias("examples"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_restored": p3_restored, "p6_found": p6_found, "p6_kinds": p6_kinds}
ORACLE: dict[str, str] = {}
