"""Message tables to threads, turns, conversations, pairs and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id, parse_time
from ..functions.text import mask, normalize, text_metadata

DAY = 86_400e6


def staged(raw: DataFrame) -> DataFrame:
    """Messages with an id, an author and a readable `inbound`; of equal ids the first in (time, text) order is kept."""
    ok = raw.where("trim(tweet_id) <> '' and trim(author_id) <> '' and inbound is not null")
    w = Window.partitionBy("tweet_id").orderBy("created_at", "text", "response_tweet_id", "in_response_to_tweet_id", "author_id", "inbound")
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stage_counts(raw: DataFrame) -> DataFrame:
    """One row: raw, malformed, valid and duplicate rows and those with a replacement character."""
    bad = F.coalesce(F.trim("tweet_id") == "", F.lit(True)) | F.coalesce(F.trim("author_id") == "", F.lit(True)) | F.col("inbound").isNull()
    return raw.agg(
        F.count("*").alias("raw_rows"), F.count_if(bad).alias("malformed_rows"), F.count_if(~bad).alias("valid_rows"),
        (F.count_if(~bad) - F.countDistinct(F.when(~bad, F.col("tweet_id")))).alias("duplicate_rows"),
        F.count_if(F.col("text").contains("�")).alias("replacement_rows"),
    )


def with_times(messages: DataFrame) -> DataFrame:
    return messages.withColumn("created_at_parsed", parse_time(F.col("created_at"))).withColumn("parent_tweet_id", clean_id(F.col("in_response_to_tweet_id")))


def role(author: Column, account: str, agent: str = "AGENT", customer: str = "CUSTOMER") -> Column:
    """The role by case-insensitive comparison with the account's handle; a null author is a customer."""
    return F.when(F.lower(F.trim(author)) == account.strip().lower(), agent).otherwise(customer)


def number_turns(rows: DataFrame, thread: str, at: str, key: str, out: str = "turn_number") -> DataFrame:
    """Turns from 1 in order of time, unknown times last, then key as text."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(thread).orderBy(F.col(at).asc_nulls_last(), key)))


def drop_contaminated(rows: DataFrame, thread: str, foreign: Column) -> DataFrame:
    """Without the threads that hold a row of which `foreign` is true."""
    return rows.join(rows.where(foreign).select(thread).distinct(), thread, "left_anti")


def branching(rows: DataFrame, thread: str, parent: str) -> DataFrame:
    """rows with a flag, the same in a whole thread: a message of it was answered more than once."""
    twice = rows.where(F.col(parent).isNotNull()).groupBy(thread, parent).count().where("count > 1").select(thread).distinct()
    return rows.join(twice.withColumn("_b", F.lit(True)), thread, "left").withColumn("branching_thread", F.coalesce("_b", F.lit(False))).drop("_b")


def missing_parent(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """rows with a flag: the parent is named but isn't among the rows."""
    ids = rows.select(F.col(key).alias("_p")).distinct().withColumn("_here", F.lit(True))
    return rows.join(ids, F.col(parent) == F.col("_p"), "left").withColumn("missing_parent", F.col(parent).isNotNull() & F.col("_here").isNull()).drop("_p", "_here")


def gaps(rows: DataFrame, thread: str, at: str, key: str, days: float = 30.0) -> DataFrame:
    """(thread, maximum_interturn_gap_days, temporal_gap_anomaly) over the readable times; 0.0 for a single one.

    Gaps inside ranges of (thread, time), then those between ranges: a thread of most rows is never in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.where(F.col(at).isNotNull()).select(F.col(thread), F.unix_micros(F.col(at)).alias("_t"))
    ranged = known.repartitionByRange(n, F.col(thread), F.col("_t")).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p", thread).orderBy("_t")
    parts = ranged.withColumn("_g", F.col("_t") - F.lag("_t").over(inside)).groupBy(thread, "_p").agg(F.max("_g").alias("_g"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    # at most (number of ranges) rows a thread; ranges hold times in order
    between = F.col("_first") - F.lag("_last").over(Window.partitionBy(thread).orderBy("_first", "_last"))
    g = parts.withColumn("_g", F.greatest("_g", between)).groupBy(thread).agg((F.coalesce(F.max("_g"), F.lit(0)) / F.lit(DAY)).alias("maximum_interturn_gap_days"))
    return g.withColumn("temporal_gap_anomaly", F.col("maximum_interturn_gap_days") > days)


def conversations(rows: DataFrame, thread: str, turn: str, who: str, text: str, at: str, agent: str = "AGENT") -> DataFrame:
    """One row a thread: first customer message, messages and responses in turn order, counts, times, last speaker."""
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(turn).alias("n"), F.col(text).alias("t"))))), lambda x: x["t"])
    is_agent = F.col(who) == agent
    return rows.groupBy(thread).agg(
        F.min_by(F.when(~is_agent, F.col(text)), F.when(~is_agent, F.col(turn))).alias("first_customer_message"),
        ordered(~is_agent).alias("all_customer_messages"), ordered(is_agent).alias("all_agent_responses"),
        F.count("*").cast("int").alias("turn_count"), F.min(at).alias("start_time"), F.max(at).alias("end_time"), F.max_by(who, turn).alias("terminal_speaker"),
    )


def pairs(rows: DataFrame, key: str, parent: str, thread: str, who: str, text: str, at: str, agent: str = "AGENT", customer: str = "CUSTOMER") -> DataFrame:
    """Agent messages with the customer message they answer; parents whose id isn't unique are refused."""
    one = Window.partitionBy("_p")
    p = rows.where(F.col(who) == customer).select(F.col(key).alias("_p"), F.col(text).alias("customer_raw_text")).withColumn("_n", F.count("*").over(one)).where("_n = 1").drop("_n")
    a = rows.where((F.col(who) == agent) & F.col(parent).isNotNull())
    return a.join(p, F.col(parent) == F.col("_p")).select(
        F.col(thread).alias("thread_id"), F.col("_p").alias("customer_tweet_id"), F.col(key).alias("agent_tweet_id"), "customer_raw_text", F.col(text).alias("agent_response"), F.col(at).alias("created_at")
    )


def temporal_split(threads: DataFrame, key: str, at: str, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """(key, split): train, dev and test by the rank of (time, nulls last, key as text), cut at the whole numbers below.

    The rank is a distributed one: times are counted per range first, so that no task sorts all threads.
    """
    from .rank import ranged_running

    ids = threads.select(F.col(key), F.col(at).alias("_at"))
    n = ids.count()
    a = int(n * ratios[0])
    b = a + int(n * ratios[1])
    r = ranged_running(ids, [], [("_at", "asc_nulls_last"), (key, "asc")], F.lit(1), "_r")
    return r.select(key, F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "dev").otherwise("test").alias("split"))


def enriched(rows: DataFrame, text: str) -> DataFrame:
    """rows with the normalized and the masked text and the counts and flags of text_metadata."""
    n = rows.withColumn("normalized_text", normalize(F.col(text)))
    return n.select("*", mask(F.col("normalized_text")).alias("model_text"), *[c.alias(k) for k, c in text_metadata(F.col("normalized_text")).items()])
