"""Queries of threads, joins, windows, sets and samples over the message tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id, has_text, parse_time
from ..functions.text import id_list, response_key
from ..operators import graph, integrity, sampling, threads
from ..session import table

ACCOUNT = "VendoraHelp"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed messages, one row an id, with roles by the account and threads named by the least reachable id."""
    t = table(spark, sf_dir, "tweets").distinct()
    return t.select(
        "tweet_id", F.lower(F.trim("author_id")).alias("author"), parse_time(F.col("created_at")).alias("at"), clean_id(F.col("in_response_to_tweet_id")).alias("parent"), "text", "inbound",
        F.when(F.trim("author_id").rlike("^[0-9]+$"), "CUSTOMER").when(F.lower(F.trim("author_id")) == ACCOUNT.lower(), "AGENT").otherwise("OTHER").alias("role"),
    )


#: The same in SQL, shared by several statements.
SQL_MESSAGES = r"""
m as (
  select tweet_id, lower(trim(author_id)) as author, text, inbound,
    case when regexp_matches(trim(created_at), '^[A-Za-z]{3} [A-Za-z]{3} ') then try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y')
         when regexp_matches(trim(created_at), '^\d{4}-\d\d') then try_cast(trim(created_at) as timestamptz) end as ts,
    case when regexp_replace(trim(in_response_to_tweet_id), '\.0+$', '') in ('', 'nan', 'None', 'null') then null
         else regexp_replace(trim(in_response_to_tweet_id), '\.0+$', '') end as parent,
    case when regexp_matches(trim(author_id), '^[0-9]+$') then 'CUSTOMER' when lower(trim(author_id)) = 'vendorahelp' then 'AGENT' else 'OTHER' end as role
  from (select distinct * from tweets)
)"""


def q_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, malformed, valid, duplicate and damaged rows of the message table."""
    return threads.stage_counts(table(spark, sf_dir, "tweets"))


def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent messages with the customer message that they answer."""
    m = messages(spark, sf_dir).withColumn("thread", F.lit(None).cast("string"))
    return threads.pairs(m, "tweet_id", "parent", "thread", "role", "text", "at").select("customer_tweet_id", "agent_tweet_id", "customer_raw_text", "agent_response")


def q_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training threads without those that another split or an undetermined language touches."""
    t = table(spark, sf_dir, "train_conversations").select("thread_id", "language", "turn_count").distinct()
    return threads.drop_contaminated(t, "thread_id", F.coalesce(F.col("language") == "und", F.lit(True)))


def q_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the direct answers to each message, by time, unknown times last, then id."""
    m = messages(spark, sf_dir).where("parent is not null")
    return threads.number_turns(m, "parent", "at", "tweet_id").select("parent", "tweet_id", "turn_number")


def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest pause between the messages of each author, and whether it exceeds 30 days."""
    g = threads.gaps(messages(spark, sf_dir), "author", "at", "tweet_id")
    return g.select("author", F.round("maximum_interturn_gap_days", 6).alias("gap_days"), "temporal_gap_anomaly")


def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every message with answers: first answer, answers in order, count, times, last speaker."""
    m = threads.number_turns(messages(spark, sf_dir).where("parent is not null"), "parent", "at", "tweet_id")
    c = threads.conversations(m, "parent", "turn_number", "role", "tweet_id", "at")
    return c.select("parent", F.array_join("all_customer_messages", "|").alias("customers"), F.array_join("all_agent_responses", "|").alias("agents"), "turn_count", F.unix_seconds("start_time").alias("start_s"), F.unix_seconds("end_time").alias("end_s"), "terminal_speaker")


def q_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors who wrote a message that was answered more than once."""
    m = messages(spark, sf_dir)
    return threads.branching(m, "author", "parent").groupBy("author").agg(F.max("branching_thread").alias("branching"), F.count("*").alias("n"))


def q_missing_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by role that answer one the table lacks."""
    m = threads.missing_parent(messages(spark, sf_dir), "tweet_id", "parent")
    return m.groupBy("role").agg(F.count_if("missing_parent").alias("missing"), F.count("*").alias("n"))


def q_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, distinct edges and dangling targets."""
    e = messages(spark, sf_dir).where("parent is not null and parent <> tweet_id").select(F.col("tweet_id").alias("a"), F.col("parent").alias("b"))
    ids = messages(spark, sf_dir).select(F.col("tweet_id").alias("b"))
    gone = e.join(ids, "b", "left_anti")
    return e.agg(F.count("*").alias("edges"), F.countDistinct("a", "b").alias("distinct_edges")).crossJoin(gone.agg(F.count("*").alias("dangling"), F.countDistinct("b").alias("distinct_dangling")))


def q_double_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are customers' messages."""
    m = messages(spark, sf_dir)
    c = m.where("role = 'CUSTOMER'").select("tweet_id")
    e = m.where("parent is not null").select("tweet_id", "parent")
    return e.join(c, "tweet_id", "left_semi").join(c.withColumnRenamed("tweet_id", "parent"), "parent", "left_semi").select("tweet_id", "parent")


def _reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("parent is not null").select("tweet_id", "parent")


def q_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids that reply links tie to a message of the account, ids the table lacks included."""
    seeds = messages(spark, sf_dir).where("role = 'AGENT'").select("tweet_id")
    return graph.reachable(seeds, _reply_edges(spark, sf_dir), "tweet_id", "parent")


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every message over reply links with both ends in the table."""
    return graph.components(messages(spark, sf_dir).select("tweet_id"), _reply_edges(spark, sf_dir), "tweet_id", "parent")


def q_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training threads cut 70 / 15 / 15 by time."""
    t = table(spark, sf_dir, "train_conversations").groupBy("thread_id").agg(F.max("split_time").alias("split_time"))
    return threads.temporal_split(t, "thread_id", "split_time")


def q_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the thread sets of training and retrieval, their intersection and differences."""
    a = table(spark, sf_dir, "retrieval_corpus").select("thread_id")
    return integrity.set_sizes(a, table(spark, sf_dir, "train_conversations").select("thread_id"))


def q_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thread of five sets by the hash of its id, with a flag for each set."""
    sets = {n: table(spark, sf_dir, t).select("thread_id") for n, t in (("train", "train_conversations"), ("retrieval", "retrieval_corpus"), ("golden", "golden_set"), ("dev", "dev_silver"))}
    return integrity.membership(sets, "support-thread")


def q_membership_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets and of their overlaps with the golden set."""
    return integrity.overlap_counts(q_membership(spark, sf_dir), "golden")


def q_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the plain comma lists of response ids."""
    t = table(spark, sf_dir, "tweets").distinct()
    return t.select("tweet_id", F.posexplode(id_list(F.col("response_tweet_id"))).alias("pos", "item"))


def q_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval pair a normalized response: the earliest, then the least id."""
    r = table(spark, sf_dir, "retrieval_corpus").withColumn("k", response_key(F.col("amazon_response")))
    return sampling.keep_first(r, ["k"], ["created_at", "customer_tweet_id", "amazon_tweet_id", "thread_id"]).select("k", "thread_id", "customer_tweet_id", "amazon_tweet_id")


def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 documents by hash."""
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 200, 42)


def q_stratum_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of every source by hash."""
    return sampling.sample_per_stratum(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 5, 42)


def q_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 documents by quotas of languages, filled up from the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    return sampling.quota_sample(d, "doc_id", "lang", {"en": 100, "de": 40, "th": 50}, 200, 42)


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 documents taken in turn from the sources."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 48, 314159)


def q_first_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 judged rows: the largest difference of each dimension first, then the next largest."""
    h = table(spark, sf_dir, "human_judge_largest_disagreements").where("absolute_difference is not null").groupBy("example_id", "dimension").agg(F.max("absolute_difference").alias("d"))
    h = h.select(F.concat_ws("|", "example_id", "dimension").alias("k"), "dimension", (-F.col("d")).alias("p"))
    return sampling.first_per_label_then_fill(h, "k", "dimension", "p", 24)


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into training and validation, a tenth of each source."""
    return sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 0.1, 7).select("doc_id", "part")


def q_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three names in an order drawn for each example."""
    g = table(spark, sf_dir, "golden_set").select("example_id").distinct()
    return sampling.permuted(g, "example_id", ["alpha", "beta", "gamma"]).select("example_id", F.array_join("permuted", ",").alias("names"))


def q_top_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest differences of two raters, by size, dimension and example."""
    h = table(spark, sf_dir, "human_judge_largest_disagreements").where("absolute_difference is not null").select("example_id", "dimension", "absolute_difference", "signed_difference_judge_minus_human").distinct()
    return h.orderBy(F.desc("absolute_difference"), "dimension", "example_id", "signed_difference_judge_minus_human").limit(15)


def q_next_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first example without a finished label."""
    return sampling.next_unlabelled(table(spark, sf_dir, "golden_set").select("example_id", "human_label_complete"), "example_id", "human_label_complete")


def q_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden messages whose normalized text is in the retrieval corpus."""
    g = table(spark, sf_dir, "golden_set").select("example_id", response_key(F.col("customer_message")).alias("k"))
    r = table(spark, sf_dir, "retrieval_corpus").select(response_key(F.col("customer_raw_text")).alias("k"))
    return g.where("k <> ''").join(r, "k", "left_semi").select("example_id", "k")


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden labels after an update of all unfinished ones."""
    g = table(spark, sf_dir, "golden_set").select("example_id", "human_intent", "labeled_at", "updated_at")
    u = table(spark, sf_dir, "golden_set").where("not human_label_complete").select("example_id", F.lit("checked").alias("human_intent"))
    return integrity.upsert(g, u, "example_id", F.lit("2025-06-01 00:00:00").cast("timestamp")).select("example_id", "human_intent", F.unix_seconds("labeled_at").alias("labeled_s"), F.unix_seconds("updated_at").alias("updated_s"))


def q_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many golden labels that update changes."""
    g = table(spark, sf_dir, "golden_set").select("example_id", "human_intent")
    u = table(spark, sf_dir, "golden_set").select("example_id", F.when(F.col("human_label_complete"), F.col("human_intent")).otherwise("checked").alias("human_intent"))
    return integrity.changed(g, u, "example_id", ["human_intent"])


def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents per source after new silver rows replace golden ones of the same thread."""
    g = table(spark, sf_dir, "golden_set").groupBy("thread_id").agg(F.max("human_intent").alias("intent"))
    d = table(spark, sf_dir, "dev_silver").groupBy("thread_id").agg(F.max("reference_intent").alias("intent"))
    return integrity.latest(g, d, "thread_id").groupBy("intent").agg(F.count("*").alias("n"))


def q_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden texts looked up by thread in the training texts: hits, mismatches and misses."""
    g = table(spark, sf_dir, "golden_set").select("thread_id", F.sha2(F.coalesce("customer_message", F.lit("")), 256).alias("h"))
    t = table(spark, sf_dir, "train_conversations").groupBy("thread_id").agg(F.min(F.sha2(F.coalesce("first_customer_message", F.lit("")), 256)).alias("h"))
    return integrity.cache_lookup(g, t, "thread_id", "h").groupBy("state").agg(F.count("*").alias("n"))


def q_golden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each rule of the golden set."""
    g = table(spark, sf_dir, "golden_set").withColumn("_n", F.count("*").over(Window.partitionBy("example_id")))
    complete = F.coalesce(F.col("human_label_complete"), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return integrity.rule_failures(g, {
        "example id given": ~blank("example_id"), "example id unique": F.col("_n") == 1, "thread given": ~blank("thread_id"), "message has text": has_text(F.col("customer_message")),
        "complete has intent": ~complete | ~blank("human_intent"), "complete has route": ~complete | ~blank("human_escalation"), "complete has labeler": ~complete | ~blank("labeler_id"),
        "complete has time": ~complete | F.col("labeled_at").isNotNull(), "times in order": F.col("labeled_at").isNull() | F.col("updated_at").isNull() | (F.col("updated_at") >= F.col("labeled_at")),
    })


def q_rating_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each rule of the ratings."""
    h = table(spark, sf_dir, "human_judge_largest_disagreements")
    s, j = F.col("human_score"), F.col("judge_score")
    return integrity.rule_failures(h, {
        "human score 1 to 5": s.isNull() | s.between(1, 5), "judge score 1 to 5": j.isNull() | j.between(1, 5), "both or none": s.isNull() == j.isNull(),
        "difference signed": s.isNull() | j.isNull() | F.col("signed_difference_judge_minus_human").eqNullSafe(j - s), "difference absolute": s.isNull() | j.isNull() | F.col("absolute_difference").eqNullSafe(F.abs(j - s)),
        "rationale given": F.length(F.trim(F.coalesce("judge_rationale", F.lit("")))) > 0,
    })


def q_taxonomy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden intents that the silver set doesn't know."""
    return integrity.unknown_values(table(spark, sf_dir, "golden_set"), "human_intent", table(spark, sf_dir, "dev_silver").select("reference_intent"))


def q_tpch_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' longest pause between orders in days."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    g = threads.gaps(o, "o_custkey", "o_orderdate", "o_orderkey")
    return g.select("o_custkey", F.round("maximum_interturn_gap_days", 6).alias("gap_days"), "temporal_gap_anomaly")


def q_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each nation and year: a star join with a partial aggregate before the large shuffle."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(20,4)")).alias("r"))
    j = per_order.join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "year").agg(F.sum("r").cast("double").alias("revenue"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}


def _h(seed: int, col: str) -> str:
    return f"sha256('{seed}:' || cast({col} as varchar))"


_KEY = r"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}\x1c-\x1f\x{{85}}]+', ' ', 'g'), '^ | $', '', 'g'))"

ORACLE = {
    "q_stage_counts": """
select count(*) as raw_rows, count(*) filter (where bad) as malformed_rows, count(*) filter (where not bad) as valid_rows,
  count(*) filter (where not bad) - count(distinct tweet_id) filter (where not bad) as duplicate_rows,
  count(*) filter (where contains(text, chr(65533))) as replacement_rows
from (select *, coalesce(trim(tweet_id) = '', true) or coalesce(trim(author_id) = '', true) or inbound is null as bad from tweets)""",
    "q_pairs": f"""with {SQL_MESSAGES},
p as (select tweet_id, text from m where role = 'CUSTOMER' qualify count(*) over (partition by tweet_id) = 1)
select p.tweet_id as customer_tweet_id, m.tweet_id as agent_tweet_id, p.text as customer_raw_text, m.text as agent_response
from m join p on m.parent = p.tweet_id where m.role = 'AGENT'""",
    "q_contaminated": """with t as (select distinct thread_id, language, turn_count from train_conversations)
select * from t where not exists (select 1 from t x where x.thread_id = t.thread_id and coalesce(x.language = 'und', true))""",
    "q_turns": f"""with {SQL_MESSAGES}
select parent, tweet_id, cast(row_number() over (partition by parent order by ts asc nulls last, tweet_id) as integer) as turn_number from m where parent is not null""",
    "q_gaps": f"""with {SQL_MESSAGES},
g as (select author, (epoch_us(ts) - epoch_us(lag(ts) over (partition by author order by ts, tweet_id))) / 86400000000.0 as g from m where ts is not null)
select author, round(coalesce(max(g), 0.0), 6) as gap_days, coalesce(max(g), 0.0) > 30 as temporal_gap_anomaly from g group by author""",
    "q_rollup": f"""with {SQL_MESSAGES},
t as (select *, row_number() over (partition by parent order by ts asc nulls last, tweet_id) as n from m where parent is not null)
select parent, coalesce(string_agg(tweet_id, '|' order by n) filter (where role <> 'AGENT'), '') as customers, coalesce(string_agg(tweet_id, '|' order by n) filter (where role = 'AGENT'), '') as agents,
  cast(count(*) as integer) as turn_count, cast(floor(epoch(min(ts))) as bigint) as start_s, cast(floor(epoch(max(ts))) as bigint) as end_s, arg_max(role, n) as terminal_speaker from t group by parent""",
    "q_branching": f"""with {SQL_MESSAGES},
b as (select distinct author from (select author, parent from m where parent is not null group by author, parent having count(*) > 1))
select author, bool_or(author in (select author from b)) as branching, count(*) as n from m group by author""",
    "q_missing_parent": f"""with {SQL_MESSAGES}
select role, count(*) filter (where parent is not null and parent not in (select tweet_id from m)) as missing, count(*) as n from m group by role""",
    "q_edges": f"""with {SQL_MESSAGES},
e as (select tweet_id as a, parent as b from m where parent is not null and parent <> tweet_id)
select count(*) as edges, count(distinct (a, b)) as distinct_edges, count(*) filter (where gone) as dangling, count(distinct b) filter (where gone) as distinct_dangling
from (select a, b, b not in (select tweet_id from m) as gone from e)""",
    "q_double_semi": f"""with {SQL_MESSAGES}, c as (select tweet_id from m where role = 'CUSTOMER')
select tweet_id, parent from m where parent is not null and tweet_id in (select tweet_id from c) and parent in (select tweet_id from c)""",
    "q_reach": f"""with recursive {SQL_MESSAGES},
e as (select tweet_id as a, parent as b from m where parent is not null union select parent, tweet_id from m where parent is not null),
r as (select tweet_id as id from m where role = 'AGENT' union select e.b from r join e on e.a = r.id)
select id from r""",
    "q_components": f"""with recursive {SQL_MESSAGES},
v as (select distinct tweet_id as id from m),
e as (select tweet_id as a, parent as b from m where parent in (select id from v) union select parent, tweet_id from m where parent in (select id from v)),
r as (select id as src, id from v union select r.src, e.b from r join e on e.a = r.id)
select src as id, cast(min(cast(id as bigint)) as varchar) as component from r group by src""",
    "q_temporal_split": """with t as (select thread_id, max(split_time) as st from train_conversations group by thread_id),
r as (select thread_id, row_number() over (order by st asc nulls last, thread_id) as r, count(*) over () as n from t)
select thread_id, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.7) + floor(n * 0.15) then 'dev' else 'test' end as split from r""",
    "q_split_overlap": """with a as (select distinct thread_id from retrieval_corpus), b as (select distinct thread_id from train_conversations)
select (select count(*) from a) as n_left, (select count(*) from b) as n_right, (select count(*) from a where thread_id in (select * from b)) as n_both,
  (select count(*) from a where thread_id not in (select * from b)) as only_left, (select count(*) from b where thread_id not in (select * from a)) as only_right,
  (select count(*) from a where thread_id not in (select * from b)) = 0 as subset""",
    "q_membership": """with u as (select thread_id as id, 'train' as s from train_conversations union all select thread_id, 'retrieval' from retrieval_corpus union all select thread_id, 'golden' from golden_set union all select thread_id, 'dev' from dev_silver)
select sha256('support-thread:' || id) as id, bool_or(s = 'train') as in_train, bool_or(s = 'retrieval') as in_retrieval, bool_or(s = 'golden') as in_golden, bool_or(s = 'dev') as in_dev from u where id is not null group by u.id""",
    "q_membership_counts": """with u as (select thread_id as id, 'train' as s from train_conversations union all select thread_id, 'retrieval' from retrieval_corpus union all select thread_id, 'golden' from golden_set union all select thread_id, 'dev' from dev_silver),
f as (select bool_or(s = 'train') as t, bool_or(s = 'retrieval') as r, bool_or(s = 'golden') as g, bool_or(s = 'dev') as d from u where id is not null group by id)
select count(*) filter (where t) as n_train, count(*) filter (where r) as n_retrieval, count(*) filter (where g) as n_golden, count(*) filter (where d) as n_dev,
  count(*) filter (where g and t) as golden_and_train, count(*) filter (where g and r) as golden_and_retrieval, count(*) filter (where g and d) as golden_and_dev from f""",
    "q_id_lists": """with t as (select tweet_id, list_filter(list_transform(string_split(coalesce(response_tweet_id, ''), ','), lambda x: trim(x)), lambda x: x <> '' and lower(x) <> 'nan') as v from (select distinct * from tweets))
select tweet_id, cast(i - 1 as integer) as pos, v[i] as item from t, unnest(generate_series(1, len(v))) as u(i)""",
    "q_keep_first": f"""with r as (select *, {_KEY.format(c='amazon_response')} as k from retrieval_corpus)
select k, thread_id, customer_tweet_id, amazon_tweet_id from r
qualify row_number() over (partition by k order by created_at asc nulls last, customer_tweet_id asc nulls last, amazon_tweet_id asc nulls last, thread_id asc nulls last) = 1""",
    "q_hash_sample": f"select doc_id, source from documents order by {_h(42, 'doc_id')}, doc_id limit 200",
    "q_stratum_sample": f"select doc_id, source from documents qualify row_number() over (partition by source order by {_h(42, 'doc_id')}, doc_id) <= 5",
    "q_quota_sample": f"""with d as (select doc_id, coalesce(lang, 'none') as lang from documents),
r as (select *, row_number() over (partition by lang order by {_h(42, 'doc_id')}, doc_id) as r from d),
c as (select *, r <= case lang when 'en' then 100 when 'de' then 40 when 'th' then 50 else 0 end as chosen from r),
rest as (select doc_id, lang from c where not chosen order by {_h(141, 'doc_id')}, doc_id limit (select greatest(0, 200 - count(*)) from c where chosen))
select doc_id, lang from c where chosen union all select doc_id, lang from rest""",
    "q_round_robin": f"""with r as (select doc_id, source, row_number() over (partition by source order by {_h(314159, 'doc_id')}, doc_id) as r from documents)
select doc_id, source from r order by r, source limit 48""",
    "q_first_then_fill": """with h as (select example_id || '|' || dimension as k, dimension, -max(absolute_difference) as p from human_judge_largest_disagreements where absolute_difference is not null group by example_id, dimension),
r as (select *, row_number() over (partition by dimension order by p, k) > 1 as f from h)
select k, dimension, p from r order by f, p, k limit 24""",
    "q_stratified_split": f"""select doc_id, case when row_number() over (partition by source order by {_h(7, 'doc_id')}, doc_id) <= round_even(count(*) over (partition by source) * 0.1, 0) then 'validation' else 'train' end as part from documents""",
    "q_permuted": """with g as (select distinct example_id from golden_set), x as (select example_id, v, sha256(example_id || v) as h from g, (values ('alpha'), ('beta'), ('gamma')) as t(v))
select example_id, string_agg(v, ',' order by h) as names from x group by example_id""",
    "q_top_disagreements": """select distinct example_id, dimension, absolute_difference, signed_difference_judge_minus_human from human_judge_largest_disagreements where absolute_difference is not null
order by absolute_difference desc, dimension, example_id, signed_difference_judge_minus_human limit 15""",
    "q_next_unlabelled": "select example_id, human_label_complete from golden_set where not coalesce(human_label_complete, false) order by example_id limit 1",
    "q_exact_repeats": f"""select example_id, k from (select example_id, {_KEY.format(c='customer_message')} as k from golden_set) where k <> '' and k in (select {_KEY.format(c='customer_raw_text')} from retrieval_corpus)""",
    "q_upsert": """select example_id, case when not human_label_complete then 'checked' else human_intent end as human_intent,
  cast(floor(epoch(case when not human_label_complete then coalesce(labeled_at, timestamptz '2025-06-01 00:00:00+00') else labeled_at end)) as bigint) as labeled_s,
  cast(floor(epoch(case when not human_label_complete then timestamptz '2025-06-01 00:00:00+00' else updated_at end)) as bigint) as updated_s from golden_set""",
    "q_changed": """select count(*) as compared, count(*) filter (where human_intent is distinct from case when human_label_complete then human_intent else 'checked' end) as changed_human_intent from golden_set""",
    "q_latest": """with g as (select thread_id, max(human_intent) as intent from golden_set group by thread_id), d as (select thread_id, max(reference_intent) as intent from dev_silver group by thread_id)
select intent, count(*) as n from (select * from d union all select * from g where thread_id not in (select thread_id from d)) group by intent""",
    "q_cache": """with g as (select thread_id, sha256(coalesce(customer_message, '')) as h from golden_set), t as (select thread_id, min(sha256(coalesce(first_customer_message, ''))) as h from train_conversations group by thread_id)
select case when t.h is null then 'miss' when t.h = g.h then 'hit' else 'mismatch' end as state, count(*) as n from g left join t using (thread_id) group by 1""",
    "q_golden_rules": r"""with g as (select *, count(*) over (partition by example_id) as n, coalesce(human_label_complete, false) as c from golden_set)
select unnest(['example id given','example id unique','thread given','message has text','complete has intent','complete has route','complete has labeler','complete has time','times in order']) as rule,
 unnest([count(*) filter (where trim(coalesce(example_id,''))=''), count(*) filter (where n<>1), count(*) filter (where trim(coalesce(thread_id,''))=''),
  count(*) filter (where regexp_replace(coalesce(customer_message,''), '[\s\p{Z}\p{Cf}\p{Cc}]', '', 'g')=''),
  count(*) filter (where c and trim(coalesce(human_intent,''))=''), count(*) filter (where c and trim(coalesce(human_escalation,''))=''), count(*) filter (where c and trim(coalesce(labeler_id,''))=''),
  count(*) filter (where c and labeled_at is null), count(*) filter (where labeled_at is not null and updated_at is not null and updated_at<labeled_at)]) as failures from g""",
    "q_rating_rules": """with h as (select *, human_score as s, judge_score as j, human_score is null or judge_score is null as x from human_judge_largest_disagreements)
select unnest(['human score 1 to 5','judge score 1 to 5','both or none','difference signed','difference absolute','rationale given']) as rule,
 unnest([count(*) filter (where s not between 1 and 5), count(*) filter (where j not between 1 and 5), count(*) filter (where (s is null) <> (j is null)),
  count(*) filter (where not x and signed_difference_judge_minus_human is distinct from j-s), count(*) filter (where not x and absolute_difference is distinct from abs(j-s)),
  count(*) filter (where trim(coalesce(judge_rationale,''))='')]) as failures from h""",
    "q_taxonomy_gaps": "select distinct human_intent as value from golden_set where human_intent is not null and human_intent not in (select reference_intent from dev_silver where reference_intent is not null)",
    "q_tpch_gap": """with g as (select o_custkey, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey))) / 86400000000.0 as g from orders where o_orderdate is not null)
select o_custkey, round(coalesce(max(g), 0.0), 6) as gap_days, coalesce(max(g), 0.0) > 30 as temporal_gap_anomaly from g group by o_custkey""",
    "q_revenue": """select n_name, year(o_orderdate) as year, cast(sum(cast(round(l_extendedprice * (1 - l_discount), 4) as decimal(20,4))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""",
}
