"""Queries of weak labels, predictions, retrieval, diagnostics and enriched messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import labelling, metrics, retrieval, threads
from ..session import table
from .analytics import _J, _L, _WS, RULES, _judged, _labelled, _labels, prototypes
from .relational import messages

#: Words of the labels' descriptions; the share that a text has stands for the similarity of embeddings.
PROTOTYPES = {
    "late": "late delay waiting arrived days still weeks", "refund": "refund charged money back card paid", "damage": "broken crack dented soaked torn open half",
    "account": "login password account email access app", "courier": "courier driver carrier van firm depot", "delivery": "deliver parcel delivered address neighbour label",
}
#: Kinds of disagreement by words of the rationale, the first that fits.
KINDS = [("tone", ["tone", "polite", "friendly", "empath"]), ("safety", ["safe", "privacy", "personal"]), ("grounding", ["ground", "fact", "evidence", "support"]), ("resolution", ["resol", "answer", "help", "next step"])]


def _likeness(c: Column) -> Column:
    low = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z]+")
    share = lambda ws: F.size(F.array_intersect(low, F.array(*[F.lit(w) for w in ws]))) / F.lit(float(len(ws)))
    return F.array(*[F.struct(share(ws.split()).alias("score"), F.lit(n).alias("label")) for n, ws in PROTOTYPES.items()])


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One English pair a thread: the least text."""
    r = table(spark, sf_dir, "retrieval_corpus").where("language = 'en' and customer_text is not null")
    return r.groupBy("thread_id").agg(F.min("customer_text").alias("customer_text"))


def _weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = labelling.rule_candidates(_english(spark, sf_dir), "thread_id", "customer_text", RULES, 120, 42)
    return labelling.weak_labels(c, "thread_id", _likeness(F.col("customer_text")))


def q_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels of up to 120 English threads a rule, with confidence, margin, method and status."""
    return _weak(spark, sf_dir).select("thread_id", "predicted", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "method", "status")


def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 weak labels to review first."""
    return labelling.review_queue(_weak(spark, sf_dir), "thread_id", 40).select("thread_id", "predicted", "priority")


def q_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 120 threads a label that exactly one rule names, and short texts that none does."""
    return labelling.silver_set(_english(spark, sf_dir), "thread_id", "customer_text", RULES, "general", 120, 7)


def q_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, confidence, second label and ambiguity of every vector, scores being the products with the labels' means."""
    e = prototypes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    p = e.select("vec_id", labelling.predictions(F.transform("scores", lambda x: F.struct(F.round(x["score"], 6).alias("score"), x["label"].alias("label")))).alias("p"))
    return p.select("vec_id", F.col("p.label").alias("label"), F.round("p.confidence", 6).alias("confidence"), F.col("p.secondary").alias("secondary"), F.round("p.ambiguity", 6).alias("ambiguity"))


def _embed(c: Column) -> Column:
    return vectors.hashed_vector(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: w != ""))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = retrieval.build_index(table(spark, sf_dir, "retrieval_corpus"), "thread_id", ["customer_tweet_id", "amazon_tweet_id"], "customer_text", "amazon_response", _embed, "en")
    g = table(spark, sf_dir, "golden_set").where(F.regexp_extract("example_id", r"(\d+)$", 1).try_cast("int") % 50 == 0)
    q = g.select(F.col("example_id").alias("query_id"), _embed(F.col("customer_message")).alias("v"))
    return q, retrieval.search(q, index, "thread_id", 3)


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar English pairs of different responses for every golden message of number divisible by 50."""
    return _found(spark, sf_dir)[1].select("query_id", "rank", "thread_id", F.round("score", 6).alias("score"))


def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well that search does: queries, weak ones, means of the best and the first three scores."""
    d = retrieval.diagnostics(*_found(spark, sf_dir))
    return d.select("queries", "weak", F.round("mean_top", 6).alias("mean_top"), F.round("mean_top3", 6).alias("mean_top3"))


def q_disagreement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows on which human and judge differ, by kind."""
    h = table(spark, sf_dir, "human_judge_largest_disagreements").select("example_id", "dimension", "judge_rationale", "absolute_difference").distinct().where("absolute_difference > 0")
    return h.groupBy(text.case_by_terms(F.col("judge_rationale"), KINDS, "other").alias("kind")).agg(F.count("*").alias("n"))


def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human scores of each dimension: number, mean, median, sample deviation and the counts of 1 to 5."""
    s = metrics.score_summary(_judged(spark, sf_dir), "human_score", 1, 5, "dimension")
    return s.select("dimension", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


def q_bias_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over all dimensions together and of each, by the size of the judge's bias."""
    j = _judged(spark, sf_dir)
    a = metrics.agreement(j.unionByName(j.withColumn("dimension", F.lit("pooled"))), "human_score", "judge_score", ["dimension"])
    return a.select("dimension", "n", F.round("bias", 6).alias("bias"), F.round("mae", 6).alias("mae"), F.round(F.abs("bias"), 6).alias("size"))


def q_sweep_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, accuracy and macro F1 of what is covered at eight thresholds of confidence."""
    s = metrics.sweep_scores(_labelled(spark, sf_dir), _labels(spark), [0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 2.0], "confidence", "actual", "predicted")
    return s.select("threshold", "covered", *[F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "macro_f1")])


def q_row_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the six scores of each example, those of its rows by dimension; null where one is missing."""
    j = _judged(spark, sf_dir).groupBy("example_id", "dimension").agg(F.max("human_score").alias("s"))
    w = j.groupBy("example_id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.sum("s").alias("c"), F.avg("s").alias("d"), F.count("s").alias("e"), F.count("*").alias("f"))
    return w.select("example_id", F.round(vectors.row_mean(*[F.col(c) for c in "abcdef"]), 6).alias("mean"))


def q_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by role with a masked text, links, mentions, emoji or questions: the enriched threads, counted."""
    e = threads.enriched(messages(spark, sf_dir), "text")
    return e.groupBy("role").agg(
        F.count("*").alias("n"), F.count_if("has_possible_pii").alias("masked"), F.sum("url_count").alias("urls"), F.sum("mention_count").alias("mentions"),
        F.count_if("emoji_present").alias("emoji"), F.count_if("question_present").alias("questions"), F.sum("token_count").alias("tokens"),
    )


def q_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, names, numbers and shares of the training threads as reports print them."""
    t = table(spark, sf_dir, "train_conversations").select("thread_id", "start_time", "resolution_status", "turn_count").distinct()
    return t.select("thread_id", text.iso_time(F.col("start_time")).alias("start"), text.titled(F.lower("resolution_status")).alias("status"), text.zero_padded(F.col("turn_count"), 4).alias("turns"), text.percent(F.col("turn_count") / 64, 2).alias("share"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_RULES = ", ".join(f"case when regexp_matches(coalesce(customer_text, ''), '{p}') then '{n}' end" for n, p in RULES)
_LIKE = ", ".join(f"struct_pack(s := len(list_intersect(list_distinct(low), {ws.split()})) / {float(len(ws.split()))}, l := '{n}')" for n, ws in PROTOTYPES.items())
_PAIRS = f"""e as (select thread_id, min(customer_text) as customer_text from retrieval_corpus where language = 'en' and customer_text is not null group by 1),
l as (select thread_id, customer_text, list_filter([{_RULES}], lambda x: x is not null) as labels from e)"""
_WEAK = f"""with {_PAIRS}, tall as (select *, unnest(labels) as r from l),
c as (select distinct thread_id, customer_text, labels from (select *, row_number() over (partition by r order by sha256('42:' || thread_id), thread_id) as k from tall) where k <= 120),
s as (select thread_id, labels, unnest([{_LIKE}]) as x from (select *, regexp_split_to_array(lower(customer_text), '[^a-z]+') as low from c)),
o as (select thread_id, labels, x.s as s, x.l as l, row_number() over (partition by thread_id order by x.s desc, x.l) as k from s),
t as (select a.thread_id, a.l as near, a.s - b.s as margin, case when len(a.labels) = 1 then a.labels[1] end as rule from o a join o b on a.thread_id = b.thread_id and a.k = 1 and b.k = 2),
w as (select thread_id, coalesce(rule, near) as predicted, margin, case when rule = near then 0.92 when rule is not null then 0.82 else least(0.84, 0.70 + greatest(0.0, margin)) end as confidence,
  case when rule = near then 'rule_plus_embedding' else 'rule_or_embedding' end as method, case when rule is null then 0.0 when rule = near then 1.0 else 0.2 end as priority from t)
"""
_VEC = """list_transform(range(0, 64), lambda i: len(list_filter(ws, lambda w: (16 * (strpos('0123456789abcdef', substr(md5(w), 1, 1)) - 1) + strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1) % 64 = i))::double)"""
_SEARCH = f"""with p as (select *, row_number() over (partition by thread_id order by customer_tweet_id nulls last, amazon_tweet_id nulls last) as k from retrieval_corpus),
c as (select thread_id, customer_text, lower({_WS.format(c='amazon_response')}) as r from p where k = 1 and customer_text is not null and amazon_response is not null and language = 'en'),
a as (select thread_id as id, r, customer_text as t, 'c' as side from c union all select example_id, null, customer_message, 'q' from golden_set where try_cast(regexp_extract(example_id, '(\\d+)$', 1) as integer) % 50 = 0),
u as (select id, r, side, {_VEC} as v from (select *, list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^a-z]+'), lambda w: w <> '') as ws from a) where len(ws) > 0),
s as (select q.id as query_id, c.id as thread_id, c.r, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) as score from u q join u c on q.side = 'q' and c.side = 'c'),
k as (select *, row_number() over (partition by query_id, r order by round(score, 12) desc, thread_id) as n from s),
f as (select query_id, thread_id, score, row_number() over (partition by query_id order by round(score, 12) desc, thread_id) as rank from k where n = 1)
"""
_CASES = " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in ws) + f" then '{n}'" for n, ws in KINDS)

ORACLE = {
    "q_weak_labels": _WEAK + "select thread_id, predicted, round(confidence, 6) as confidence, round(margin, 6) as margin, method, case when confidence >= 0.8 then 'accepted' else 'quarantine' end as status from w",
    "q_review_queue": _WEAK + "select thread_id, predicted, cast(priority as double) as priority from (select *, row_number() over (partition by predicted order by priority, thread_id) > 1 as f from w) order by f, priority, thread_id limit 40",
    "q_silver": f"""with {_PAIRS}, n as (select thread_id, labels, {_WS.format(c='customer_text')} as t from l),
s as (select thread_id, case when len(labels) = 1 then labels[1] when len(labels) = 0 and t <> '' and len(string_split(t, ' ')) <= 6 then 'general' end as label from n)
select thread_id, label from s where label is not null qualify row_number() over (partition by label order by sha256('7:' || thread_id), thread_id) <= 120""",
    "q_ambiguity": """with x as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from x group by 1, 2),
n as (select label, sqrt(sum(x * x)) as n from m group by 1), s as (select x.vec_id, m.label, round(sum(x.x * m.x / n.n), 6) as score from x join m using (i) join n on n.label = m.label group by 1, 2),
p as (select vec_id, label, exp(score) / sum(exp(score)) over (partition by vec_id) as p from s), r as (select *, row_number() over (partition by vec_id order by p desc, label) as r from p)
select a.vec_id, a.label, round(a.p, 6) as confidence, case when a.p - b.p < 0.18 then b.label end as secondary, round(greatest(0.0, 1 - (a.p - b.p)), 6) as ambiguity from r a join r b on a.vec_id = b.vec_id and a.r = 1 and b.r = 2""",
    "q_search": _SEARCH + "select query_id, cast(rank as integer) as rank, thread_id, round(score, 6) as score from f where rank <= 3",
    "q_diagnostics": _SEARCH + """, t as (select query_id, max(score) as top, avg(score) as mean3 from f where rank <= 3 group by 1),
j as (select coalesce(top, 0.0) as top, coalesce(mean3, 0.0) as mean3 from (select id as query_id from a where side = 'q') left join t using (query_id))
select count(*) as queries, count(*) filter (where top < 0.55) as weak, round(avg(top), 6) as mean_top, round(avg(mean3), 6) as mean_top3 from j""",
    "q_disagreement_kinds": f"select case {_CASES} else 'other' end as kind, count(*) as n from (select distinct example_id, dimension, judge_rationale, absolute_difference, lower(coalesce(judge_rationale, '')) as t from human_judge_largest_disagreements where absolute_difference > 0) group by 1",
    "q_score_summary": f"with {_J} select dimension, count(human_score) as n, round(avg(human_score), 6) as mean, median(human_score) as median, round(coalesce(stddev_samp(human_score), case when count(human_score) = 1 then 0.0 end), 6) as std, " + " || ',' || ".join(f"count(*) filter (where human_score = {i})" for i in range(1, 6)) + " as counts from j group by 1",
    "q_bias_ranking": f"with {_J}, a as (select * from j union all select example_id, 'pooled', human_score, judge_score from j) select dimension, count(*) as n, round(avg(judge_score - human_score), 6) as bias, round(avg(abs(judge_score - human_score)), 6) as mae, round(abs(avg(judge_score - human_score)), 6) as size from a where human_score is not null and judge_score is not null group by 1",
    "q_sweep_f1": f"""with {_L}, t as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 2.0])::double as threshold), c as (select threshold, actual, predicted from t join l on confidence >= threshold),
g as (select threshold, label from t cross join labels), k as (select g.threshold, g.label, (select count(*) from c where c.threshold = g.threshold and actual = g.label) as sup, (select count(*) from c where c.threshold = g.threshold and predicted = g.label) as said, (select count(*) from c where c.threshold = g.threshold and actual = g.label and predicted = g.label) as tp from g),
f as (select threshold, avg(coalesce(2.0 * tp / nullif(sup + said, 0), 0)) as f1 from k group by 1), s as (select threshold, count(c.actual) as covered, count(*) filter (where c.actual = c.predicted) as ok from t left join c using (threshold) group by 1)
select threshold, covered, round(covered / (select count(*) from l), 9) as coverage, round(ok / nullif(covered, 0), 9) as accuracy, case when covered > 0 then round(f1, 9) end as macro_f1 from s join f using (threshold)""",
    "q_row_means": f"with {_J}, d as (select example_id, dimension, max(human_score) as s from j group by 1, 2) select example_id, round((min(s) + max(s) + sum(s) + avg(s) + count(s) + count(*)) / 6, 6) as mean from d group by 1",
    "q_formats": r"""select distinct thread_id, strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') as start, array_to_string(list_transform(string_split(replace(lower(resolution_status), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as status, lpad(cast(turn_count as varchar), cast(greatest(4, length(cast(turn_count as varchar))) as integer), '0') as turns, printf('%.2f%%', turn_count / 64.0 * 100) as share from train_conversations""",
}
