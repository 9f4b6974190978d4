"""Queries of text functions, measures, vectors, TF-IDF and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import text, vectors
from ..operators import metrics, tfidf
from ..session import table
from ..streaming import events as streaming

#: Ordered rules of the label query: plain topics of the test messages.
RULES = [
    ("late", r"(?i)\b(?:late|delay\w*|waiting for|not arrived)\b"), ("refund", r"(?i)\b(?:refund\w*|charged?)\b"), ("damage", r"(?i)\b(?:broken|crack|dented|soaked|torn)\b"),
    ("account", r"(?i)\b(?:login|password|account)\b"), ("courier", r"(?i)\b(?:courier|driver|carrier)\b"), ("delivery", r"(?i)\b(?:deliver\w*|parcel|courier)\b"),
]
SUPPRESS = {"courier": "delivery"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def q_text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and flags of every document as it is but for white space; q_enriched has those of normalized messages."""
    d = _docs(spark, sf_dir).withColumn("n", text.collapse(F.col("text")))
    m = text.text_metadata(F.col("n"))
    return d.select("doc_id", *[m[k].alias(k) for k in ("url_count", "mention_count", "character_count", "token_count", "emoji_present", "question_present")])


def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked text of every message whose masked text differs; normalized first."""
    t = table(spark, sf_dir, "tweets").select("tweet_id", "text").distinct()
    n = t.withColumn("n", text.normalize(F.col("text"))).withColumn("masked", text.mask(F.col("n")))
    return n.where("masked <> n").select("tweet_id", "masked")


def q_topic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic text of every message with entities, links or mentions."""
    t = table(spark, sf_dir, "tweets").select("tweet_id", "text").distinct().where("text is not null")
    return t.select("tweet_id", text.topic_text(F.col("text")).alias("topic"))


def q_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language guess by script and length."""
    d = _docs(spark, sf_dir)
    return d.groupBy(text.language(F.col("text"), text.script_language).alias("guess")).agg(F.count("*").alias("n"))


def q_rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rule labels of every golden message."""
    g = table(spark, sf_dir, "golden_set").select("example_id", "customer_message")
    return g.select("example_id", F.array_join(text.rule_labels(F.col("customer_message"), RULES, SUPPRESS), ",").alias("labels"))


def q_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per rule and the five least example ids of each (a report)."""
    g = table(spark, sf_dir, "golden_set").select("example_id", "customer_message")
    tall = g.select("example_id", F.explode(text.rule_labels(F.col("customer_message"), RULES)).alias("rule"))
    w = Window.partitionBy("rule").orderBy("example_id")
    first = tall.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("example_id")), ",").alias("examples"))
    return tall.groupBy("rule").agg(F.count("*").alias("n")).join(first, "rule")


def q_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the first bucket that fits: question, short, with numbers, other."""
    t = F.coalesce(F.col("text"), F.lit(""))
    b = F.when(t.contains("?"), "question").when(F.length(t) <= 40, "short").when(t.rlike("[0-9]"), "numbers").otherwise("other")
    return _docs(spark, sf_dir).groupBy(b.alias("bucket"), "source").agg(F.count("*").alias("n"))


def q_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys and hashes of the judged rows."""
    h = table(spark, sf_dir, "human_judge_largest_disagreements").select("example_id", "dimension").distinct()
    return h.select(text.composite_key(F.col("example_id"), F.col("dimension")).alias("k"), text.namespaced_hash("judge", F.col("example_id")).alias("h"))


def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of event values by type."""
    d = metrics.distribution(table(spark, sf_dir, "events"), "value", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, ["event_type"])
    return d.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "p95", "mean", "max")])


def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human scores 1 to 5 of each dimension, zeros included."""
    return metrics.score_histogram(_judged(spark, sf_dir), "human_score", 1, 5, "dimension")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "human_judge_largest_disagreements").select("example_id", "dimension", "human_score", "judge_score").distinct()


def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of human and judge per dimension."""
    a = metrics.agreement(_judged(spark, sf_dir), "human_score", "judge_score", ["dimension"])
    return a.select("dimension", "n", "over", "under", "equal", *[F.round(c, 6).alias(c) for c in ("exact", "within_one", "bias", "mae", "pearson", "spearman", "kappa_linear", "kappa_quadratic")])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual class: order status; predicted: from the priority and price."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("actual"), F.when(F.col("o_orderpriority") < "2", "F").when(F.col("o_totalprice") > 150_000, "O").otherwise("P").alias("predicted"), (F.col("o_totalprice") / 500_000).alias("confidence"))


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "label string")


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts over a fixed label list."""
    return metrics.confusion(_labelled(spark, sf_dir), _labels(spark), "actual", "predicted")


def q_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of every label."""
    c = metrics.class_scores(_labelled(spark, sf_dir), _labels(spark), "actual", "predicted")
    return c.select("label", "support", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def q_overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro and weighted scores."""
    c = metrics.overall_scores(_labelled(spark, sf_dir), _labels(spark), "actual", "predicted")
    return c.select("rows", *[F.round(x, 9).alias(x) for x in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")])


def q_binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a yes/no decision."""
    b = metrics.binary_scores(_labelled(spark, sf_dir), F.col("actual") == "O", F.col("predicted") == "O")
    return b.select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1", "miss_rate")])


def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy at thresholds of confidence."""
    s = metrics.threshold_sweep(_labelled(spark, sf_dir), [0.0, 0.2, 0.4, 0.6, 0.8, 2.0], "confidence", F.col("actual") == F.col("predicted"))
    return s.select("threshold", "covered", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


def q_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent golden intent."""
    return metrics.most_frequent(table(spark, sf_dir, "golden_set").where("human_intent is not null"), "human_intent", "example_id")


def q_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each system by dimension and overall."""
    j = _judged(spark, sf_dir)
    tall = j.select("dimension", F.explode(F.create_map(F.lit("human"), F.col("human_score"), F.lit("judge"), F.col("judge_score"))).alias("system", "score"))
    every = tall.unionByName(tall.withColumn("dimension", F.lit("overall")))
    return every.groupBy("system", "dimension").agg(F.round(F.avg("score"), 9).alias("mean_score"))


def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, itself included."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    n = vectors.nearest(q, e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v")), 5)
    return n.select("query_id", "rank", "corpus_id", F.round("score", 5).alias("score"))


def q_topk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of different labels of every fiftieth vector: the label stands for the response key."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    n = vectors.nearest(q, e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v"), "label"), 3, key="label")
    return n.select("query_id", "rank", "corpus_id", F.round("score", 5).alias("score"))


def q_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same label of every fiftieth vector: the label stands for the intent."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), "label")
    n = vectors.nearest(q, e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v"), "label"), 5, predicate="label")
    return n.select("query_id", "rank", "corpus_id", F.round("score", 5).alias("score"))


def q_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and second label of every vector by the mean vectors of the labels, with margin and confidence."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    best = prototypes(e).select("vec_id", vectors.top_two(F.transform("scores", lambda x: F.struct(F.round(x["score"], 6).alias("score"), x["label"].alias("label")))).alias("t"))
    return best.select("vec_id", F.col("t.best.label").alias("best"), F.col("t.second.label").alias("second"), F.round("t.margin", 3).alias("margin"))


def prototypes(e: DataFrame) -> DataFrame:
    """(vec_id, label, scores): the dot products of every vector with the mean vectors of the labels.

    The mean vectors, one a label of the taxonomy, go to the rows as one array: no shuffle of the rows. More than
    10,000 labels are refused, as the array is sent to all tasks.
    """
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    p = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    one = p.agg(F.collect_list(F.struct("label", vectors.l2_normalize(F.col("v")).alias("v"))).alias("ps"))
    few = one.select(F.when(F.size("ps") <= 10_000, F.col("ps")).otherwise(F.raise_error(F.lit("more than 10,000 labels"))).alias("ps"))
    s = e.crossJoin(F.broadcast(few))  # one row
    return s.select("vec_id", "label", F.transform("ps", lambda x: F.struct(vectors.dot(F.col("embedding"), x["v"]).alias("score"), x["label"].alias("label"))).alias("scores"))


def q_tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest words of every document."""
    w = tfidf.weights(_docs(spark, sf_dir), "doc_id", tfidf.word_terms(F.col("text"), bigrams=False), min_df=2)
    return tfidf.top_terms(w, "doc_id", 3).select("doc_id", "rank", "term", F.round("weight", 6).alias("weight"))


def q_tfidf_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every golden message of id divisible by 50 in its round the most similar retrieval response pair by words."""
    r = table(spark, sf_dir, "retrieval_corpus").groupBy("customer_tweet_id").agg(F.min("customer_raw_text").alias("t")).select(F.concat(F.lit("c"), "customer_tweet_id").alias("id"), "t")
    g = table(spark, sf_dir, "golden_set").where(F.regexp_extract("example_id", r"(\d+)$", 1).try_cast("int") % 50 == 0).select(F.concat(F.lit("q"), "example_id").alias("id"), F.col("customer_message").alias("t"))
    w = tfidf.weights(r.unionByName(g), "id", tfidf.word_terms(F.col("t"), bigrams=False))
    q, c = w.where("id like 'q%'").withColumnRenamed("id", "query"), w.where("id like 'c%'").withColumnRenamed("id", "match")
    return tfidf.nearest_by_terms(q, c, "query", "match").select("query", "match", F.round("similarity", 6).alias("similarity"))


def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different golden and retrieval messages with a cosine of at least 0.8 over words."""
    r = table(spark, sf_dir, "retrieval_corpus").select(F.concat(F.lit("c"), "customer_tweet_id").alias("i"), F.col("customer_raw_text").alias("m"))
    g = r.unionByName(table(spark, sf_dir, "golden_set").select(F.concat(F.lit("g"), "example_id").alias("i"), F.col("customer_message").alias("m")))
    g = g.groupBy(text.duplicate_key(F.col("m")).alias("t")).agg(F.min("i").alias("id"))
    w = tfidf.weights(g, "id", tfidf.word_terms(F.col("t"), bigrams=False))
    return tfidf.similar_pairs(w, "id", 0.8).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t) of every golden and retrieval message, t being its normalized text; repeated rows count once."""
    r = table(spark, sf_dir, "retrieval_corpus").select(F.concat(F.lit("c"), "customer_tweet_id").alias("id"), F.col("customer_raw_text").alias("m"))
    g = r.unionByName(table(spark, sf_dir, "golden_set").select(F.concat(F.lit("g"), "example_id").alias("id"), F.col("customer_message").alias("m")))
    return g.select("id", text.audit_key(F.col("m")).alias("t")).distinct()


def _classes(audited: DataFrame) -> DataFrame:
    return audited.groupBy("t").agg(F.min("id").alias("class_id"))


def q_near_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of golden and retrieval messages with a cosine of at least 0.35 over pieces of 3 to 5 characters.

    Messages of the same normalized text form a class, named by its smallest id. The pairs are those of the classes
    (exact false) and, for every further member, that of its class and itself (exact true). Empty texts have no pairs.
    """
    audited = _audited(spark, sf_dir)
    classes = _classes(audited)
    near = tfidf.close_pairs(classes.select("t"), "t", tfidf.char_terms(F.col("t"), 3, 5), 0.35)
    near = near.join(classes.toDF("a", "x"), "a").join(classes.toDF("b", "y"), "b").where("x <> y")
    pairs = near.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), F.round("similarity", 6).alias("similarity"), F.lit(False).alias("exact"))
    members = audited.join(classes, "t").where("id <> class_id and t <> ''")
    return pairs.unionByName(members.select(F.col("class_id").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("exact")))


def q_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class_id) of every golden and retrieval message: its class of equal normalized texts."""
    audited = _audited(spark, sf_dir)
    return audited.join(_classes(audited), "t").select("id", "class_id")


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of events by type and the number k in their properties."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user with a pause of half an hour, as the streaming operator computes them."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = streaming.sessions(e, "user_id", "ts")
    return s.select("user_id", F.unix_seconds("session_start").alias("start_s"), F.unix_seconds("session_end").alias("end_s"), "events")


def q_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, as the streaming operator counts them."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(e, "ts", "event_type").select(F.unix_seconds("start").alias("start_s"), "event_type", "events")


def q_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stand-in provider to the golden messages; the operator that calls models in batches."""
    g = table(spark, sf_dir, "golden_set").select("example_id", F.coalesce("customer_message", F.lit("")).alias("prompt"))
    return providers.generate(g, "example_id", "prompt", providers.EchoProvider()).select("example_id", F.get_json_object("answer", "$.reply").alias("reply"), "error")


def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the baseline that always says the most frequent intent."""
    g = table(spark, sf_dir, "golden_set").where("human_label_complete and human_intent is not null").select("example_id", "human_intent")
    top = metrics.most_frequent(g, "human_intent", "example_id").select(F.col("human_intent").alias("said"))
    p = g.crossJoin(F.broadcast(top))  # one row
    s = metrics.overall_scores(p, g.select(F.col("human_intent").alias("label")).distinct(), "human_intent", "said")
    return s.select("rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_SP = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
_WS = rf"regexp_replace(regexp_replace(coalesce({{c}}, ''), '{_SP.replace('{', '{{').replace('}', '}}')}', ' ', 'g'), '^ | $', '', 'g')"
_NO_LINKS = r"regexp_replace(m, '(?i)https?://\S+|www\.\S+|@\w+', ' ', 'g')"
_L = """l as (select o_orderkey, o_orderstatus as actual, case when o_orderpriority < '2' then 'F' when o_totalprice > 150000 then 'O' else 'P' end as predicted, o_totalprice / 500000 as confidence from orders), labels as (select unnest(['F','O','P','X']) as label)"""
_J = "j as (select distinct example_id, dimension, human_score, judge_score from human_judge_largest_disagreements)"
_CS = """a as (select actual as label, count(*) as support, count(*) filter (where actual = predicted) as tp from l group by 1), p as (select predicted as label, count(*) as said from l group by 1),
c as (select label, coalesce(support, 0) as support, coalesce(coalesce(tp, 0) / nullif(said, 0), 0) as precision, coalesce(coalesce(tp, 0) / nullif(support, 0), 0) as recall from labels left join a using (label) left join p using (label)),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from c)"""
_RULE_CASES = ", ".join(f"case when regexp_matches(coalesce(customer_message, ''), '{p}') then '{n}' end" for n, p in RULES)
_TF = r"""tok as (select id, unnest(list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) as term from src),
tf as (select id, term, count(*) as tf from tok group by 1, 2), df as (select term, count(*) as df from tf group by 1 having count(*) >= {min_df}),
raw as (select id, term, (1 + ln(tf)) * (ln((1.0 + (select count(*) from src)) / (1.0 + df)) + 1) as w from tf join df using (term)),
nrm as (select id, sqrt(sum(w * w)) as n from raw group by 1), wt as (select id, term, w / n as weight from raw join nrm using (id))"""

ORACLE = {
    "q_text_metadata": rf"""with d as (select doc_id, {_WS.format(c='text')} as n from documents)
select doc_id, cast(len(regexp_extract_all(n, '(?i)https?://\S+|www\.\S+')) as integer) as url_count, cast(len(regexp_extract_all(n, '(^|[^0-9A-Za-z_])@[0-9A-Za-z_]+')) as integer) as mention_count, cast(length(n) as integer) as character_count, cast(case when n = '' then 0 else len(string_split(n, ' ')) end as integer) as token_count,
regexp_matches(n, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]') as emoji_present, contains(n, '?') as question_present from d""",
    "q_rule_labels": f"""with r as (select example_id, list_filter([{_RULE_CASES}], lambda x: x is not null) as v from golden_set)
select example_id, array_to_string(case when list_contains(v, 'courier') then list_filter(v, lambda x: x <> 'delivery') else v end, ',') as labels from r""",
    "q_rule_counts": f"""with r as (select example_id, unnest(list_filter([{_RULE_CASES}], lambda x: x is not null)) as rule from golden_set),
f as (select *, row_number() over (partition by rule order by example_id) as r from r)
select rule, count(*) as n, string_agg(example_id, ',' order by example_id) filter (where r <= 5) as examples from f group by rule""",
    "q_buckets": """select case when contains(t, '?') then 'question' when length(t) <= 40 then 'short' when regexp_matches(t, '[0-9]') then 'numbers' else 'other' end as bucket, source, count(*) as n
from (select coalesce(text, '') as t, source from documents) group by 1, 2""",
    "q_hash_keys": "select distinct example_id || '|' || dimension as k, sha256('judge:' || example_id) as h from human_judge_largest_disagreements",
    "q_distribution": "select event_type, count(value) as count, round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean, round(max(value), 6) as max from events group by event_type",
    "q_histogram": f"with {_J} select d.dimension, cast(s.score as integer) as score, count(j.human_score) as n from (select distinct dimension from j) d cross join (select unnest([1,2,3,4,5]) as score) s left join j on j.dimension = d.dimension and j.human_score = s.score group by 1, 2",
    "q_agreement": f"""with {_J}, d as (select dimension, human_score as h, judge_score as g from j where human_score is not null and judge_score is not null),
r as (select *, g - h as x, rank() over (partition by dimension order by h) + (count(*) over (partition by dimension, h) - 1) / 2 as rh, rank() over (partition by dimension order by g) + (count(*) over (partition by dimension, g) - 1) / 2 as rg from d),
b as (select dimension, count(*) as n, count(*) filter (where x > 0) as over, count(*) filter (where x < 0) as under, count(*) filter (where x = 0) as equal, avg(case when x = 0 then 1 else 0 end) as exact, avg(case when abs(x) <= 1 then 1 else 0 end) as within_one, avg(x) as bias, avg(abs(x)) as mae,
 case when count(*) >= 3 and stddev_pop(h) > 0 and stddev_pop(g) > 0 then covar_pop(h, g) / (stddev_pop(h) * stddev_pop(g)) end as pearson, case when count(*) >= 3 and stddev_pop(rh) > 0 and stddev_pop(rg) > 0 then covar_pop(rh, rg) / (stddev_pop(rh) * stddev_pop(rg)) end as spearman, sum(abs(x)) as ol, sum(x * x) as oq from r group by dimension),
e as (select a.dimension, sum(abs(a.h - c.g)) as el, sum((a.h - c.g) * (a.h - c.g)) as eq from d a join d c using (dimension) group by 1)
select dimension, n, over, under, equal, round(exact, 6) as exact, round(within_one, 6) as within_one, round(bias, 6) as bias, round(mae, 6) as mae, round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(1 - ol * n / el, 6) as kappa_linear, round(1 - oq * n / eq, 6) as kappa_quadratic from b join e using (dimension)""",
    "q_confusion": f"with {_L} select a.label as actual, p.label as predicted, count(l.o_orderkey) as n from labels a cross join labels p left join l on l.actual = a.label and l.predicted = p.label group by 1, 2",
    "q_class_scores": f"with {_L}, {_CS} select label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from f",
    "q_overall_scores": f"with {_L}, {_CS} select (select count(*) from l) as rows, round((select avg(case when actual = predicted then 1 else 0 end) from l), 9) as accuracy, round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from f",
    "q_binary_scores": f"""with {_L}, b as (select count(*) filter (where actual = 'O' and predicted = 'O') as tp, count(*) filter (where actual <> 'O' and predicted = 'O') as fp, count(*) filter (where actual = 'O' and predicted <> 'O') as fn, count(*) filter (where actual <> 'O' and predicted <> 'O') as tn from l),
r as (select *, tp / (tp + fp) as p, tp / (tp + fn) as q from b)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy, round(p, 9) as precision, round(q, 9) as recall, round(2 * p * q / (p + q), 9) as f1, round(fn / (tp + fn), 9) as miss_rate from r""",
    "q_sweep": f"with {_L}, t as (select unnest([0.0, 0.2, 0.4, 0.6, 0.8, 2.0])::double as threshold) select threshold, count(*) filter (where confidence >= threshold) as covered, round(count(*) filter (where confidence >= threshold) / count(*), 9) as coverage, round(count(*) filter (where confidence >= threshold and actual = predicted) / nullif(count(*) filter (where confidence >= threshold), 0), 9) as accuracy from t cross join l group by threshold",
    "q_most_frequent": "select human_intent, count(*) as n, min(example_id) as first from golden_set where human_intent is not null group by 1 order by n desc, first limit 1",
    "q_mean_scores": f"with {_J}, t as (select dimension, 'human' as system, human_score as s from j union all select dimension, 'judge', judge_score from j), u as (select * from t union all select 'overall', system, s from t) select system, dimension, round(avg(s), 9) as mean_score from u group by 1, 2",
    "q_topk": """with q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as corpus_id, list_dot_product(a, embedding::double[]) as score from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, corpus_id) as rank from s) select query_id, cast(rank as integer) as rank, corpus_id, round(score, 5) as score from r where rank <= 5""",
    "q_topk_dedupe": """with q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as corpus_id, label, list_dot_product(a, embedding::double[]) as score from q cross join embeddings),
k as (select *, row_number() over (partition by query_id, label order by score desc, corpus_id) as of_key from s), r as (select *, row_number() over (partition by query_id order by score desc, corpus_id) as rank from k where of_key = 1)
select query_id, cast(rank as integer) as rank, corpus_id, round(score, 5) as score from r where rank <= 3""",
    "q_topk_filtered": """with q as (select vec_id as query_id, label as l, embedding::double[] as a from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as corpus_id, list_dot_product(a, embedding::double[]) as score from q cross join embeddings where l is null or label is null or label = l),
r as (select *, row_number() over (partition by query_id order by score desc, corpus_id) as rank from s) select query_id, cast(rank as integer) as rank, corpus_id, round(score, 5) as score from r where rank <= 5""",
    "q_tfidf_terms": f"""with src as (select doc_id as id, text as t from documents), {_TF.replace('{min_df}', '2')}, r as (select *, row_number() over (partition by id order by round(weight, 9) desc, term) as rank from wt)
select id as doc_id, cast(rank as integer) as rank, term, round(weight, 6) as weight from r where rank <= 3""",
    "q_tfidf_nearest": rf"""with src as (select 'c' || customer_tweet_id as id, min(customer_raw_text) as t from retrieval_corpus group by 1 union all select 'q' || example_id, customer_message from golden_set where try_cast(regexp_extract(example_id, '(\d+)$', 1) as integer) % 50 = 0), {_TF.replace('{min_df}', '1')},
s as (select a.id as query, b.id as match, sum(a.weight * b.weight) as similarity from wt a join wt b using (term) where a.id like 'q%' and b.id like 'c%' group by 1, 2)
select query, match, round(similarity, 6) as similarity from s qualify row_number() over (partition by query order by round(similarity, 9) desc, match) = 1""",
    "q_near_duplicates": f"""with r as (select 'c' || customer_tweet_id as i, customer_raw_text as m from retrieval_corpus union all select 'g' || example_id, customer_message from golden_set),
k as (select i, lower({_WS.format(c=_NO_LINKS)}) as t from r), src as (select t, min(i) as id from k group by t), {_TF.replace('{min_df}', '1')},
s as (select a.id as left_id, b.id as right_id, sum(a.weight * b.weight) as similarity from wt a join wt b using (term) where a.id < b.id group by 1, 2)
select left_id, right_id, round(similarity, 6) as similarity from s where similarity >= 0.8""",
    "q_prototypes": """with x as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from x group by 1, 2),
n as (select label, sqrt(sum(x * x)) as n from m group by 1), s as (select x.vec_id, m.label, round(sum(x.x * m.x / n.n), 6) as score from x join m using (i) join n on n.label = m.label group by 1, 2),
r as (select *, row_number() over (partition by vec_id order by score desc, label) as r from s)
select a.vec_id, a.label as best, b.label as second, round(a.score - b.score, 3) as margin from r a join r b on a.vec_id = b.vec_id and a.r = 1 and b.r = 2""",
    "q_json_props": "select event_type, cast(json_extract(props, '$.k') as integer) as k, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2",
    "q_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as f from events), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from e)
select user_id, cast(floor(epoch(min(ts))) as bigint) as start_s, cast(floor(epoch(max(ts) + interval 30 minute)) as bigint) as end_s, count(*) as events from s group by user_id, s""",
    "q_windowed": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, event_type, count(*) as events from events group by 1, 2",
    "q_generate": "select example_id, coalesce(customer_message, '') as reply, cast(null as varchar) as error from golden_set",
    "q_baseline": """with g as (select example_id, human_intent as i from golden_set where human_label_complete and human_intent is not null), c as (select i, count(*) as n, min(example_id) as f from g group by 1), t as (select * from c order by n desc, f limit 1), k as (select count(*) as n from g),
s as (select c.i, c.n, case when c.i = t.i then 2 * (c.n / k.n) / (c.n / k.n + 1) else 0 end as f1 from c, t, k)
select (select n from k) as rows, round((select t.n / k.n from t, k), 9) as accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * n) / sum(n), 9) as weighted_f1 from s""",
}
