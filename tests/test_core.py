import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidewright import providers
from tidewright.functions import ids, text, vectors
from tidewright.operators import graph, integrity, metrics, models, rank, sampling, tfidf, threads
from tidewright.sources import readers, writers
from tidewright.streaming import events as streaming


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("x", "y"), [("12", "12"), (" 12.0", "12"), ("0012", "12"), ('"7"', "7"), ("nan", None), ("None", None), ("", None), (None, None), ("ab", "ab"), ("0", "0")])
def test_clean_id(spark, x, y):
    assert one(spark, x, ids.clean_id) == y


@pytest.mark.parametrize(("x", "y"), [("Mon Jan 01 04:17:44 +0000 2024", 1704082664), ("2024-01-01T06:17:44+02:00", 1704082664), ("2024-01-01T04:17:44Z", 1704082664), ("1704082664", 1704082664), ("not available", None), (None, None), ("", None), ("Mon Foo 99 04:17:44 +0000 2024", None)])
def test_parse_time(spark, x, y):
    assert one(spark, x, lambda c: F.unix_seconds(ids.parse_time(c))) == y


@pytest.mark.parametrize(("x", "y"), [("a", True), ("​﻿ \n\xa0", False), ("", False), (None, False), ("你", True)])
def test_has_text(spark, x, y):
    assert one(spark, x, ids.has_text) is y


def test_text_functions(spark):
    assert one(spark, "Great.  Another\t😀\n", text.normalize) == "Great. Another 😀"
    assert one(spark, "ﬁ　x", text.normalize) == "fi x"
    assert one(spark, None, text.normalize) == ""
    assert one(spark, "Email me at human@example.com", text.mask) == "Email me at [EMAIL]"
    assert one(spark, "order 303-1234567-1234567 on 2024-05-17", text.mask) == "order [PHONE] on [PHONE]"
    assert [one(spark, x, text.parse_bool) for x in ("True", "false", "not-a-bool", None)] == [True, False, None, None]
    assert [one(spark, x, text.loose_bool) for x in ("yes", "0", "", None, "maybe")] == [True, False, False, False, None]
    assert one(spark, "1, 20,nan,,", text.id_list) == ["1", "20"]
    assert one(spark, None, text.id_list) == []
    assert one(spark, "help", lambda c: text.language(c, text.script_language)) == "und"
    assert one(spark, "помогите пожалуйста", lambda c: text.language(c, text.script_language)) == "ru"
    assert one(spark, "a &amp; b https://x.y @me", text.topic_text) == "a & b URL MENTION"
    rules = [("a", "(?i)late"), ("b", "late|lost")]
    assert one(spark, "late", lambda c: text.rule_labels(c, rules, {"a": "b"})) == ["a"]
    assert one(spark, None, lambda c: text.rule_labels(c, rules)) == []
    assert one(spark, "x", lambda c: text.flag_list([("p", c == "x"), ("q", c.isNull()), ("p", c == "x")])) == ["p"]


def test_vectors(spark):
    e = spark.createDataFrame([(i, [float(i % 3), float(i)], "c") for i in range(40)] + [(99, None, "c"), (98, [], "c")], "corpus_id long, v array<float>, score string")
    q = e.where("corpus_id in (3, 7)").select(F.col("corpus_id").alias("query_id"), "v")
    got = [(r[0], r[1]) for r in vectors.nearest(q, e, 3, block=1).orderBy("query_id", "rank").collect()]
    data = {r[0]: r[1] for r in e.collect() if r[1]}
    for k in (3, 7):
        best = sorted(data, key=lambda c: (-sum(a * b for a, b in zip(data[k], data[c], strict=True)), c))[:3]
        assert [c for x, c in got if x == k] == best
    assert vectors.nearest(q.limit(0), e, 3).count() == 0
    assert one(spark, [3.0, 4.0], vectors.l2_normalize, "array<double>") == [0.6, 0.8]


def union_find(vs, es):
    up = {v: v for v in vs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in es:
        if a in up and b in up and a != b:
            a, b = sorted((find(a), find(b)), key=int)
            up[b] = a
    return {v: find(v) for v in vs}


def test_components(spark):
    random.seed(3)
    vs = [str(i) for i in range(1, 150)]
    es = [(random.choice(vs), random.choice(vs)) for _ in range(90)] + [(str(i), str(i + 1)) for i in range(100, 148)] + [("5", "777"), ("6", None), ("7", "7")] + [("10", "9")] * 3
    got = graph.components(spark.createDataFrame([(v, "x") for v in vs] + [(None, "x")], "id string, label string"), spark.createDataFrame(es, "a string, b string"), "a", "b")
    assert dict(map(tuple, got.collect())) == union_find(vs, [e for e in es if None not in e])
    empty = spark.createDataFrame([], "id string")
    assert graph.components(empty, spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    lone = graph.components(spark.createDataFrame([("3",)], "id string"), spark.createDataFrame([], "a string, b string"), "a", "b").collect()
    assert [tuple(r) for r in lone] == [("3", "3")]


def test_reachable_through_missing_ids(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "x"), ("x", "3"), ("8", "9")], "a string, b string")
    got = graph.reachable(spark.createDataFrame([("1",), (None,)], "id string"), e, "a", "b")
    assert {r[0] for r in got.collect()} == {"1", "2", "x", "3"}


def test_ranked_windows(spark):
    data = [(("hot" if i % 3 else "cold"), i % 7, i) for i in range(400)] + [(None, 1, 1000)]
    df = spark.createDataFrame(data, "k string, t int, id int").withColumn("size", F.lit(400).cast("long"))
    got = {r["id"]: r["n"] for r in rank.skew_safe_row_number(df, "k", "size", ["t", "id"], "n", limit=10).collect()}
    for k in ("hot", "cold", None):
        order = [i for _, _, i in sorted((x for x in data if x[0] == k), key=lambda x: x[1:])]
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    assert rank.ranged_running(df.limit(0), ["k"], ["id"], F.lit(1), "n").count() == 0


def test_threads(spark):
    t = dt.datetime
    rows = spark.createDataFrame(
        [("10", "t", None, "CUSTOMER", "hi", t(2024, 1, 1)), ("2", "t", "10", "AGENT", "hello", t(2024, 1, 2)), ("3", "t", "10", "AGENT", "hello?", None), ("4", "t", "2", "CUSTOMER", "so", t(2024, 3, 2)), ("5", "u", "77", "OTHER", "x", t(2024, 1, 1))],
        "id string, th string, parent string, who string, txt string, at timestamp",
    )
    turns = {r["id"]: r["turn_number"] for r in threads.number_turns(rows, "th", "at", "id").collect()}
    assert turns == {"10": 1, "2": 2, "4": 3, "3": 4, "5": 1}
    g = {r[0]: (r[1], r[2]) for r in threads.gaps(rows, "th", "at", "id").collect()}
    assert g == {"t": (60.0, True), "u": (0.0, False)}
    assert {r["th"] for r in threads.drop_contaminated(rows, "th", F.col("who") == "OTHER").collect()} == {"t"}
    assert {r["id"]: r["missing_parent"] for r in threads.missing_parent(rows, "id", "parent").collect()}["5"] is True
    assert {r["th"]: r["branching_thread"] for r in threads.branching(rows, "th", "parent").collect()} == {"t": True, "u": False}
    c = {r["th"]: r for r in threads.conversations(threads.number_turns(rows, "th", "at", "id"), "th", "turn_number", "who", "txt", "at").collect()}
    assert c["t"]["all_customer_messages"] == ["hi", "so"] and c["t"]["all_agent_responses"] == ["hello", "hello?"] and c["t"]["terminal_speaker"] == "AGENT"
    p = threads.pairs(rows.unionByName(rows.where("id = '4'")), "id", "parent", "th", "who", "txt", "at")
    assert {(r["customer_tweet_id"], r["agent_tweet_id"]) for r in p.collect()} == {("10", "2"), ("10", "3")}
    days = spark.createDataFrame([(f"{i:02d}", t(2024, 1, 1 + i)) for i in range(10)], "k string, at timestamp")
    s = threads.temporal_split(days, "k", "at", (0.7, 0.1, 0.2)).groupBy("split").agg(F.sort_array(F.collect_list("k"))).collect()
    assert dict(map(tuple, s))["train"] == [f"{i:02d}" for i in range(7)] and len(dict(map(tuple, s))["test"]) == 2
    assert threads.temporal_split(days.limit(0), "k", "at").count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 5) for i in range(60)], "id int, s string, p int")
    assert sampling.sample(df, "id", 7, 1).collect() == sampling.sample(df.repartition(7), "id", 7, 1).collect()
    assert {r[0]: r[1] for r in sampling.sample_per_stratum(df, "id", "s", 4, 1).groupBy("s").count().collect()} == {"a": 4, "b": 4, "c": 4}
    q = sampling.quota_sample(df, "id", "s", {"a": 30, "b": 2}, 40, 1)
    n = {r[0]: r[1] for r in q.groupBy("s").count().collect()}
    assert sum(n.values()) == 40 and n["a"] == 20 and q.select("id").distinct().count() == 40
    assert [r["s"] for r in sampling.round_robin(df, "id", "s", 6, 1).collect()] == ["a", "b", "c", "a", "b", "c"]
    f = sampling.first_per_label_then_fill(df, "id", "s", "p", 5).collect()
    assert {r["s"] for r in f[:3]} == {"a", "b", "c"}
    parts = {(r["s"], r["part"]): r["count"] for r in sampling.stratified_split(df, "id", "s", 0.25, 1).groupBy("s", "part").count().collect()}
    assert parts["a", "validation"] == 5
    assert sampling.keep_first(df, ["s"], ["p", "id"]).count() == 3
    groups = [("x", F.col("p") == 4, F.col("id")), ("y", F.col("p") == 4, F.col("id")), ("none", F.col("p") == 9, F.col("id"))]
    assert [(r["category"], r["id"]) for r in sampling.priority_selection(df, "id", groups, ("rest", F.lit(True), F.col("id")), 4).collect()] == [("x", 4), ("y", 9), ("rest", 0), ("rest", 1)]


def test_measures(spark):
    d = spark.createDataFrame([("E", "A"), ("E", "E"), ("A", "E"), ("A", "A")], "a string, p string")
    b = metrics.binary_scores(d, F.col("a") == "E", F.col("p") == "E").first()
    assert (b["tp"], b["fp"], b["fn"], b["tn"], b["accuracy"]) == (1, 1, 1, 1, 0.5)
    labels = spark.createDataFrame([("A",), ("E",), ("Z",)], "label string")
    assert metrics.overall_scores(d, labels, "a", "p").first()["macro_f1"] == pytest.approx(1 / 3)
    assert metrics.confusion(d, labels, "a", "p").count() == 9
    r = spark.createDataFrame([("d", 4, 4)] * 20 + [("d", 4, 3)] * 20 + [("d", None, 3)], "dim string, h int, j int")
    x = metrics.agreement(r, "h", "j", ["dim"]).first()
    assert (x["exact"], x["within_one"], x["bias"], x["pearson"]) == (0.5, 1.0, -0.5, None)
    v = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double")
    assert metrics.distribution(v, "v", {"p95": 0.95}).first()["p95"] == pytest.approx(3.85)
    assert metrics.distribution(v.limit(0), "v", {"p95": 0.95}).first()["p95"] is None
    s = {t: (c, a) for t, c, _, a in metrics.threshold_sweep(v, [0.0, 9.0], "v", F.col("v") > 2).collect()}
    assert s == {0.0: (4, 0.5), 9.0: (0, None)}


def brute_tfidf(docs, terms):
    import math
    from collections import Counter

    tf = {k: Counter(terms(t)) for k, t in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for k, c in tf.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[k] = {t: x / norm for t, x in w.items()}
    return out


def test_tfidf_pairs_against_brute_force(spark):
    random.seed(1)
    vocabulary = ["red", "blue", "lamp", "rug", "tent", "late", "lost", "box"]
    docs = {i: " ".join(random.choice(vocabulary) for _ in range(random.randint(1, 9))) for i in range(60)} | {100: None, 101: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, t string")
    w = tfidf.weights(df, "id", tfidf.word_terms(F.col("t"), bigrams=False))
    true = brute_tfidf(docs, lambda t: (t or "").split())
    for r in w.collect():
        assert r["weight"] == pytest.approx(true[r["id"]][r["term"]])
    pairs = {(r[0], r[1]): r[2] for r in tfidf.similar_pairs(w, "id", 0.7).collect()}
    want = {(a, b): s for a in true for b in true if a < b and (s := sum(x * true[b].get(t, 0) for t, x in true[a].items())) >= 0.7}
    assert pairs.keys() == want.keys() and all(pairs[k] == pytest.approx(want[k]) for k in want)
    assert set(spark.createDataFrame([("ab",)], "t string").select(tfidf.char_terms(F.col("t"))).first()[0]) == {" ab", "ab ", " ab "}
    assert tfidf.word_terms is not None and spark.createDataFrame([("a bc de",)], "t string").select(tfidf.word_terms(F.col("t"))).first()[0] == ["bc", "de", "bc de"]


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "id int, v string")
    assert integrity.changed(a, b, "id", ["v"]).first()["changed_v"] == 1
    assert {r["rule"]: r["failures"] for r in integrity.rule_failures(a, {"v": F.col("v") != "", "id": F.col("id") > 0}).collect()} == {"v": 1, "id": 0}
    with pytest.raises(ValueError, match="v: 1"):
        integrity.require(integrity.rule_failures(a, {"v": F.col("v") != ""}))
    s = integrity.set_sizes(a.select("id"), b.select("id")).first()
    assert (s["n_both"], s["only_right"], s["subset"]) == (2, 1, True)
    m = integrity.membership({"p": a.select("id"), "q": b.select("id")}, "ns")
    assert integrity.overlap_counts(m, "p").first()["p_and_q"] == 2 and len(m.first()["id"]) == 64
    with pytest.raises(ValueError, match="unique"):
        integrity.one_to_one(a.unionByName(a), b, "id")
    c = {r["id"]: r["state"] for r in integrity.cache_lookup(b, a, "id", "v").collect()}
    assert c[1] == "mismatch" and c[3] == "miss"
    u = integrity.upsert(spark.createDataFrame([(1, "a", "t0", "t0"), (2, "b", None, None)], "id int, v string, labeled_at string, updated_at string"), b, "id", F.lit("now"))
    assert {tuple(r) for r in u.collect()} == {(1, "y", "t0", "now"), (2, None, "now", "now"), (3, "z", "now", "now")}
    assert {r["id"]: r["v"] for r in integrity.latest(b, a, "id").collect()} == {1: "x", 2: None, 3: "z"}
    assert integrity.same_order(a, b, "id", "v").count() == 2
    f = spark.createDataFrame([("k", 1.0)], "k string, v double")
    assert integrity.within_tolerance(f, f, "k", "v").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,5,True,x,"a ""q""\nb",2,\n2,Acme,maybe,,c,,1\n')
    m = {r["tweet_id"]: r for r in readers.read_messages(spark, str(csv)).collect()}
    assert m["1"]["text"] == 'a "q"\nb' and m["1"]["inbound"] == 1 and m["2"]["inbound"] is None
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv_strings(spark, str(csv), ["nope"])
    t = tmp_path / "t.csv"
    t.write_text("id,n\na,1\nb,x\n")
    schema = StructType([StructField("id", StringType()), StructField("n", IntegerType())])
    with pytest.raises(ValueError, match="n: 1"):
        readers.read_typed_csv(spark, str(t), schema)
    assert readers.read_typed_csv(spark, str(t), schema, strict=False).where("n is null").count() == 1
    j = tmp_path / "d.json"
    j.write_text(json.dumps({"records": [{"id": "a", "n": 1}, {"id": "b"}]}))
    assert readers.read_json_records(spark, str(j), schema).count() == 2
    jl = tmp_path / "d.jsonl"
    jl.write_text('{"id":"a","n":1}\n\n{"id":"a","n":2}\n')
    assert [tuple(r) for r in readers.read_jsonl_latest(spark, str(jl), schema, "id").collect()] == [("a", 2)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, part string")
    assert writers.write_atomic(df, out) == 2 and writers.write_atomic(df.limit(1), out) == 1 and spark.read.parquet(out).count() == 1
    assert [p.name for p in tmp_path.iterdir() if ".stage-" in p.name or ".old-" in p.name] == []
    assert writers.resume(df, str(tmp_path / "none"), "id").count() == 2 and writers.resume(df, out, "id").count() == 1
    writers.write_partitioned(df, str(tmp_path / "parts"), "part")
    assert (tmp_path / "parts" / "part=x").exists()
    writers.append_audit(df, str(tmp_path / "audit"))
    writers.append_audit(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    files = readers.read_files(spark, str(tmp_path), "*.csv")
    manifest = files.select(F.regexp_replace("path", ".*/", "").alias("path"), "size_bytes", "sha256")
    assert readers.verify_manifest(files, manifest, str(tmp_path)).count() == 0
    bad = manifest.withColumn("sha256", F.lit("00")).unionByName(spark.createDataFrame([("../x", 1, "00")], "path string, size_bytes long, sha256 string"))
    assert {r["problem"] for r in readers.verify_manifest(files, bad, str(tmp_path)).collect()} == {"other content", "path escapes the root", "missing"}
    tax = tmp_path / "tax.json"
    tax.write_text(json.dumps({"status": "approved", "intents": [{"name": f"n{i}", "description": "d"} for i in range(9)]}))
    assert readers.read_taxonomy(spark, str(tax), ["name"]).count() == 9
    with pytest.raises(ValueError, match="items"):
        readers.read_taxonomy(spark, str(tax), ["name"], low=10)


def test_streaming_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("u"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 400).alias("ts"), F.lit("call 07700 900 123 now").alias("text"))
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = streaming.masked_stream(stream, "text").writeStream.format("memory").queryName("masked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("masked").where("model_text = 'call [PHONE] now'").count() == 200
    q = streaming.sessions(stream, "u", "ts").writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    done = {tuple(r) for r in spark.table("sess").collect()}
    assert done <= {tuple(r) for r in streaming.sessions(df, "u", "ts").collect()}
    q = streaming.distinct_messages(stream.unionByName(stream), "id", "ts").writeStream.format("memory").queryName("dist").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dist").count() == 200


class Failing(providers.Provider):
    def generate(self, prompts):
        raise providers.ProviderUnavailable("down")


def test_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    assert {r["id"]: json.loads(r["answer"])["reply"] for r in providers.generate(df, "id", "p", providers.EchoProvider()).collect()} == {1: "a", 2: "b"}
    assert {r["error"] for r in providers.generate(df, "id", "p", Failing()).collect()} == {"down"}
    assert sum(x * x for x in providers.embed(df, "id", "p", providers.EchoProvider()).first()["v"]) == pytest.approx(1)
    assert providers.parse_object('```json\n{"a": [1, {"b": 2}]}\n```') == {"a": [1, {"b": 2}]}
    assert providers.parse_object('so {"a": [1, {"b": 2') == {"a": [1, {"b": 2}]}
    assert [providers.parse_object(x) for x in ('{"a": [1}', '{"a": "x', "[1]", None, "")] == [None] * 5


def test_models(spark):
    rows = [(f"{i}", "parcel late courier" if i % 2 else "refund money card", "late" if i % 2 else "money") for i in range(40)]
    df = spark.createDataFrame(rows + [("z", None, None)], "id string, t string, y string")
    predict = models.fit_text_classifier(df, "t", "y", max_iter=5)
    assert predict(df.where("y is not null"), "t").where("y <> predicted").count() == 0
    w = tfidf.weights(df, "id", tfidf.word_terms(F.col("t"), bigrams=False))
    found, terms = models.topics(w, "id", 2, iterations=15)
    by = {r["id"]: r["topic"] for r in found.collect()}
    assert len({by[str(i)] for i in range(0, 40, 2)}) == len({by[str(i)] for i in range(1, 40, 2)}) == 1 and by["0"] != by["1"] and terms.count() > 0
