import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.functions import vectors
from tidewright.operators import packed, tfidf
from tidewright.plans import analytics, model_queries


def char_wb(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return out


def audit_by_hand(texts, threshold):
    tf = {t: Counter(char_wb(t)) for t in texts}
    df = Counter(k for c in tf.values() for k in c)
    vectors = {}
    for t, c in tf.items():
        v = {k: f * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[t] = {k: x / norm for k, x in v.items()}
    s = {(a, b): sum(x * vectors[b].get(k, 0) for k, x in vectors[a].items()) for a in texts for b in texts if a < b}
    return {k: x for k, x in s.items() if x >= threshold}


@pytest.mark.parametrize(("block", "dense"), [(4096, 2048), (7, 5), (7, 0)])
def test_close_pairs_against_brute_force(spark, block, dense):
    words = ["parcel", "parcels", "late", "later", "lost", "refund", "refunded", "a", "ok", "courier"]
    texts = sorted({" ".join(words[(i * k + i // 3) % 10] for k in range(1, 2 + i % 5)) for i in range(60)} | {""})
    want = audit_by_hand(texts, 0.35)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = tfidf.close_pairs(df, "t", tfidf.char_terms(F.col("t"), 3, 5), 0.35, block=block, dense=dense).collect()
    got = {tuple(sorted((r["a"], r["b"]))): r["similarity"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_near_duplicate_audit(spark, tmp_path):
    said = [("1", "Refund my parcels"), ("2", "@Acme refund  MY parcels"), ("3", "refunding my parcel"), ("4", "the lamp is torn"), ("5", "@Acme"), ("6", None)]
    spark.createDataFrame(said, "customer_tweet_id string, customer_raw_text string").write.parquet(f"{tmp_path}/retrieval_corpus.parquet")
    spark.createDataFrame([("9", "refund my parcels https://x.y/z")], "example_id string, customer_message string").write.parquet(f"{tmp_path}/golden_set.parquet")
    got = {(r["left_id"], r["right_id"], r["exact"]) for r in analytics.q_near_duplicate_audit(spark, str(tmp_path)).collect()}
    assert got == {("c1", "c3", False), ("c1", "c2", True), ("c1", "g9", True)}
    classes = {tuple(r) for r in analytics.q_duplicate_classes(spark, str(tmp_path)).select("id", "class_id").collect()}
    assert classes == {("c1", "c1"), ("c2", "c1"), ("g9", "c1"), ("c3", "c3"), ("c4", "c4"), ("c5", "c5"), ("c6", "c5")}


def test_nearest_with_response_key_and_predicate(spark):
    # a stock response holds a third of the corpus and all of the best rows
    data = [(i, [1.0 + (i % 3 == 0) * 5 + i / 100, 1.0], "stock" if i % 3 == 0 else f"r{i % 7}", "late" if i % 2 else "lost") for i in range(90)]
    data += [(90, [50.0, 1.0], None, None), (91, [40.0, 1.0], None, ""), (92, None, "x", "late")]
    corpus = spark.createDataFrame(data, "corpus_id long, v array<double>, response string, intent string").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 0.0], "late"), (2, [0.5, 1.0], None)], "query_id long, v array<double>, intent string")

    def by_hand(v, intent, k, keyed):
        rows = sorted((-(v[0] * x[0] + v[1] * x[1]), i, r) for i, x, r, w in data if x and (not intent or not w or w == intent))
        seen, out = set(), []
        for _, i, r in rows:
            if not keyed or r not in seen:
                seen.add(r)
                out.append(i)
        return out[:k]

    for keyed in (True, False):
        got = vectors.nearest(queries, corpus, 6, block=1, key="response" if keyed else None, predicate="intent").orderBy("query_id", "rank").collect()
        for q, v, intent in ((1, [1.0, 0.0], "late"), (2, [0.5, 1.0], None)):
            assert [r["corpus_id"] for r in got if r["query_id"] == q] == by_hand(v, intent, 6, keyed)
    assert vectors.nearest(queries.limit(0), corpus, 6, key="response", predicate="intent").count() == 0


def test_topics_count_every_thread(spark, tmp_path):
    kinds = ["parcel late courier", "refund money card", "login password account"]
    rows = [(f"t{i}", f"{kinds[i % 3]} the and") for i in range(60)] + [("rare", "zeppelin"), ("stop", "the and"), ("null", None)]
    spark.createDataFrame(rows, "thread_id string, customer_text string").write.parquet(f"{tmp_path}/dev_silver.parquet")
    n = {r["topic"]: r["texts"] for r in model_queries.q_topics(spark, str(tmp_path)).collect()}
    assert sum(n.values()) == 63 and sorted(n.values()) == sorted(20 + 3 * (k == 0) for k in range(3)) and n[0] == 23


def test_bare_joins_any_number_of_groups(spark):
    cells = ['"1,234,567,890,123,456,789"', '"12,345","12,346"', '12,345', '" 1,234 "', '"1,2345"', '"1234,567"', '5,"1,234,567,890,123,456",7', None]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(packed.bare(F.col("c"))).collect()]
    assert got == ['"1234567890123456789"', '"12345","12346"', '12,345', '" 1234 "', '"1,2345"', '"1234567"', '5,"1234567890123456",7', '']
