import sys

import pytest
from pyspark.sql import functions as F

from tidewright import session
from tidewright.functions import text, vectors
from tidewright.operators import graph, labelling, metrics, retrieval, sampling, threads
from tidewright.sources import readers, writers


def test_reach_over_a_long_chain(spark):
    n = 1_300
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)] + [("x", "y")], "a string, b string")
    got = {r[0] for r in graph.reachable(spark.createDataFrame([("0",)], "id string"), e, "a", "b").collect()}
    assert got == {str(i) for i in range(n + 1)}


def test_components_say_when_they_stop_short(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "a string, b string")
    v = spark.createDataFrame([(str(i),) for i in range(41)], "id string")
    with pytest.raises(RuntimeError):
        graph.components(v, e, "a", "b", max_rounds=1).count()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_scratch_removes_cuts(spark, tmp_path):
    import os

    def folders():
        at = session.shared_dir(spark).removeprefix("file://")
        return set(os.listdir(at)) if os.path.isdir(at) else set()

    before = folders()
    with session.scratch(spark) as keep:
        session.cut(spark.range(3))
        b = session.cut(spark.range(4))
        keep.append(b)
    assert len(folders() - before) == 1 and b.count() == 4
    session.drop_cut(b)
    assert folders() == before


def test_a_broken_import_inside_llm_shows(monkeypatch):
    import builtins

    real = builtins.__import__

    def fake(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "tidewright.llm" and fromlist:
            raise ModuleNotFoundError("No module named 'regex'", name="regex")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", fake)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.raises(ModuleNotFoundError):
        __import__("__spark_entry__")


def test_exact_quantiles_by_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 200)] + [(None, float(x)) for x in rng.random(31)] + [("b", None), ("c", 2.0)]
    got = {r["g"]: r for r in metrics.distribution(spark.createDataFrame(rows, "g string, v double"), "v", {"p25": 0.25, "p95": 0.95}, ["g"]).collect()}
    for g in ("a", None, "c"):
        v = [x for k, x in rows if k == g]
        assert abs(got[g]["p25"] - np.quantile(v, 0.25)) < 1e-12 and abs(got[g]["p95"] - np.quantile(v, 0.95)) < 1e-12 and got[g]["count"] == len(v)
    assert got["b"]["count"] == 0 and got["b"]["p25"] is None


@pytest.mark.parametrize("parts", [1, 64])
def test_samples_of_a_hot_stratum(spark, monkeypatch, parts):
    monkeypatch.setattr(sampling, "PARTS", parts)
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(400)], "id int, s string")
    got = sampling.sample_per_stratum(df, "id", "s", 5, 1).orderBy("id").collect()
    monkeypatch.setattr(sampling, "PARTS", 3)
    assert got == sampling.sample_per_stratum(df, "id", "s", 5, 1).orderBy("id").collect() and len(got) == 10
    split = sampling.stratified_split(df, "id", "s", 0.1, 1, hot=20)
    assert {(r["s"], r["n"]) for r in split.where("part = 'validation'").groupBy("s").agg(F.count("*").alias("n")).collect()} == {("hot", 27), (None, 13)}


def test_gaps_across_ranges(spark):
    rows = [("a", i * 10, str(i)) for i in range(50)] + [("a", 10_000, "z"), ("b", 5, "q"), ("c", None, "n")]
    df = spark.createDataFrame(rows, "t string, s long, id string").withColumn("at", F.timestamp_seconds("s"))
    got = {r["t"]: r["maximum_interturn_gap_days"] * 86_400 for r in threads.gaps(df, "t", "at", "id").collect()}
    assert abs(got["a"] - 9_510) < 1e-6 and got["b"] == 0.0 and "c" not in got


def test_predictions_and_weak_labels(spark):
    df = spark.createDataFrame([(1, [(2.0, "x"), (1.9, "y")]), (2, [(9.0, "x"), (0.0, "y")]), (3, []), (4, None), (5, [(1.0, "z")])], "i int, s array<struct<score: double, label: string>>")
    got = {r["i"]: r["p"] for r in df.select("i", labelling.predictions(F.col("s")).alias("p")).collect()}
    assert got[1]["label"] == "x" and got[1]["secondary"] == "y" and abs(got[1]["ambiguity"] - (1 - (got[1]["confidence"] * 2 - 1))) < 1e-12
    assert got[2]["secondary"] is None and got[3] is None and got[4] is None and got[5]["secondary"] is None and got[5]["confidence"] == 1.0
    w = spark.createDataFrame([("a", ["x"], 0.9, 0.1), ("b", ["y"], 0.9, 0.1), ("c", [], 0.9, 0.85), ("d", ["x", "y"], 0.9, 0.1)], "k string, labels array<string>, x double, y double")
    s = F.array(F.struct(F.col("x").alias("score"), F.lit("x").alias("label")), F.struct(F.col("y").alias("score"), F.lit("y").alias("label")))
    got = {r["k"]: r for r in labelling.weak_labels(w, "k", s).collect()}
    assert [(got[k]["predicted"], round(got[k]["confidence"], 6), got[k]["status"]) for k in "abcd"] == [("x", 0.92, "accepted"), ("y", 0.82, "accepted"), ("x", 0.75, "quarantine"), ("x", 0.84, "accepted")]
    assert [r["k"] for r in labelling.review_queue(labelling.weak_labels(w, "k", s), "k", 2).collect()] == ["c", "b"]


def test_search_drops_equal_responses(spark):
    pairs = spark.createDataFrame([("1", "a b", "Same  reply", "en"), ("1", "zz", "other", "en"), ("2", "a b", "same reply", "en"), ("3", "a c", "third", "en"), ("4", None, "x", "en"), ("5", "a b", None, "en"), ("6", "a b", "fr", "fr")], "t string, q string, r string, language string")
    embed = lambda c: vectors.hashed_vector(F.split(c, " "))
    index = retrieval.build_index(pairs, "t", ["q"], "q", "r", embed, "en")
    assert {r["t"] for r in index.collect()} == {"1", "2", "3"}
    q = spark.createDataFrame([("x", "a b"), ("y", "nothing")], "query_id string, q string").select("query_id", embed(F.col("q")).alias("v"))
    got = [(r["query_id"], r["t"], r["rank"]) for r in retrieval.search(q, index, "t", 2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [("x", "1", 1), ("x", "3", 2)]
    assert retrieval.diagnostics(q, retrieval.search(q, index, "t", 2)).first()["queries"] == 2


def test_small_functions(spark):
    df = spark.createDataFrame([(7, 0.125, "a_b", "so! ok")], "n int, p double, s string, t string")
    r = df.select(text.zero_padded(F.col("n"), 3), text.percent(F.col("p"), 1), text.titled(F.col("s")), text.has_style(F.col("t"), ["!", "x{3}"]), vectors.row_mean(F.col("n"), F.col("p")), text.digits(F.lit("a1b2")), text.first_id(F.lit("4,5")), text.evidence_block(F.array(F.lit("a"), F.lit("b"))), vectors.clamp01(F.lit(3.0)), text.iso_time(F.lit("2024-01-01 00:00:00").cast("timestamp"))).first()
    assert tuple(r) == ("007", "12.5%", "A B", True, 3.5625, "12", "4", "a\n\nb", 1.0, "2024-01-01T00:00:00Z")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", i) for i in range(70)] + [("dev", i) for i in range(7)], "split string, i int")
    writers.write_partitioned(df, str(tmp_path / "p"), "split")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 77
    random_rows = spark.range(100).where(F.rand() < 0.5)  # another table in each evaluation
    assert writers.write_atomic(random_rows, str(tmp_path / "a")) == spark.read.parquet(str(tmp_path / "a")).count()
    assert writers.write_atomic(df, str(tmp_path / "a")) == 77
    writers.append_done(df.limit(1).select("i"), str(tmp_path / "done"))
    assert writers.resume(df.where("split = 'dev'"), str(tmp_path / "done"), "i").count() >= 6
    writers.write_json(df.limit(2), str(tmp_path / "r.json"))
    (tmp_path / "x.bin").write_bytes(b"version https://git-lfs.github.com/spec/v1\noid")
    files = readers.read_files(spark, str(tmp_path), "x.bin")
    m = files.select(F.lit("x.bin").alias("path"), "size_bytes", "sha256")
    assert [r["problem"] for r in readers.verify_manifest(files, m, str(tmp_path)).collect()] == ["a pointer, not the file"]
