"""Fitted models: a linear text classifier, topics by non-negative factors, and the constant baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, workers_import
from . import tfidf


def fit_text_classifier(rows: DataFrame, text: str, label: str, features: int = 1 << 15, max_iter: int = 50, reg: float = 1e-3):  # noqa: ANN201
    """A class-balanced multinomial logistic regression on hashed words and pairs of words.

    Gives predict(df, text, out), which adds the label. Labels are indexed by frequency, ties by name. Rows without
    a label are left out.
    """
    data = rows.where(F.col(label).isNotNull()).select(tfidf.word_terms(F.col(text)).alias("terms"), F.col(label).alias("label"))
    index = StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip").fit(data)
    counts = data.groupBy("label").count()
    n, k = data.count(), len(index.labels)
    weighted = data.join(counts, "label").withColumn("w", F.lit(float(n)) / (k * F.col("count")))
    hashed = HashingTF(inputCol="terms", outputCol="features", numFeatures=features)
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=max_iter, regParam=reg).fit(hashed.transform(index.transform(weighted)))
    names = F.array(*[F.lit(x) for x in index.labels])

    def predict(df: DataFrame, column: str, out: str = "predicted") -> DataFrame:
        scored = model.transform(hashed.transform(df.withColumn("terms", tfidf.word_terms(F.col(column)))))
        keep = [c for c in df.columns]
        return scored.select(*keep, names[F.col("prediction").cast("int")].alias(out))

    return predict


def topics(weights: DataFrame, key: str, k: int, iterations: int = 50, seed: int = 42, most_terms: int | None = None, tol: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(assignments: key, topic, strength; terms: topic, term, weight) of a non-negative factorization of (key, term, weight).

    Multiplicative updates: the factor of the terms (k rows of all terms, or of the `most_terms` most frequent ones if
    asked) is sent to the tasks; each task updates its documents' factor and sends back two partial products of that
    size, which are added up by term. Documents stay where they are; the factor has to fit in a task, so choose terms
    by min_df in `weights` first. With `tol`, updates end once ten of them have lowered the error by less than that
    share of the first one.
    """
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    if most_terms is not None:
        df = df.orderBy(F.desc("df"), "term").limit(most_terms)
    vocabulary = df.select("term").orderBy("term").toPandas()["term"].tolist()
    spark = weights.sparkSession
    workers_import(spark)
    at = spark.createDataFrame(list(enumerate(vocabulary)), "j int, term string") if vocabulary else spark.createDataFrame([], "j int, term string")
    docs = cut(weights.join(at, "term").groupBy(key).agg(F.collect_list(F.struct("j", "weight")).alias("x")))
    m = len(vocabulary)
    rng = np.random.default_rng(seed)
    h = rng.random((k, max(m, 1))) + 0.1
    length2 = float(docs.select(F.sum(F.aggregate("x", F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))).first()[0] or 0.0) if tol else 0.0
    errors: list[float] = []

    def factor(x: list, hb: np.ndarray, hht: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        j = np.array([r["j"] for r in x])
        v = np.array([r["weight"] for r in x])
        w = np.full(hb.shape[0], 1.0 / hb.shape[0])
        top = hb[:, j] @ v
        for _ in range(30):
            w *= top / np.maximum(hht @ w, 1e-12)
        return j, v, w

    kind = dict(docs.dtypes)[key]
    for _ in range(iterations if m else 0):
        shared = spark.sparkContext.broadcast((h, h @ h.T))

        def partial(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            hb, hht = shared.value
            num, wtw, any_rows = np.zeros_like(hb), np.zeros((hb.shape[0], hb.shape[0])), False
            for pdf in parts:
                for x in pdf["x"]:
                    j, v, w = factor(x, hb, hht)
                    np.add.at(num.T, j, np.outer(v, w))
                    wtw += np.outer(w, w)
                    any_rows = True
            if any_rows:
                yield pd.DataFrame({"r": range(hb.shape[0]), "num": list(num), "wtw": list(wtw)})

        # one row a topic and task, added up before it reaches the driver
        parts = docs.select("x").mapInPandas(partial, "r int, num array<double>, wtw array<double>")
        total = parts.groupBy("r").applyInPandas(lambda p: pd.DataFrame({"r": [p["r"].iloc[0]], "num": [np.sum(p["num"].to_list(), axis=0)], "wtw": [np.sum(p["wtw"].to_list(), axis=0)]}), "r int, num array<double>, wtw array<double>").orderBy("r").toPandas()
        num, wtw = np.vstack(total["num"].to_list()), np.vstack(total["wtw"].to_list())
        errors.append(np.sqrt(max(0.0, length2 - 2 * float((num * h).sum()) + float((wtw * (h @ h.T)).sum()))))
        h *= num / np.maximum(wtw @ h, 1e-12)
        shared.unpersist()
        if tol and len(errors) % 10 == 1 and len(errors) > 1 and errors[-11] - errors[-1] < tol * errors[0]:
            break
    last = spark.sparkContext.broadcast((h, h @ h.T))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hb, hht = last.value
        for pdf in parts:
            ws = [factor(x, hb, hht)[2] for x in pdf["x"]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "topic": [int(w.argmax()) for w in ws], "strength": [float(w.max()) for w in ws]})

    found = docs.mapInPandas(assign, f"`{key}` {kind}, topic int, strength double")
    rows = [(int(t), vocabulary[j], float(h[t, j])) for t in range(k) for j in np.argsort(-h[t])[:12] if m]
    return found, spark.createDataFrame(rows, "topic int, term string, weight double")
