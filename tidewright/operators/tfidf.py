"""TF-IDF on DataFrames: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of length 1.

Terms are counted over all documents; scores come from inverted lists, so that pairs that share no term never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, workers_import


def word_terms(text: Column, bigrams: bool = True, stop: list[str] | None = None) -> Column:
    """Small-letter words of two letters or digits or more and, if asked, pairs of neighbours."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)
    if stop:
        w = F.filter(w, lambda x: ~x.isin(stop))
    if not bigrams:
        return w
    two = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, two)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of blank-padded words; a padded word shorter than n is one term for each n it falls short of."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")

    def pieces(p: Column, n: int) -> Column:
        whole = F.array(p) if n == low else F.when(F.length(p) == n, F.array(p)).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(p) > n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - n + 1)), lambda i: p.substr(i, F.lit(n)))).otherwise(whole)

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[pieces(padded, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def weights(docs: DataFrame, key: str, terms: Column, min_df: int = 1, max_df: float = 1.0, sublinear: bool = True) -> DataFrame:
    """(key, term, weight). Terms of fewer than min_df documents or of more than the share max_df are left out.

    Null texts and texts without terms have no rows. n counts all rows of docs.
    """
    n = docs.count()
    tf = docs.select(F.col(key), F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    t = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = tf.join(df, "term").select(key, "term", (t * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_terms(w: DataFrame, key: str, k: int) -> DataFrame:
    """The k heaviest terms of each key, ties by term."""
    win = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    return w.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def similar_pairs(w: DataFrame, key: str, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of left < right with a cosine of at least threshold, by inverted lists.

    A vector enters the lists only with those terms, from frequent to rare left out, without which it could still
    reach the threshold: the norm of what is left out stays below it. Sums are taken over all common terms of the
    pairs that meet.
    """
    df = w.groupBy("term").agg(F.count("*").alias("df"))
    ranked = w.join(df, "term").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key).orderBy(F.desc("df"), "term")))
    first = ranked.where(F.sqrt("rest") >= threshold - 1e-9).select(key, "term")
    a = first.select(F.col(key).alias("left_id"), "term")
    b = w.select(F.col(key).alias("right_id"), "term")
    met = a.join(b, "term").where("left_id <> right_id").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    x = w.select(F.col(key).alias("left_id"), "term", F.col("weight").alias("wa"))
    y = w.select(F.col(key).alias("right_id"), "term", F.col("weight").alias("wb"))
    s = met.join(x, "left_id").join(y, ["right_id", "term"]).groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return s.where(F.col("similarity") >= threshold)


def close_pairs(docs: DataFrame, key: str, terms: Column, threshold: float, sublinear: bool = False, block: int = 4096, dense: int = 2048) -> DataFrame:
    """(a, b, similarity): every pair of different keys with a cosine of at least threshold > 0, each pair once.

    For terms that most texts share, as pieces of words, where inverted lists would let nearly all pairs meet. Texts
    become vectors of term numbers; blocks of `block` vectors are sent to the tasks, and each scans the blocks from its
    own on: the `dense` most frequent terms as a matrix product, the others by the block's inverted lists. What comes
    within 0.001 of the threshold is worked out again in double precision. Keys are unique; texts without terms have
    no pairs. The driver holds the vocabulary of terms of two texts or more, and one block at a time.
    """
    spark = docs.sparkSession
    workers_import(spark)
    n = docs.count()
    rows = docs.select(F.col(key).alias("k"), terms.alias("terms"))
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = df.where("df > 1").orderBy(F.desc("df"), "term").toPandas()
    # terms of one text count in its length only; they all have the same weight
    single = np.log((1.0 + n) / 2.0) + 1.0
    idf = np.log((1.0 + n) / (1.0 + known["df"].to_numpy(dtype=float))) + 1.0
    shared = spark.sparkContext.broadcast((dict(zip(known["term"], range(len(known)), strict=True)), idf))

    def vectorize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, weight = shared.value
        for pdf in parts:
            js, xs = [], []
            for ts in pdf["terms"]:
                tf: dict[str, int] = {}
                for t in ts:
                    tf[t] = tf.get(t, 0) + 1
                scale = (lambda c: 1.0 + np.log(c)) if sublinear else (lambda c: c)
                alone = sum((scale(c) * single) ** 2 for t, c in tf.items() if t not in number)
                pairs = sorted((number[t], float(scale(c))) for t, c in tf.items() if t in number)
                j = np.array([p[0] for p in pairs], dtype=np.int32)
                x = np.array([p[1] for p in pairs]) * weight[j]
                js.append(j)
                xs.append(x / np.sqrt(max(alone + float(x @ x), 1e-300)))
            yield pd.DataFrame({"k": pdf["k"].to_numpy(), "b": pdf["b"].to_numpy(), "j": js, "x": xs})

    kind = dict(docs.dtypes)[key]
    blocks = max(1, -(-n // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    vectors = cut(rows.mapInPandas(vectorize, f"k {kind}, b int, j array<int>, x array<double>").where("size(j) > 0"))
    width, out = min(dense, len(known)), None

    def matrix(js: list, xs: list) -> np.ndarray:
        m = np.zeros((len(js), width), np.float32)
        for i, (j, x) in enumerate(zip(js, xs, strict=True)):
            c = int(np.searchsorted(j, width))
            m[i, j[:c]] = x[:c]
        return m

    for at in range(blocks):
        part = vectors.where(F.col("b") == at).toPandas()
        if part.empty:
            continue
        sent = spark.sparkContext.broadcast((part["k"].tolist(), [np.asarray(j) for j in part["j"]], [np.asarray(x) for x in part["x"]]))

        def scan(batches: Iterator[pd.DataFrame], sent=sent, at=at) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ks, js, xs = sent.value
            m = matrix(js, xs)
            rare = [int(np.searchsorted(j, width)) for j in js]
            term = np.concatenate([j[c:] for j, c in zip(js, rare, strict=True)])
            order = np.argsort(term, kind="stable")
            term = term[order]
            doc = np.repeat(np.arange(len(js)), [len(j) - c for j, c in zip(js, rare, strict=True)])[order]
            value = np.concatenate([x[c:] for x, c in zip(xs, rare, strict=True)])[order]
            for pdf in batches:
                for begin in range(0, len(pdf), 512):
                    piece = pdf.iloc[begin : begin + 512]
                    scores = matrix(piece["j"], piece["x"]) @ m.T
                    found = []
                    for i, (k, b, j, x) in enumerate(zip(piece["k"], piece["b"], piece["j"], piece["x"], strict=True)):
                        c = int(np.searchsorted(j, width))
                        lo, hi = np.searchsorted(term, j[c:]), np.searchsorted(term, j[c:], side="right")
                        size = hi - lo
                        spots = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                        s = scores[i] + np.bincount(doc[spots], value[spots] * np.repeat(x[c:], size), len(js))
                        for r in np.flatnonzero(s >= threshold - 1e-3):
                            if b == at and not ks[r] < k:
                                continue  # within the block each pair meets twice
                            _, p, q = np.intersect1d(js[r], j, assume_unique=True, return_indices=True)
                            exact = float(xs[r][p] @ x[q])
                            if exact >= threshold - 1e-12:
                                found.append((ks[r], k, exact))
                    if found:
                        yield pd.DataFrame(found, columns=["a", "b", "similarity"])

        r = vectors.where(F.col("b") >= at).mapInPandas(scan, f"a {kind}, b {kind}, similarity double")
        out = r if out is None else out.unionByName(r)
    return out if out is not None else spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")


def nearest_by_terms(queries: DataFrame, corpus: DataFrame, q_key: str, c_key: str, k: int = 1) -> DataFrame:
    """(q_key, c_key, similarity, rank) of the best corpus rows for each query by common terms, ties by the smaller id."""
    s = queries.select(F.col(q_key), "term", F.col("weight").alias("wa")).join(corpus.select(F.col(c_key), "term", F.col("weight").alias("wb")), "term").groupBy(q_key, c_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    win = Window.partitionBy(q_key).orderBy(F.desc(F.round("similarity", 9)), c_key)
    return s.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)
