"""Vector functions on array columns and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import workers_import


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if a side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    return _let(v, lambda x: _let(F.greatest(F.sqrt(dot(x, x)), F.lit(floor)), lambda n: F.transform(x, lambda e: e.cast("double") / n)))


def softmax(v: Column) -> Column:
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def top_two(scores: Column) -> Column:
    """(best, second, margin) of an array of structs (score, label), null where there are fewer; of equal scores the smaller label comes first."""
    s = F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    best, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    return F.struct(best.alias("best"), second.alias("second"), (best["score"] - second["score"]).alias("margin"))


def row_mean(*cols: Column) -> Column:
    """Mean of several columns of a row; null if one of them is."""
    total = cols[0].cast("double")
    for c in cols[1:]:
        total = total + c.cast("double")
    return total / len(cols)


def hashed_vector(words: Column, size: int = 64) -> Column:
    """A vector of length 1 that counts words in places by the first two digits of their md5; null for no words.

    A stand-in for an embedding model that any engine can repeat; size is at most 256.
    """
    digit = lambda w, i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(w), i, 1)) - 1
    places = F.transform(words, lambda w: F.pmod(16 * digit(w, 1) + digit(w, 2), F.lit(size)))
    counts = _let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double")))
    return F.when(F.size(words) > 0, l2_normalize(counts))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "query_id", c_id: str = "corpus_id", vector: str = "v", block: int = 4096, key: str | None = None, predicate: str | None = None, corpus_block: int = 50_000) -> DataFrame:
    """(q_id, c_id, score, rank): the k corpus rows of the largest dot product for every query; ties by the smaller c_id.

    With `key`, a column of the corpus, only the best row of each key counts for a query, so k different keys come
    out; a null key is a key of its own. With `predicate`, a column of both sides, a query takes only rows of its own
    value; a null or empty value on either side fits all.

    The queries are a stated set. Blocks of about `block` queries meet blocks of about `corpus_block` rows on the
    executors, each as a matrix product that keeps k rows a query, so that the shuffle carries k rows a query and block,
    not all pairs. Exact for every query. Null and empty vectors and those of another length match nothing.
    """
    spark = corpus.sparkSession
    workers_import(spark)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")
    some = "v is not null and size(v) > 0"
    q = queries.select(F.col(q_id).alias("q"), F.col(vector).alias("v"), text(predicate).alias("p")).where(some)
    group = F.col(key).cast("string") if key else F.lit(None).cast("string")
    c = corpus.select(F.col(c_id).alias("c"), F.col(vector).alias("v"), group.alias("g"), text(predicate).alias("p")).where(some)
    qn, cn = max(1, -(-q.count() // block)), max(1, -(-c.count() // corpus_block))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    left = q.select("*", place("q", qn, 1).alias("qb")).select("*", copies(cn).alias("cb"))
    right = c.select("*", place("c", cn, 2).alias("cb")).select("*", copies(qn).alias("qb"))
    has_key, has_predicate = key is not None, predicate is not None

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width in set(a["v"].map(len)) & set(b["v"].map(len)):
            x, y = a[a["v"].map(len) == width], b[b["v"].map(len) == width].sort_values("c", kind="stable")
            m, ids = np.vstack(y["v"].to_list()).astype(np.float64), y["c"].to_numpy()
            keys, has = y["g"].to_numpy(dtype=object), y["p"].to_numpy(dtype=object)
            codes = pd.factorize(keys, use_na_sentinel=False)[0]
            for begin in range(0, len(x), 256):
                part = x.iloc[begin : begin + 256]
                scores = np.vstack(part["v"].to_list()).astype(np.float64) @ m.T
                for name, wanted, row in zip(part["q"], part["p"], scores, strict=True):
                    if not (has_key or has_predicate) and len(row) > 4 * k:
                        edge = np.partition(row, len(row) - k)[len(row) - k]
                        best = np.flatnonzero(row >= edge)
                        best = best[np.argsort(-row[best], kind="stable")][:k]
                    else:
                        best = np.argsort(-row, kind="stable")
                        if has_predicate and wanted != "":
                            best = best[(has[best] == wanted) | (has[best] == "")]
                        if has_key:  # the first use of a key is its best row
                            best = best[np.sort(np.unique(codes[best], return_index=True)[1])]
                        best = best[:k]
                    out.append((np.array([name] * len(best), dtype=object), ids[best].astype(object), row[best], keys[best]))
        none = np.zeros(0, dtype=object)
        q, c, score, g = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, np.zeros(0), none)
        # objects, as text of pandas' own kind comes in chunks that the transfer can't take
        return pd.DataFrame({"q": pd.Series(q, dtype=object), "c": pd.Series(c, dtype=object), "score": score, "g": pd.Series(g, dtype=object)})

    kinds = dict(corpus.dtypes)[c_id], dict(queries.dtypes)[q_id]
    out = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, f"q {kinds[1]}, c {kinds[0]}, score double, g string")
    if has_key:
        out = out.withColumn("of_key", F.row_number().over(Window.partitionBy("q", "g").orderBy(F.col("score").desc(), "c"))).where("of_key = 1")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(q_id), F.col("c").alias(c_id), "score", "rank")
