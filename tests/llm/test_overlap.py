import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import overlap


def vectors(n, vocabulary, seed):
    """Random sparse vectors of length 1 over skewed terms, some of them near copies of others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            terms = [t for t in rng.choice(out)[1] if rng.random() > 0.1] or [1]
        else:
            terms = sorted({int(vocabulary * rng.random() ** 3) - vocabulary // 2 for _ in range(rng.randint(1, 12))})
        w = np.array([1.0 + abs(t) % 7 for t in terms])
        out.append((i, terms, (w / np.sqrt(w @ w)).tolist()))
    return out


@pytest.mark.parametrize(("least", "block"), [(0.8, 40_000), (0.6, 7), (0.95, 1)])
def test_weighted_join_against_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(overlap, "EVAL_BLOCK", block)
    monkeypatch.setattr(overlap, "TRAIN_BLOCK", block + 2)
    left, right = vectors(120, 40, 1), vectors(150, 40, 2)
    right[3:6] = [(i, left[i][1], left[i][2]) for i in (3, 4, 5)]
    want = {}
    for i, a, x in left:
        for j, b, y in right:
            dot = math.fsum(x[a.index(t)] * y[b.index(t)] for t in set(a) & set(b))
            if dot >= least - 1e-9:
                want[i, j] = (len(set(a) & set(b)), len(a), len(b), dot)
    schema = "id bigint, terms array<bigint>, weights array<double>"
    got = overlap.cosine_join(spark.createDataFrame(left, schema), spark.createDataFrame([*right, (999, [], [])], schema), least).collect()
    assert len(got) == len(want) > 20
    for r in got:
        s, n, m, dot = want[r["l"], r["r"]]
        assert (r["shared"], r["l_terms"], r["r_terms"]) == (s, n, m) and abs(r["cosine"] - dot) < 1e-9


def test_each_use_of_a_word_is_a_term(spark):
    df = spark.createDataFrame([(1, [5, 5, 7]), (2, [5, 7, 7]), (3, [])], "id bigint, words array<bigint>")
    got = {r["id"]: r for r in overlap.unit_vectors(df).collect()}
    assert len(set(got[1]["terms"])) == 3 and len(set(got[1]["terms"]) & set(got[2]["terms"])) == 2
    assert got[3]["terms"] == [] and abs(sum(w * w for w in got[1]["weights"]) - 1) < 1e-12


def test_words_of_ascii_and_other_texts(spark):
    texts = ["It's @Acme's #tag &amp; HTTP://x.y/z ok-Fine 2nd", "It’s ＠Acme &#39; www.x.y naïve　Größe", "plain", None, "", "?!", "l" * 60_000 + " b"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(overlap.words(F.col("text"))).collect()]
    assert got == [["its", "s", "ok", "fine", "2nd"], ["its", "naïve", "größe"], ["plain"], [], [], [], ["l" * 60_000, "b"]]
