"""Labels from rules and similarities: weak labels with a confidence, silver sets, predictions with their ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rule_labels, word_count
from ..functions.vectors import softmax, top_two
from .sampling import first_per_label_then_fill, sample_per_stratum


def predictions(scores: Column, gap: float = 0.18) -> Column:
    """(label, confidence, secondary, ambiguity, probabilities) from an array of raw scores (score, label).

    Probabilities are the softmax of the scores. The second label counts where the first leads by less than `gap`;
    ambiguity is 1 less that lead, at least 0. One score has no second label; null and empty arrays give nulls.
    """
    p = F.arrays_zip(softmax(F.transform(scores, lambda x: x["score"].cast("double"))).alias("score"), F.transform(scores, lambda x: x["label"]).alias("label"))
    some = F.when(F.size(scores) > 0, F.transform(p, lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label"))))

    def told(q: Column) -> Column:
        t = top_two(q)
        lead = t["best"]["score"] - F.coalesce(t["second"]["score"], F.lit(0.0))
        return F.struct(
            t["best"]["label"].alias("label"), t["best"]["score"].alias("confidence"), F.when(lead < gap, t["second"]["label"]).alias("secondary"),
            F.greatest(F.lit(0.0), 1 - lead).alias("ambiguity"), q.alias("probabilities"),
        )

    return F.transform(F.array(some), lambda q: F.when(q.isNotNull(), told(q)))[0]


def rule_candidates(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]], per_label: int, seed: int) -> DataFrame:
    """(key, text, labels): up to `per_label` rows of each rule by hash, each row once, with all rules that it matches."""
    labelled = rows.select(F.col(key), F.col(text), rule_labels(F.col(text), rules).alias("labels"))
    tall = labelled.select("*", F.explode("labels").alias("_rule"))
    return sample_per_stratum(tall, key, "_rule", per_label, seed).drop("_rule").dropDuplicates([key])


def weak_labels(candidates: DataFrame, key: str, scores: Column, minimum: float = 0.8) -> DataFrame:
    """(key, predicted, confidence, margin, method, priority, status) from candidates with `labels` and similarities.

    A single rule decides, else the most similar label. Confidence: .92 where both agree, .82 for a rule alone, else
    .7 and the margin between the two most similar labels, .84 at most. Rows of at least `minimum` are accepted, the
    others go to quarantine. priority orders the review: unclear rules first, then rules that similarity contradicts.
    """
    t = candidates.withColumn("_t", top_two(scores)).withColumn("_rule", F.when(F.size("labels") == 1, F.col("labels")[0]))
    near, margin = F.col("_t.best.label"), F.coalesce(F.col("_t.margin"), F.lit(0.0))
    agreed = F.coalesce(F.col("_rule") == near, F.lit(False))
    confidence = F.when(agreed, 0.92).when(F.col("_rule").isNotNull(), 0.82).otherwise(F.least(F.lit(0.84), 0.70 + F.greatest(F.lit(0.0), margin)))
    out = t.select(
        key, F.coalesce("_rule", near).alias("predicted"), confidence.alias("confidence"), margin.alias("margin"), F.when(agreed, "rule_plus_embedding").otherwise("rule_or_embedding").alias("method"),
        F.when(F.col("_rule").isNull(), 0.0).when(agreed, 1.0).otherwise(0.2).alias("priority"),
    )
    return out.withColumn("status", F.when(F.col("confidence") >= minimum, "accepted").otherwise("quarantine"))


def review_queue(weak: DataFrame, key: str, n: int) -> DataFrame:
    """n weak labels to review: the first of every label by priority and key, then the next in that order."""
    return first_per_label_then_fill(weak, key, "predicted", "priority", n)


def silver_set(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]], general: str, per_label: int, seed: int, most_words: int = 6) -> DataFrame:
    """(key, label): rows of exactly one rule, and texts of at most `most_words` words that match none as `general`;
    up to `per_label` rows a label by hash. Null and blank texts are left out."""
    labels = rule_labels(F.col(text), rules)
    label = F.when(F.size(labels) == 1, labels[0]).when((F.size(labels) == 0) & word_count(F.col(text)).between(1, most_words), general)
    return sample_per_stratum(rows.select(F.col(key), label.alias("label")).where("label is not null"), key, "label", per_label, seed)
