"""Evaluation measures as aggregates: one pass over the rows, then tables of the size of the label set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import ranged_running


def distribution(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """count, min, exact quantiles by linear interpolation, mean and max of the non-null values.

    Values are counted before the shuffle and ranked by ranges of (group, value), so that no task holds a group. Groups
    without values have a count of 0 and nulls.
    """
    by = by or []
    v = df.select(*by, F.col(value).cast("double").alias("_v"))
    base = v.groupBy(*by).agg(F.count("_v").alias("count"), F.min("_v").alias("min"), F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    counts = v.where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    run = ranged_running(counts, by, ["_v"], F.col("_c"), "_upto")
    sizes = base.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("count").alias("_n"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.lit(True))
    j = run.join(sizes, same) if by else run.crossJoin(F.broadcast(sizes))  # one row a group
    spot = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    at = lambda q, end: F.min(F.when(F.col("_upto") > end(spot(q)), F.col("_v")))
    found = j.groupBy(*by).agg(*[at(q, end).alias(f"_{k}{i}") for i, q in enumerate(quantiles.values()) for k, end in (("l", F.floor), ("h", F.ceil))], F.first("_n").alias("_n"))
    part = lambda q: spot(q) - F.floor(spot(q))
    found = found.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(q)).alias(n) for i, (n, q) in enumerate(quantiles.items())])
    out = base.join(found, same, "left") if by else base.crossJoin(F.broadcast(found)) if quantiles else base
    return out.select(*by, "count", "min", *quantiles, "mean", "max")


def score_histogram(df: DataFrame, value: str, low: int, high: int, by: str) -> DataFrame:
    """(by, score, n) over the whole range low..high, zeros included."""
    grid = df.select(by).distinct().withColumn("score", F.explode(F.sequence(F.lit(low), F.lit(high))))
    n = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("int").alias("score")).agg(F.count("*").alias("n"))
    return grid.join(n, [by, "score"], "left").select(by, "score", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, labels: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the grid of labels (label), zeros included."""
    grid = labels.select(F.col("label").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(df: DataFrame, labels: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label, 0 where a denominator is 0."""
    a = df.groupBy(F.col(actual).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(actual) == F.col(predicted)).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    j = labels.select("label").join(a, "label", "left").join(p, "label", "left").na.fill(0, ["support", "tp", "said"])
    j = j.withColumn("precision", _rate(F.col("tp"), F.col("said"))).withColumn("recall", _rate(F.col("tp"), F.col("support")))
    return j.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def overall_scores(df: DataFrame, labels: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, macro means over all labels, also those without support, and F1 weighted by support."""
    c = class_scores(df, labels, actual, predicted)
    m = c.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), _rate(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    n = df.agg(_rate(F.count_if(F.col(actual) == F.col(predicted)), F.count("*")).alias("accuracy"), F.count("*").alias("rows"))
    return n.crossJoin(m)


def binary_scores(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Counts and rates of a yes/no decision; false negatives are the false auto-handles of a routing decision."""
    c = df.agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn")
    )
    p, r = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", _rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), p.alias("precision"), r.alias("recall"), _rate(2 * p * r, p + r).alias("f1"), _rate(F.col("fn"), F.col("tp") + F.col("fn")).alias("miss_rate"))


def threshold_sweep(df: DataFrame, thresholds: list[float], confidence: str, correct: Column) -> DataFrame:
    """(threshold, covered, coverage, accuracy) with a null accuracy where nothing is covered; one pass."""
    t = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), (F.col(confidence) >= float(x)).alias("hit")) for x in thresholds])).alias("s")
    s = df.select(t, correct.alias("ok")).groupBy("s.threshold").agg(F.count_if("s.hit").alias("covered"), F.count("*").alias("n"), F.count_if(F.col("s.hit") & F.col("ok")).alias("right"))
    return s.select("threshold", "covered", _rate(F.col("covered"), F.col("n")).alias("coverage"), F.try_divide(F.col("right").cast("double"), F.col("covered").cast("double")).alias("accuracy"))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r as an aggregate; null for fewer than `least` pairs or a constant side (corr() would raise there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count_if(both) >= least, r)


def _margin(grid: DataFrame, by: list[str], score: str, names: tuple[str, str, str]) -> DataFrame:
    """(by, score, rows, average rank) of one rater from the grid of score pairs: as many rows a group as scores."""
    m = grid.groupBy(*by, F.col(score).alias(names[0])).agg(F.sum("n").alias(names[1]))
    before = Window.partitionBy(*by).orderBy(names[0]).rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn(names[2], F.coalesce(F.sum(names[1]).over(before), F.lit(0)) + (F.col(names[1]) + 1) / 2)


def _grid_correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r of two columns of a grid with n rows a cell; null for few rows or a constant side."""
    n, mean = F.sum("n"), lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    cov = F.sum(F.col("n") * F.col(x) * F.col(y)) / n - mean(x) * mean(y)
    var = lambda c: F.sum(F.col("n") * F.col(c) * F.col(c)) / n - mean(c) * mean(c)
    some = (n >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(some, cov / F.sqrt(var(x) * var(y)))


def agreement(df: DataFrame, a: str, b: str, by: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Agreement of two ordinal raters per group: shares, bias, error, linear and quadratic weighted kappa, correlations.

    All of it comes from the grid of score pairs, at most (high - low + 1) squared rows a group, which is counted
    before the shuffle. Kappa is 1 - sum(weight * observed) / sum(weight * expected).
    """
    d = df.where(F.col(a).between(low, high) & F.col(b).between(low, high)).select(*by, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    grid = d.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    ma, mb = _margin(grid, by, "x", ("x", "ca", "rx")), _margin(grid, by, "y", ("y", "cb", "ry"))
    g = grid.join(ma, [*by, "x"]).join(mb, [*by, "y"]).withColumn("diff", F.col("y") - F.col("x"))
    rows = F.sum("n")
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    mean = lambda c: F.sum(F.col("n") * c) / rows
    base = g.groupBy(*by).agg(
        rows.alias("n"), (share(F.col("diff") == 0) / rows).alias("exact"), (share(F.abs("diff") <= 1) / rows).alias("within_one"), mean(F.col("diff")).alias("bias"), mean(F.abs("diff")).alias("mae"),
        share(F.col("diff") > 0).alias("over"), share(F.col("diff") < 0).alias("under"), share(F.col("diff") == 0).alias("equal"),
        _grid_correlation("x", "y").alias("pearson"), _grid_correlation("rx", "ry").alias("spearman"),
        mean(F.abs("diff")).alias("_ol"), mean(F.col("diff") * F.col("diff")).alias("_oq"),
    )
    # expected disagreement from the two margins
    cells = ma.join(mb, by) if by else ma.crossJoin(F.broadcast(mb))
    e = cells.groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb") * F.abs(F.col("x") - F.col("y"))).alias("_el"), F.sum(F.col("ca") * F.col("cb") * F.pow(F.col("x") - F.col("y"), 2)).alias("_eq"))
    j = base.join(e, by) if by else base.crossJoin(e)
    k = lambda o, x: 1 - F.try_divide(F.col(o) * F.col("n") * F.col("n"), F.col(x))
    return j.select(*base.columns[:-2], k("_ol", "_el").alias("kappa_linear"), k("_oq", "_eq").alias("kappa_quadratic"))


def score_summary(df: DataFrame, value: str, low: int, high: int, by: str) -> DataFrame:
    """(by, n, mean, median, std, counts) of whole scores low..high: from a grid of at most high - low + 1 rows a group.

    std is that of a sample, 0 for one score; counts are those of all scores in order, zeros included.
    """
    grid = score_histogram(df, value, low, high, by)
    upto = Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("score")))
    mean = F.try_divide(F.sum(F.col("n") * F.col("score")), F.sum("n"))
    square = F.sum(F.col("n") * F.col("score") * F.col("score")) - F.try_divide(F.pow(F.sum(F.col("n") * F.col("score")), F.lit(2)), F.sum("n"))
    return g.groupBy(by).agg(
        F.sum("n").alias("n"), mean.alias("mean"), ((at(F.floor((F.col("all") - 1) / 2)) + at(F.ceil((F.col("all") - 1) / 2))) / 2).alias("median"),
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.lit(0.0), square / (F.sum("n") - 1)))).when(F.sum("n") == 1, 0.0).alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("score", "n"))), lambda x: x["n"]).alias("counts"),
    )


def sweep_scores(df: DataFrame, labels: DataFrame, thresholds: list[float], confidence: str, actual: str, predicted: str) -> DataFrame:
    """(threshold, covered, coverage, accuracy, macro_f1) of the rows of at least that confidence, over all labels; null
    scores where nothing is covered. One pass that counts (threshold, actual, predicted) before the shuffle."""
    t = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), (F.col(confidence) >= float(x)).alias("hit")) for x in thresholds])).alias("s")
    cells = df.select(t, F.col(actual).alias("a"), F.col(predicted).alias("p")).groupBy("s.threshold", "a", "p").agg(F.count("*").alias("n"), F.count_if("s.hit").alias("c"))
    sums = cells.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("c").alias("covered"), F.sum(F.when(F.col("a") == F.col("p"), F.col("c")).otherwise(0)).alias("right"))
    side = lambda c, out: cells.groupBy("threshold", F.col(c).alias("label")).agg(F.sum("c").alias(out))
    hits = cells.where("a = p").select("threshold", F.col("a").alias("label"), F.col("c").alias("tp"))
    grid = sums.select("threshold").crossJoin(F.broadcast(labels.select("label")))  # thresholds by labels
    j = grid.join(side("a", "support"), ["threshold", "label"], "left").join(side("p", "said"), ["threshold", "label"], "left").join(hits, ["threshold", "label"], "left").na.fill(0, ["support", "said", "tp"])
    f1 = j.groupBy("threshold").agg(F.avg(_rate(2 * F.col("tp"), F.col("support") + F.col("said"))).alias("f1"))
    some = F.col("covered") > 0
    return sums.join(f1, "threshold").select("threshold", "covered", _rate(F.col("covered"), F.col("n")).alias("coverage"), F.when(some, F.col("right") / F.col("covered")).alias("accuracy"), F.when(some, F.col("f1")).alias("macro_f1"))


def most_frequent(df: DataFrame, label: str, position: str) -> DataFrame:
    """The most frequent label; ties go to the one that occurs first."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first").limit(1)
