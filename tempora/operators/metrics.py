"""Class weights and evaluation of predictions ``(subject_id, fold, target, proba)``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def class_counts(df: DataFrame, label: str = "target") -> DataFrame:
    """``(label, n)``; a table of one class only is an error when it is read."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    classes = counts.agg(F.count("*").alias("_classes"))
    checked = F.when(F.col("_classes") < 2, F.raise_error(F.lit("weights need at least two classes")).cast("bigint")).otherwise(F.col("n"))
    return counts.crossJoin(F.broadcast(classes)).select(label, checked.alias("n"))  # one row


def weights_inverse_sqrt(df: DataFrame, label: str = "target") -> DataFrame:
    """Weight per class: one over the root of its count."""
    return class_counts(df, label).withColumn("weight", 1 / F.sqrt("n"))


def weights_effective_n(df: DataFrame, label: str = "target") -> DataFrame:
    """Share of the effective number of a class, over its count."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n").alias("total"))
    beta = (F.col("total") - 1) / F.col("total")
    effective = (1 - F.pow(beta, F.col("n"))) / (1 - beta)
    counts = counts.crossJoin(F.broadcast(total)).withColumn("effective", effective)  # one row
    whole = counts.agg(F.sum("effective").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("effective") / F.col("whole") / F.col("n")).alias("weight"))


def pos_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Both weights of the positive class in one row: root of neg/pos, and by effective numbers."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    both = lambda n, other: F.when((n == 0) | (other == 0), F.raise_error(F.lit("both classes must occur")).cast("bigint")).otherwise(n)
    row = df.agg(both(n0, n1).alias("n0"), both(n1, n0).alias("n1"))
    beta = (F.col("n0") + F.col("n1") - 1) / (F.col("n0") + F.col("n1"))
    side = lambda n: (1 - beta) / (1 - F.pow(beta, n))
    return row.select(F.sqrt(F.col("n0") / F.col("n1")).alias("sqrt_weight"), (side(F.col("n1")) / side(F.col("n0"))).alias("effective_weight"))


def confusion(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    hit, true = F.col("proba") > threshold, F.col("target") == 1
    return df.groupBy(*by).agg(
        F.count_if(~hit & ~true).alias("tn"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(hit & true).alias("tp"), F.avg("proba").alias("mean_probability"), F.avg("target").alias("pct_positive")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def closed_forms(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Scores of confusion counts by name; zero where a denominator is zero."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    n = tn + fp + fn + tp
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return {
        "accuracy": (tp + tn) / n,
        "balanced_accuracy": (recall + specificity) / 2,
        "precision_score": precision,
        "recall": recall,
        "f1": f1,
        "dice": f1,  # the same form over two sets
        "hit": (tp + tn) / n,  # the share of rows whose class is named
        "kappa": _ratio((tp + tn) / n - chance, 1 - chance),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "specificity": specificity,
        "tn": tn,
        "fp": fp,
        "fn": fn,
        "tp": tp,
    }


def scores(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Closed forms on the confusion counts; zero where a denominator is zero."""
    made = closed_forms(*map(F.col, ("tn", "fp", "fn", "tp")))
    counts = [made.pop(c).alias(c) for c in ("tn", "fp", "fn", "tp")]
    return confusion(df, by, threshold).select(*by, *counts, "mean_probability", "pct_positive", *[c.alias(k) for k, c in made.items()])


def score_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives ``p``, negatives ``q`` and rows ``n`` at every distinct score: all that metrics need."""
    return df.groupBy(*by, "proba").agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("q"), F.count("*").alias("n"))


def ranked_scores(df: DataFrame, by: list[str], buckets: int = 256) -> DataFrame:
    """Cumulative positives and negatives at every distinct score, descending.

    Scores are cut at approximate quantiles.  Sums run inside a bucket and are shifted by those of
    the buckets above, at most ``buckets`` a group, so a group's scores do not meet in one task.
    """
    counts = materialize(score_counts(df, by), "scores")  # read for the cuts, the shifts and the sums
    cuts = counts.agg(F.percentile_approx("proba", [k / buckets for k in range(1, buckets)], 10_000).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("proba")))
    rows = counts.crossJoin(F.broadcast(cuts)).select(*by, "proba", "p", "q", "n", bucket.alias("_b"))  # one row
    above, whole = Window.partitionBy(*by).orderBy(F.desc("_b")), Window.partitionBy(*by)
    shifts = rows.groupBy(*by, "_b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ahead = [(F.sum(c).over(above) - F.col(c)).alias(f"_{c}") for c in "pq"]
    shifts = shifts.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_b"]], *ahead, F.sum("p").over(whole).alias("positives"), F.sum("q").over(whole).alias("negatives"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("proba")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("p").over(inside).alias("_tp"), F.sum("q").over(inside).alias("_fp"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_b"]])
    return rows.join(shifts, same).select(*by, "proba", "p", "q", "n", (F.col("_tp") + F.col("_p")).alias("tp"), (F.col("_fp") + F.col("_q")).alias("fp"), "positives", "negatives")


def curves(df: DataFrame, by: list[str]) -> DataFrame:
    """One point per distinct threshold: true and false positive rates, precision."""
    tp, fp = F.col("tp"), F.col("fp")
    return ranked_scores(df, by).select(*by, F.col("proba").alias("threshold"), (tp / F.col("positives")).alias("tpr"), (fp / F.col("negatives")).alias("fpr"), (tp / (tp + fp)).alias("precision_score"))


def _areas() -> dict[str, Column]:
    return {
        "roc_auc": F.coalesce(F.try_divide(F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)), F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))), F.lit(0.0)),
        "average_precision": F.coalesce(F.sum(F.col("p") / F.nullif(F.col("positives"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)),
    }


def areas(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact area under the ROC curve, ties half, and average precision; 0 for a single class."""
    return ranked_scores(df, by).groupBy(*by).agg(*[c.alias(name) for name, c in _areas().items()])


def mean_std(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Long table ``(metric, mean, std)`` over folds."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")
    return df.select(rows).select("r.*").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def mean_nonzero(column: str) -> Column:
    value = F.col(column)
    return F.coalesce(F.avg(F.when((value != 0) & ~F.isnan(value.cast("double")), value)), F.lit(0.0))


def precision_at_k(df: DataFrame, k: int, row: str = "row_id") -> DataFrame:
    """Share of rows whose label is among the k best-scored classes of ``(row, class, score, label)``."""
    best = F.row_number().over(Window.partitionBy(row).orderBy(F.desc("score"), "class"))
    hit = F.max(((F.col("_n") <= k) & (F.col("class") == F.col("label"))).cast("int"))
    return df.withColumn("_n", best).groupBy(row).agg(hit.alias("hit")).agg(F.avg("hit").alias("precision_at_k"))


def metric_gate(metrics: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows that lie outside the bounds."""
    return metrics.where(~F.col(column).between(low, high))


def average_row(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """One row per fold and one more, ``fold`` null, with the mean of every metric."""
    names = [c for c in scored.columns if c != fold]
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("_all")  # each row for itself, and for all
    of = lambda c: F.col(f"`{c}`")  # noqa: E731  a column may be named after a threshold
    rows = scored.select(of(fold).cast("long").alias(fold), *[of(c).cast("double").alias(c) for c in names]).select("*", both)
    rows = rows.withColumn(fold, F.when(~F.col("_all"), of(fold)))
    return rows.groupBy("_all", fold).agg(*[F.avg(of(c)).alias(c) for c in names]).select(fold, *map(of, names))


def prediction_table(predictions: DataFrame, folds: list[int]) -> DataFrame:
    """One row per subject, one ``fold_<n>`` column per fold."""
    return predictions.groupBy("subject_id").agg(*[F.max(F.when(F.col("fold") == f, F.col("proba"))).alias(f"fold_{f}") for f in folds])


def weighted_resample(df: DataFrame, weights: DataFrame, n: int, column: str = "subject_id", label: str = "target", seed: int = 42) -> DataFrame:
    """``n`` draws of rows with replacement, each row's chance in proportion to its class weight.

    ``weights(label, n, weight)`` has a row per class, labels being small whole numbers.  Rows
    are ranked class by class, so a draw is a rank and the rows come by an equi join on it.
    """
    from .splits import exact_rank

    w = Window.orderBy(label)
    mass = F.col("n") * F.col("weight")
    classes = weights.select(label, "n", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum(mass).over(w).alias("upto"), mass.alias("mass"))
    whole = classes.agg(F.max("upto").alias("whole"), F.sort_array(F.collect_list(F.struct("upto", "before", "n"))).alias("classes"))
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64(F.col("draw"), F.lit(seed), F.lit(salt)), 11) / F.lit(float(1 << 53))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(whole))  # one row
    place = draw(1) * F.col("whole")
    drawn = draws.withColumn("at", place).withColumn("c", F.coalesce(F.get(F.filter("classes", lambda c: c["upto"] > F.col("at")), F.lit(0)), F.element_at("classes", -1)))
    drawn = drawn.select("draw", (F.col("c.before") + F.floor(draw(2) * F.col("c.n"))).alias("rank"))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 24)
    order = [F.col(label).cast("long") * (1 << 40) + hashed, F.col(column)]
    keyed = df.withColumn("_key", F.struct(column, label))
    ranked = exact_rank(keyed, "_key", order).select(F.col(f"_key.{column}").alias(column), F.col(f"_key.{label}").alias(label), "rank")
    return drawn.join(ranked, "rank").select("draw", column, label)


SCORES = ("accuracy", "balanced_accuracy", "precision_score", "recall", "f1", "dice", "hit", "kappa", "mcc", "specificity", "tn", "fp", "fn", "tp")
MEANS = ("mean_probability", "pct_positive")
METRICS = (*SCORES, *MEANS, "roc_auc", "average_precision")


def metric_table(df: DataFrame, chosen: dict[str, dict], by: list[str]) -> DataFrame:
    """``(*by, one column per entry)`` of entries ``{column: {"metric": name, **arguments}}``.

    All are read from the counts at every distinct score, so any number of metrics and thresholds
    costs one pass over the predictions; cumulative counts are made if an area is among them.
    """
    for how in chosen.values():
        if how["metric"] not in METRICS:
            raise ValueError(f"unknown metric {how['metric']!r}, one of {sorted(METRICS)}")
    asked = {how["metric"] for how in chosen.values()}
    rows = ranked_scores(df, by) if asked & set(_areas()) else score_counts(df, by)
    limits = sorted({how.get("threshold", 0.5) for how in chosen.values() if how["metric"] in SCORES})
    above = lambda c, t: F.sum(F.when(F.col("proba") > t, F.col(c)).otherwise(0))
    sums = {f"{c}{k}": above(c, t) for k, t in enumerate(limits) for c in "pq"} | {"p": F.sum("p"), "q": F.sum("q"), "n": F.sum(F.when(F.col("proba").isNotNull(), F.col("n"))), "s": F.sum(F.col("proba") * F.col("n"))}
    sums |= {name: c for name, c in _areas().items() if name in asked}
    told = rows.groupBy(*by).agg(*[c.alias(f"_{name}") for name, c in sums.items()])
    p, q = F.col("_p"), F.col("_q")
    means = {"mean_probability": F.col("_s") / F.col("_n"), "pct_positive": p / F.nullif(p + q, F.lit(0))}

    def value(name: str, threshold: float = 0.5) -> Column:
        if name not in SCORES:
            return means[name] if name in means else F.col(f"_{name}")
        k = limits.index(threshold)
        tp, fp = F.col(f"_p{k}"), F.col(f"_q{k}")
        return closed_forms(q - fp, fp, p - tp, tp)[name]

    return told.select(*by, *[value(**{"name" if k == "metric" else k: v for k, v in how.items()}).alias(column) for column, how in chosen.items()])


def metric(name: str, **bound) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The metric of that name with arguments bound: predictions and columns to ``(*by, value)``."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}, one of {sorted(METRICS)}")
    return lambda df, by: metric_table(df, {"value": {"metric": name, **bound}}, by)


def named_metrics(df: DataFrame, chosen: dict[str, dict], by: str = "fold") -> DataFrame:
    """``metric_table()`` with a row per fold and one of their means, whose fold is null."""
    return average_row(metric_table(df, chosen, [by]), by)


WEIGHTS = {"inverse_sqrt": weights_inverse_sqrt, "effective_n": weights_effective_n}


def class_weights(df: DataFrame, name: str, label: str = "target") -> DataFrame:
    """Weights chosen by name, a row a class, stored: what reads them does not count again."""
    if name not in WEIGHTS:
        raise ValueError(f"unknown weights {name!r}, one of {sorted(WEIGHTS)}")
    return materialize(WEIGHTS[name](df, label), "weights")
