"""Quality of scores and of extracted entities against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STEPS = 50


def _ratio(top: Column, bottom: Column, places: int = 4) -> Column:
    return F.when(bottom > 0, F.round(top / bottom, places)).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, tn, fp, fn; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"accuracy": _ratio(tp + tn, F.greatest(tp + tn + fp + fn, F.lit(1))),
                              "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1_score", F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0))


def confusion(df: DataFrame, score: str, label: str, threshold: float, *group: str) -> DataFrame:
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    return metrics(df.groupBy(*group).agg(
        F.count_if(true & hit).alias("tp"), F.count_if(~true & ~hit).alias("tn"),
        F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn")))


def roc_points(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """(fpr, tpr) at the thresholds 0.00, 0.02, ..., 1.00.

    A score counts for every threshold up to its own step, so one histogram of 52
    bins per group replaces 51 passes; the window below sorts 51 rows per group.
    """
    step = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    top = F.size(F.filter(step, lambda t: F.col(score) >= t))
    bins = df.groupBy(*group, top.alias("top")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    wide = bins.groupBy(*group).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.collect_list(F.struct("top", "pos", "neg")).alias("h"))
    at_least = lambda field: F.transform(F.sequence(F.lit(1), F.lit(STEPS + 1)), lambda k: F.aggregate(
        F.filter(F.col("h"), lambda b: b["top"] >= k), F.lit(0).cast("long"), lambda a, b: a + b[field]))
    wide = wide.withColumns({"tp": at_least("pos"), "fp": at_least("neg")})
    points = wide.select(*group, "n_pos", "n_neg", F.posexplode(F.arrays_zip("tp", "fp")).alias("step", "p"))
    return points.filter("n_pos > 0 AND n_neg > 0").select(
        *group, "step", (F.col("p.fp") / F.col("n_neg")).alias("fpr"), (F.col("p.tp") / F.col("n_pos")).alias("tpr"))


def roc_auc(df: DataFrame, score: str, label: str, *group: str) -> DataFrame:
    """Trapezoid under the points in order of fpr (ties by threshold); 0.5 when one class is missing."""
    points = roc_points(df, score, label, *group)
    w = Window.partitionBy(*group).orderBy("fpr", "step") if group else Window.partitionBy(F.lit(0)).orderBy("fpr", "step")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2.0
    auc = points.withColumn("area", area).groupBy(*group).agg(
        F.round(F.least(F.lit(1.0), F.abs(F.sum("area"))), 4).alias("roc_auc"), F.count("area").alias("_n_areas"))
    auc = auc.filter("_n_areas > 0").drop("_n_areas")
    every = df.groupBy(*group).agg(F.count("*").alias("_n"))
    if group:
        joined = every.join(auc, list(group), "left")
    else:
        joined = every.withColumn("_k", F.lit(0)).join(auc.withColumn("_k", F.lit(0)), "_k", "left")
    return joined.select(*group, F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"))


def calibrated(score: Column) -> Column:
    """Anomaly score to probability."""
    return 1.0 / (1.0 + F.exp(score * 6.0))


def extraction_quality(samples: DataFrame, extracted: str = "extracted", expected: str = "expected",
                       *group: str) -> DataFrame:
    """tp, fp, fn of extracted against expected values (arrays per sample), either containing the other.

    ``balance`` is the mean of precision and recall; tn is what is missing to five per sample.
    """
    e, x = F.array_distinct(expected), F.array_distinct(extracted)
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    counted = samples.select(
        *group, F.size(F.filter(x, lambda v: F.exists(e, lambda w: either(v, w)))).alias("tp"),
        F.size(F.filter(x, lambda v: ~F.exists(e, lambda w: either(v, w)))).alias("fp"),
        F.size(F.filter(e, lambda w: ~F.exists(x, lambda v: either(v, w)))).alias("fn"))
    total = counted.groupBy(*group).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                                        F.count("*").alias("n_samples"))
    total = total.withColumn("tn", F.greatest(F.lit(0), F.col("n_samples") * 5 - F.col("tp") - F.col("fp") - F.col("fn")))
    return metrics(total).withColumn("balance", F.round((F.col("precision") + F.col("recall")) / 2.0, 4))
