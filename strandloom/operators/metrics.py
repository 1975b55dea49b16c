"""Metrics over a table of predictions, in a fixed number of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: n, mse, rmse, mae, r2 (1 - SSE / SST), pearson; r2 and pearson are null for n <= 1."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    e = y - p
    r2 = F.when(F.count("*") > 1, 1 - F.sum(e * e) / (F.var_pop(y) * F.count("*")))
    return df.where(y.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.when(F.count("*") > 1, F.corr(y, p)).alias("pearson"))


def thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) of each distinct score, with tp and fp, the positives and negatives at or above it.

    Ranks are over distinct scores. Running sums are made within 1,024 buckets of the score's range order, plus the
    sums of the buckets before, so that no task sees all scores.
    """
    got = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ends = got.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1023)).otherwise(0).cast("int")
    got = got.crossJoin(F.broadcast(ends)).withColumn("b", bucket).drop("lo", "hi")
    whole = Window.partitionBy(F.lit(1)).orderBy(F.desc("b"))  # over at most 1,024 rows
    before = got.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn")).select("b", (F.sum("bp").over(whole) - F.col("bp")).alias("bp"), (F.sum("bn").over(whole) - F.col("bn")).alias("bn"))
    inside = Window.partitionBy("b").orderBy(F.desc("score"))
    return got.join(F.broadcast(before), "b").select("score", "pos", "neg", (F.sum("pos").over(inside) + F.col("bp")).alias("tp"), (F.sum("neg").over(inside) + F.col("bn")).alias("fp"))


def curve_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: roc_auc (ties count half), pr_auc (trapezoids over distinct thresholds from recall 0, precision 1);
    null where a class is missing."""
    t = thresholds(df, label, score)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    pieces = t.select("pos", "neg", (F.col("neg") * (tp0 + F.col("tp")) / 2.0).alias("roc"), (F.col("pos") * (before + F.col("tp") / (F.col("tp") + F.col("fp"))) / 2.0).alias("pr"))
    p, n = F.sum("pos"), F.sum("neg")
    return pieces.agg(F.when((p > 0) & (n > 0), F.sum("roc") / (p * n)).alias("roc_auc"), F.when((p > 0) & (n > 0), F.sum("pr") / p).alias("pr_auc"))


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """One row of binary metrics; divisions by zero give 0."""
    y, p = F.col(label) == 1, predicted
    c = df.where(F.col(label).isNotNull()).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select("tp", "fp", "fn", "tn", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp * tn - fp * fn, root).alias("mcc"))


def weighted_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: precision, recall and F1 over several classes, weighted by their rows."""
    n = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    lab = n.groupBy(F.col(label).alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    pre = n.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("called"))
    got = lab.join(pre, "k", "left").na.fill(0)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("called")), safe(F.col("tp"), F.col("support"))
    mean = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return got.agg(mean(p).alias("precision"), mean(r).alias("recall"), mean(safe(2 * p * r, p + r)).alias("f1"))
