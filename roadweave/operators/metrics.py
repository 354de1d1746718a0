"""Binary classification metrics from tables of labels and logits, as one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.numbering import banded

from roadweave.functions.scalars import sigmoid


# Warnings of a validation summary.
FEW = "validation split has fewer than 10 samples; metrics may be unstable"
ONE_CLASS = "validation split is single-class; binary metrics are not reliable"
NO_POSITIVES = "model predicted zero positive samples at threshold 0.5"


def _counts(y: Column, p: Column) -> dict[str, Column]:
    n = lambda a, b: F.count(F.when((y == a) & (p == b), 1))
    return {"tp": n(1, 1), "tn": n(0, 0), "fp": n(0, 1), "fn": n(1, 0)}


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def binary_metrics(rows: DataFrame, y_col: str = "y_true", logit_col: str = "logit", threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 (denominators of at least 1) and the confusion counts; 1 is predicted at sigmoid >= threshold."""
    y, p = F.col(y_col).cast("int"), (sigmoid(logit_col) >= threshold).cast("int")
    out = rows.agg(F.count("*").alias("n"), *(c.alias(k) for k, c in _counts(y, p).items()))
    precision, recall = F.col("tp") / _at_least_one(F.col("tp") + F.col("fp")), F.col("tp") / _at_least_one(F.col("tp") + F.col("fn"))
    both = precision + recall
    return out.select(
        ((F.col("tp") + F.col("tn")) / _at_least_one(F.col("n"))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.when(both > 0, 2 * precision * recall / F.when(both > 0, both)).otherwise(0.0).alias("f1"), "tp", "tn", "fp", "fn",
    )


def _by_score(rows: DataFrame, y_col: str, score_col: str) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score, so what is ordered next is as small as the set of scores."""
    y = F.col(y_col).cast("int")
    return rows.groupBy(F.col(score_col).alias("score")).agg(F.count(F.when(y == 1, 1)).alias("p"), F.count(F.when(y == 0, 1)).alias("n"))


#: Bands of score ranges whose totals are summed before the order within them, so no single task orders all scores.
BANDS = 64


def _with_running(scores: DataFrame, bands: int = BANDS) -> DataFrame:
    """scores (score, p, n) plus tp, fp: sums over scores at or above each, by ranges of scores in parallel."""
    ranged = banded(scores, [F.col("score").desc()], bands)
    totals = ranged.groupBy("__b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per band
    totals = totals.select("__b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"))
    own = Window.partitionBy("__b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), "__b").withColumns({"tp": F.sum("p").over(own) + F.col("bp"), "fp": F.sum("n").over(own) + F.col("bn")}).drop("__b", "bp", "bn")


def roc_auc(rows: DataFrame, y_col: str = "y_true", score_col: str = "logit", bands: int = BANDS) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half; null if a class is missing."""
    run = _with_running(_by_score(rows, y_col, score_col), bands)
    won = F.sum(F.col("p") * (F.col("fp") - F.col("n")) + 0.5 * F.col("p") * F.col("n"))  # negatives above or at a positive's score
    pos, neg = F.sum("p"), F.sum("n")
    return run.agg(F.when((pos > 0) & (neg > 0), 1 - won / F.when((pos > 0) & (neg > 0), pos * neg)).alias("roc_auc"))


def average_precision(rows: DataFrame, y_col: str = "y_true", score_col: str = "logit", bands: int = BANDS) -> DataFrame:
    """Sum over distinct thresholds of the step in recall times precision; null without positives."""
    run = _with_running(_by_score(rows, y_col, score_col), bands)
    pos = F.sum("p")
    return run.agg(F.when(pos > 0, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.when(pos > 0, pos)).alias("average_precision"))


def all_metrics(rows: DataFrame, y_col: str = "y_true", logit_col: str = "logit", threshold: float = 0.5) -> DataFrame:
    base = binary_metrics(rows, y_col, logit_col, threshold)
    return base.crossJoin(roc_auc(rows, y_col, logit_col)).crossJoin(average_precision(rows, y_col, logit_col).withColumnRenamed("average_precision", "pr_auc"))  # one row each


def calibration_error(rows: DataFrame, y_col: str = "y_true", logit_col: str = "logit", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of probability (an addition)."""
    p = sigmoid(logit_col)
    binned = rows.select(F.col(y_col).cast("double").alias("y"), p.alias("p"), F.least(F.floor(p * bins), F.lit(bins - 1)).alias("b"))
    per = binned.groupBy("b").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("p").alias("p"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("calibration_error"))


def validation_summary(rows: DataFrame, y_col: str = "label", pred_col: str = "pred_label") -> DataFrame:
    """Counts, confusion and warnings of a validation split."""
    y, p = F.col(y_col).cast("int"), F.col(pred_col).cast("int")
    out = rows.agg(
        F.count("*").alias("val_sample_count"), F.count(F.when(y == 1, 1)).alias("val_positive_count"), F.count(F.when(y == 0, 1)).alias("val_negative_count"),
        F.count(F.when(p == 1, 1)).alias("val_pred_positive_count"), F.count(F.when(p == 0, 1)).alias("val_pred_negative_count"), *(c.alias(k) for k, c in _counts(y, p).items()),
    )
    warn = [
        F.when(F.col("val_sample_count") < 10, FEW),
        F.when((F.col("val_positive_count") == 0) | (F.col("val_negative_count") == 0), ONE_CLASS),
        F.when((F.col("val_pred_positive_count") == 0) & (F.col("val_sample_count") > 0), NO_POSITIVES),
    ]
    return out.withColumn("warnings", F.filter(F.array(*warn), lambda w: w.isNotNull()))


def predictions(rows: DataFrame, logit_col: str = "logit", keep: list[str] | None = None) -> DataFrame:
    keep = [c for c in rows.columns if c != logit_col] if keep is None else keep
    return rows.select(*keep, F.col(logit_col).alias("logit"), sigmoid(logit_col).alias("prob")).withColumn("pred_label", (F.col("prob") >= 0.5).cast("int"))


def bce_loss(rows: DataFrame, y_col: str = "y_true", logit_col: str = "logit") -> DataFrame:
    """Mean binary cross-entropy of logits, in the form that doesn't overflow."""
    z, y = F.col(logit_col), F.col(y_col).cast("double")
    return rows.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))).alias("loss"))


def best_epoch(history: DataFrame, epoch_col: str = "epoch", f1_col: str = "f1") -> DataFrame:
    """The first epoch with the greatest F1."""
    return history.agg(F.max_by(epoch_col, F.struct(f1_col, -F.col(epoch_col))).alias("best_epoch"), F.max(f1_col).alias("best_f1"))
