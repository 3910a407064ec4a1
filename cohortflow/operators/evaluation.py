"""Classifier results: confusion counts, reports, ROC and areas.

Inputs hold ``y`` (0/1 truth) and ``pred`` (0/1) or ``score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .events import count_if
from .ranking import running_sums


def _cells(pred: DataFrame, *by: str) -> DataFrame:
    def cell(y, p):
        return count_if((F.col("y") == y) & (F.col("pred") == p))
    return pred.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Rows: true class 0 and 1; columns: predicted class."""
    rows = F.array(
        F.struct(F.lit(0).cast("bigint").alias("y"), F.col("tn").alias("pred_0"),
                 F.col("fp").alias("pred_1")),
        F.struct(F.lit(1).cast("bigint").alias("y"), F.col("fn").alias("pred_0"),
                 F.col("tp").alias("pred_1")))
    return _cells(pred).select(F.explode(rows).alias("r")).select("r.*")


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class and their averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def scores(hit, false, lost):
        p, r = _ratio(hit, hit + false), _ratio(hit, hit + lost)
        return p, r, _ratio(2 * hit, 2 * hit + false + lost), hit + lost

    zero, one = scores(tn, fn, fp), scores(tp, fp, fn)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    accuracy = _ratio(tn + tp, total)
    table = [("Normal", *zero), ("Abnormal", *one), ("accuracy", accuracy, accuracy, accuracy, total),
             ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    rows = F.array(*[
        F.struct(F.lit(n).alias("row"), p.alias("precision"), r.alias("recall"),
                 f.alias("f1"), s.cast("bigint").alias("support"))
        for n, p, r, f, s in table])
    return _cells(pred).select(F.explode(rows).alias("x")).select("x.*")


def accuracy_by_input_length(pred: DataFrame, length: str = "input_len") -> DataFrame:
    return _cells(pred, length).select(
        length,
        _ratio(F.col("tn") + F.col("tp"),
               F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("accuracy"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def score_cumulation(scores: DataFrame, parts: int = 256) -> DataFrame:
    """True and false positives at or above every distinct score.

    Ties are merged first. Running sums are split over tasks at about ``parts`` quantiles of
    the distinct scores, so neither crowded nor unbounded scores matter; the result does not
    depend on them. Null scores come last, NaN first.
    """
    points = scores.groupBy("score").agg(
        count_if(F.col("y") == 1).alias("pos"), count_if(F.col("y") == 0).alias("neg"))
    edges = points.agg(F.percentile_approx(
        F.col("score").cast("double"), [i / parts for i in range(1, parts)], 8 * parts)).scalar()
    below = F.size(F.filter("_edges", lambda e: e <= F.col("score")))
    placed = points.withColumn("_edges", edges).withColumn(
        "_at", F.when(F.col("score").isNotNull(), below)).drop("_edges")
    return running_sums(placed, [], "score", F.col("_at"),
                        {"pos": "tp", "neg": "fp"}, descending=True).drop("_at")


def _totals(scores: DataFrame) -> Column:
    return scores.agg(F.struct(count_if(F.col("y") == 1).alias("p"),
                               count_if(F.col("y") == 0).alias("n"))).scalar()


def roc_curve(scores: DataFrame) -> DataFrame:
    total = _totals(scores)
    return score_cumulation(scores).select(
        "score", F.try_divide(F.col("fp").cast("double"), total["n"]).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), total["p"]).alias("tpr"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Exact area: a tied score counts half against the positives it is tied with."""
    areas = score_cumulation(scores).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_area"))
    total = _totals(scores)
    return areas.select(
        F.try_divide(F.col("_area").cast("double"), total["p"] * total["n"]).alias("auc"))
