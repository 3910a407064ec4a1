"""Exact stratified selection and train/evaluation assignment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .labels import inline_table
from .ranking import hash_order, rank_within

# Default number of recordings per class and split.
TARGETS = {("train", "Normal"): 2787, ("evaluation", "Normal"): 540,
           ("train", "Abnormal"): 686, ("evaluation", "Abnormal"): 460}


def strata(valid: DataFrame) -> DataFrame:
    """Add the ``class_source_year`` stratum."""
    return valid.withColumn("stratum", F.concat_ws("_", "label", "source", "year"))


def stratum_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "stratum").agg(F.count("*").alias("n"))


def allocate(table: pd.DataFrame, total: int) -> pd.Series:
    """Share ``total`` among the rows of ``table(key, weight, lower, upper)``.

    Rounds of whole shares in proportion to the weights of the groups that still
    have room; when no group gets a whole share, single units go out by largest
    fraction, then weight, then key.
    """
    given = table["lower"].astype(int).copy()
    upper = table["upper"].astype(int)
    if given.sum() > total or upper.sum() < total:
        raise ValueError(
            f"cannot allocate {total} between {given.sum()} and {upper.sum()}")
    left = int(total - given.sum())
    while left > 0:
        room = (upper - given)[given < upper]
        weight = table.loc[room.index, "weight"].clip(lower=0).astype(float)
        if weight.sum() == 0:
            weight[:] = 1.0
        ideal = left * weight / weight.sum()
        whole = ideal.map(math.floor)
        extra = pd.concat([whole, room], axis=1).min(axis=1)
        if extra.sum() == 0:
            rank = pd.DataFrame({"f": ideal - whole, "w": weight,
                                 "k": table.loc[room.index, "key"].astype(str)})
            lucky = rank.sort_values(["f", "w", "k"], ascending=False).index[:left]
            extra = pd.Series(1, index=lucky)
        given.loc[extra.index] += extra
        left -= int(extra.sum())
    return given


def bounded_allocate(groups: DataFrame) -> DataFrame:
    """Allocate per class; ``groups(label, key, weight, lower, upper, total)``.

    The input holds one row per stratum: two sources and four-digit years bound
    a class to some twenty thousand rows, whatever the number of recordings.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        return pdf.assign(allocated=allocate(pdf, int(pdf["total"].iloc[0])))[
            ["label", "key", "allocated"]]

    return groups.groupBy("label").applyInPandas(
        run, "label string, key string, allocated bigint")


def _plan_class(pdf: pd.DataFrame) -> pd.DataFrame:
    """Selected and evaluation counts of every stratum of one class."""
    pdf = pdf.sort_values("stratum", ignore_index=True)
    train, evaluation = int(pdf["train"].iloc[0]), int(pdf["evaluation"].iloc[0])
    n = pdf["n"]
    floor = 1 if train + evaluation >= len(pdf) else 0
    table = pd.DataFrame({"key": pdf["stratum"], "weight": n, "lower": floor, "upper": n})
    pdf["n_selected"] = allocate(table, train + evaluation)
    chosen = pdf[pdf["n_selected"] > 0].copy()
    count = chosen["n_selected"]
    both = count >= 2
    strict = pd.DataFrame({"key": chosen["stratum"], "weight": count,
                           "lower": both.astype(int), "upper": (count - 1).where(both, 0)})
    try:
        chosen["n_evaluation"] = allocate(strict, evaluation)
    except ValueError:
        chosen["n_evaluation"] = allocate(strict.assign(lower=0, upper=count), evaluation)
    return chosen[["label", "stratum", "n", "n_selected", "n_evaluation"]]


def share_targets(counts: DataFrame, percent: dict[str, int]) -> DataFrame:
    """Targets as whole percents of what each class has: ``label, train, evaluation``, rounded down.

    They follow the data, so a split can be designed on a table of any size.
    """
    n = F.sum("n")
    return counts.groupBy("label").agg(*[
        F.floor(n * percent[s] / 100).cast("bigint").alias(s) for s in ("train", "evaluation")])


def _target_table(spark: SparkSession, targets: dict[tuple[str, str], int] | DataFrame) -> DataFrame:
    if isinstance(targets, DataFrame):
        return targets
    return inline_table(
        spark, [(c, targets[("train", c)], targets[("evaluation", c)]) for c in sorted({c for _, c in targets})],
        "label string, train bigint, evaluation bigint")


def plan_split(counts: DataFrame, targets: dict[tuple[str, str], int] | DataFrame) -> DataFrame:
    """How many recordings of each stratum to select and to evaluate on.

    Targets are fixed numbers or a table of ``share_targets``; a class is one row of either.
    """
    dim = _target_table(counts.sparkSession, targets)
    return counts.join(F.broadcast(dim), "label").groupBy("label").applyInPandas(
        _plan_class, "label string, stratum string, n bigint, n_selected bigint, "
                     "n_evaluation bigint")


def stratum_rank(rows: DataFrame, purpose: str, out: str) -> DataFrame:
    """Rank inside each stratum in a fixed hash order of the stems."""
    tag = F.concat_ws("_", F.lit(purpose), "label", "stratum")
    ranked = rows.withColumn("_hash", hash_order(tag, F.col("stem")))
    return rank_within(ranked, ["label", "stratum"], [F.col("_hash"), F.col("stem")],
                       F.substring("_hash", 1, 3), out).drop("_hash")


def stratum_rank_sample(rows: DataFrame, plan: DataFrame, count: str,
                        purpose: str = "select") -> DataFrame:
    """The first ``count`` rows of every stratum in hash order."""
    ranked = stratum_rank(rows, purpose, "_rank")
    wanted = plan.select("label", "stratum", F.col(count).alias("_take"))
    return (ranked.join(wanted, ["label", "stratum"])
            .where(F.col("_rank") <= F.col("_take")).drop("_rank", "_take"))


def select_records(valid: DataFrame, plan: DataFrame) -> DataFrame:
    return stratum_rank_sample(valid, plan, "n_selected", "select")


def assign_split(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Evaluation for the planned number of rows of each stratum, else train."""
    ranked = stratum_rank(selected, "eval", "_rank")
    wanted = plan.select("label", "stratum", "n_evaluation")
    return (
        ranked.join(wanted, ["label", "stratum"])
        .withColumn("split", F.when(F.col("_rank") <= F.col("n_evaluation"), "evaluation")
                    .otherwise("train"))
        .drop("_rank", "n_evaluation")
    )


def check_targets(assigned: DataFrame, targets: dict[tuple[str, str], int] | DataFrame) -> DataFrame:
    """Counts per split and class; the job fails when one misses its target."""
    if isinstance(targets, DataFrame):
        dim = targets.unpivot("label", ["train", "evaluation"], "split", "target")
    else:
        dim = inline_table(assigned.sparkSession, [(s, c, n) for (s, c), n in targets.items()],
                           "split string, label string, target bigint")
    counts = assigned.groupBy("split", "label").agg(F.count("*").alias("n"))
    both = dim.join(F.broadcast(counts), ["split", "label"], "left").na.fill(0, ["n"])
    wrong = F.concat(F.lit("split count mismatch: "), "split", F.lit(" "), "label")
    return both.withColumn("n", F.when(F.col("n") == F.col("target"), F.col("n"))
                           .otherwise(F.raise_error(wrong).cast("bigint")))


def sort_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("split", "label", "source", "year", "file_name")


def random_split(rows: DataFrame, key: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Unstratified split of exact size: the first ``ceil(share * n)`` in hash order."""
    hashed = rows.withColumn("_hash", hash_order(F.lit(str(seed)), F.col(key).cast("string")))
    ranked = rank_within(hashed, [], [F.col("_hash"), F.col(key)],
                         F.substring("_hash", 1, 3), "_rank")
    size = rows.agg(F.ceil(F.lit(test_share) * F.count("*"))).scalar()
    return ranked.withColumn("part", F.when(F.col("_rank") <= size, "test").otherwise(
        "train")).drop("_hash", "_rank")
