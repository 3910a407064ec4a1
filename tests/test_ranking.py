"""Bucketed ranks, running sums, fills and percentiles against direct results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import evaluation as evl, ranking
from cohortflow.operators.ranking import (carry_forward, exact_percentiles, rank_within,
                                          running_sums)
from cohortflow.operators.split import random_split


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 7}"
        value = 5.0 if i % 4 == 0 else round(rng.expovariate(0.01), 3)
        rows.append((key, value if i % 50 else None, i))
    rows += [(None, 1.0, 3000), (None, 2.0, 3001), ("one", 9.0, 3002)]
    return rows, spark.createDataFrame(rows, "k string, v double, i bigint").cache()


@pytest.mark.parametrize("width", [0.5, 10.0, 1e9])
def test_percentiles_and_moments(skewed, width):
    rows, df = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs, width, moments=True).collect()}
    for key in {r[0] for r in rows}:
        x = np.array([r[1] for r in rows if r[0] == key and r[1] is not None])
        assert got[key].n == len(x)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(x, p), abs=1e-9)
        assert got[key]["mean"] == pytest.approx(x.mean())
        assert (got[key]["min"], got[key]["max"]) == (x.min(), x.max())
        if len(x) > 1:
            assert got[key]["std"] == pytest.approx(x.std(ddof=1))
        else:
            assert got[key]["std"] is None


def test_percentiles_without_key(skewed):
    rows, df = skewed
    x = np.array([r[1] for r in rows if r[1] is not None])
    got = exact_percentiles(df, [], "v", {"m": 0.5}, 3.0).first()
    assert got.m == pytest.approx(np.median(x)) and got.n == len(x)


def test_rank_within(skewed):
    rows, df = skewed
    df = df.where("v IS NOT NULL AND k IS NOT NULL")
    got = rank_within(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 7)).collect()
    want = {}
    for key in {r.k for r in got}:
        order = sorted((r[1], r[2]) for r in rows if r[0] == key and r[1] is not None)
        want.update({i: n + 1 for n, (_, i) in enumerate(order)})
    assert {r.i: r["rank"] for r in got} == want


def test_running_sums_descending(spark):
    df = spark.createDataFrame([(s / 10, s) for s in range(1, 30)], "score double, n bigint")
    got = running_sums(df, [], "score", F.floor("score"), {"n": "total"}, descending=True).collect()
    assert {r.score: r.total for r in got} == {
        s / 10: sum(range(s, 30)) for s in range(1, 30)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_carry_forward(spark, block):
    rng = random.Random(block)
    rows = [(f"f{i % 3}", i, rng.choice([None, None, None, f"v{i}"])) for i in range(200)]
    got = carry_forward(spark.createDataFrame(rows, "f string, i bigint, v string"),
                        "f", "i", "v", block).collect()
    last, want = {}, {}
    for f, i, v in rows:
        last[f] = v or last.get(f)
        want[i] = last[f]
    assert len(got) == 200 and {r.i: r.v for r in got} == want


def test_random_split_is_exact(spark):
    df = spark.range(101)
    parts = random_split(df, "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"test": 31, "train": 70}


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    got = evl.roc_auc(spark.createDataFrame(rows, "y int, score double")).first().auc
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(wins / len(pos) / len(neg))


def test_values_that_crowd_beside_a_far_one(spark, monkeypatch):
    """One bucket with 4000 values inside 1e-12 and one far away: the second split takes them apart."""
    monkeypatch.setattr(ranking, "PART_VALUES", 16)
    rng = np.random.default_rng(2)
    x = np.unique(0.25 + rng.random(4000) * 1e-12)
    df = spark.createDataFrame([(float(v),) for v in [*x, 900.0]], "v double")
    seen, plain = [], ranking._split_parts

    def watched(*args):
        rows, parts = plain(*args)
        seen.append(parts.agg(F.max("_values")).first()[0])
        return rows, parts

    monkeypatch.setattr(ranking, "_split_parts", watched)
    got = exact_percentiles(df, [], "v", {"p25": 0.25, "m": 0.5}, 1000.0).first()
    assert [got.p25, got.m] == list(np.quantile([*x, 900.0], [0.25, 0.5]))
    assert len(seen) == ranking.SPLITS and seen[0] == len(x) and seen[1] < 16 * 8


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_totals_and_weights(spark, kind):
    """Keys without values keep their totals; a row of weight n is n rows; null keys are a key."""
    rows = [("a", 1, 2, 7), ("a", 5, 1, 9), ("a", None, 4, 1), ("b", None, 3, 2), (None, 8, 1, 4), (None, None, 1, 5)]
    df = spark.createDataFrame(rows, "k string, v bigint, w bigint, x bigint").withColumn("v", F.col("v").cast(kind))
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"m": 0.5}, 2.0, weight="w", moments=True, totals={
        "x": (F.sum, F.col("x")), "most": (F.max, F.col("x"))}).collect()}
    assert {k: (r.n, r.m, r.x, r.most) for k, r in got.items()} == {
        "a": (3, 1.0, 17, 9), "b": (0, None, 2, 2), None: (1, 8.0, 9, 5)}
    assert got["a"]["mean"] == pytest.approx(7 / 3) and got["a"]["std"] == pytest.approx(np.std([1, 1, 5], ddof=1))
    assert (got["b"]["mean"], got["b"]["max"]) == (None, None) and got[None]["std"] is None
    empty = exact_percentiles(df.limit(0), ["k"], "v", {"m": 0.5}, 2.0, totals={"x": (F.sum, F.col("x"))})
    assert empty.count() == 0
