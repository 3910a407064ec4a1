"""Ranks, running sums and exact percentiles that no single task has to hold.

A window over one key puts all rows of that key into one task. When a key may
own a third of the table, the operators here first split each key into ordered
buckets, count the buckets (a combined aggregation), run the window over the
bucket counts only, and finish inside each bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Distinct values of a bucket that are looked through at once, about.
PART_VALUES = 65536
#: How often a bucket of fractional values is split between its extremes.
SPLITS = 2


def hash_order(tag: Column, key: Column) -> Column:
    """Fixed pseudo-random order: the md5 text of ``tag|key``."""
    return F.md5(F.concat_ws("|", tag, key))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` that also matches null keys; keys that are never null join plainly."""
    nullable = [k for k in keys if left.schema[k].nullable]
    if not nullable:
        return left.join(right, keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k in nullable else F.col(k) == F.col(f"_r_{k}")
          for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, on)).drop(*[f"_r_{k}" for k in keys])


def rank_within(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                out: str = "rank") -> DataFrame:
    """1-based row number per key; ``bucket`` must not decrease along ``order``."""
    rows = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .transform(join_keys, offsets, by)
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_offset")
    )


def running_sums(df: DataFrame, keys: list[str], order: str, bucket: Column,
                 sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Running totals per key along distinct values of ``order``.

    ``sums`` maps a column to the name of its running total, current row
    included. ``bucket`` must follow the order of ``order``.
    """
    rows = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]

    def along(partition, column):
        direction = F.col(column).desc() if descending else F.col(column).asc()
        return Window.partitionBy(*partition).orderBy(direction)

    before = along(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*by, *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_keys(rows, offsets, by)
    for column, name in sums.items():
        joined = joined.withColumn(name, F.sum(column).over(inside) + F.col(f"_o_{column}"))
    return joined.drop("_bucket", *[f"_o_{c}" for c in sums])


def carry_forward(df: DataFrame, key: str, order: str, column: str,
                  block_rows: int = 65536) -> DataFrame:
    """Forward fill ``column`` per key in the order of the integer ``order``.

    Blocks of consecutive rows are filled on their own; the last value of every
    block is carried over by a window that sees one row per block.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    # last value of every block, null for a block without any
    tails = rows.groupBy(key, "_block").agg(F.max_by(
        column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_tail"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = tails.select(
        key, "_block", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.last(column, ignorenulls=True).over(inside))
        .join(carried, [key, "_block"], "left")
        .withColumn(column, F.coalesce("_local", "_carry"))
        .drop("_block", "_local", "_carry")
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      width: float, count: str = "n", moments: bool = False, weight: str | None = None,
                      totals: dict[str, tuple[Callable[[Column], Column], Column]] | None = None) -> DataFrame:
    """Exact percentiles (linear interpolation) of ``value`` per key.

    ``probs`` maps output names to probabilities; ``count`` names the row count;
    ``moments`` adds ``mean, std, min, max`` (sample deviation). A row stands for
    ``weight`` equal ones. ``totals`` adds other aggregates over all rows of a key, with
    or without a value: ``name -> (fold, column)``, where folding folds gives the same
    (``F.sum``, ``F.max``). With it, keys without any value have count 0 and null percentiles.
    Rows are first reduced to a histogram of distinct values, which carries whatever else
    is asked for, so ``df`` is computed once. Buckets of
    ``width`` locate the wanted ranks, and only the buckets that hold one are
    looked into, so neither a hot key nor a repeated value meets in one task.
    ``width`` affects the balance of the work, never the result: a bucket of fractional
    values, which may hold any number of them, is split ``SPLITS`` times more, each time between
    the extremes of a part into parts of about ``PART_VALUES`` values, so that values which
    crowd beside a far one part in the next split.
    """
    ps, totals = list(probs.values()), totals or {}
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.withColumn("_v", F.when(known, F.col(value))) if totals else df.where(known).withColumn("_v", F.col(value))
    here = F.col("_v").isNotNull()
    hist = rows.groupBy(*keys, "_v").agg(
        F.coalesce(F.sum(F.when(here, F.col(weight) if weight else 1)), F.lit(0)).cast("bigint").alias("_c"),
        *[fold(c).alias(f"_t_{name}") for name, (fold, c) in totals.items()])
    hist = hist.withColumn("_b", F.floor(F.col("_v") / width))
    by = [*keys, "_b"]
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    v = F.col("_v").cast("double")
    # values count from their bucket's edge, which keeps the squares small
    off = v - F.col("_b") * F.lit(float(width))
    extent = [F.sum("_c").alias("_bc"), F.min(v).alias("_least"), F.max(v).alias("_most"), F.count("_v").alias("_values")]
    sums = [F.sum(off * F.col("_c")).alias("_s1"), F.sum(off * off * F.col("_c")).alias("_s2")] if moments else []
    buckets = (
        hist.groupBy(*by).agg(*extent, *sums, *[fold(F.col(f"_t_{name}")).alias(f"_t_{name}") for name, (fold, _) in totals.items()])
        .withColumn("_end", F.sum("_bc").over(upto))
        .withColumn("_n", F.sum("_bc").over(everything))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
        .withColumns({f"_t_{name}": fold(F.col(f"_t_{name}")).over(everything) for name, (fold, _) in totals.items()})
    )
    if moments:
        buckets = _moments(buckets, everything, float(width))
    # values of the whole key, the same in all its buckets
    carried = [*(f"_t_{name}" for name in totals), *(["_mean", "_std", "_min", "_max"] if moments else [])]
    hist = hist.drop(*(f"_t_{name}" for name in totals))

    def ranks(n: Column) -> Column:
        spots = []
        for p in ps:
            at = (n - 1) * F.lit(float(p))
            spots += [F.floor(at), F.ceil(at)]
        return F.array_distinct(F.array(*spots))

    def holding(parts: DataFrame) -> DataFrame:
        """Parts that hold a wanted rank, with these ranks, and a part of every key without values."""
        return parts.withColumn("_ranks", F.filter(
            ranks(F.col("_n")), lambda r: (r >= F.col("_start")) & (r < F.col("_end")))).where(
            (F.size("_ranks") > 0) | (F.col("_n") == 0))

    parts = buckets
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        for split in range(SPLITS):
            hist, parts = _split_parts(hist, holding(parts), by, carried, f"_p{split}")
            by = [*by, f"_p{split}"]
    wanted = holding(parts).select(*by, "_start", "_n", "_ranks", *carried).withColumnsRenamed({c: f"_w_{c}" for c in by})
    within = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    on = reduce(lambda a, b: a & b,
                [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by])
    picked = (
        hist.join(wanted, on).drop(*[f"_w_{c}" for c in by])
        .withColumn("_e", F.col("_start") + F.sum("_c").over(within))
        .withColumn("_s", F.col("_e") - F.col("_c"))
        .withColumn("_rank", F.explode_outer(F.filter(
            "_ranks", lambda r: (r >= F.col("_s")) & (r < F.col("_e")))))
        .where(F.col("_rank").isNotNull() | (F.col("_n") == 0))
    )
    at = {p: (F.col("_n") - 1) * F.lit(float(p)) for p in ps}
    aggs = [F.max("_n").alias("_n"), *[F.max(c).alias(c) for c in carried]]
    for i, p in enumerate(ps):
        aggs.append(F.max(F.when(F.col("_rank") == F.floor(at[p]), v)).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(F.col("_rank") == F.ceil(at[p]), v)).alias(f"_hi{i}"))
    out = picked.groupBy(*keys).agg(*aggs)
    cols = [F.col("_n").cast("bigint").alias(count)]
    for i, (name, p) in enumerate(probs.items()):
        share = at[p] - F.floor(at[p])
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((low + (high - low) * share).alias(name))
    cols += [F.col(f"_t_{name}").alias(name) for name in totals]
    cols += [F.col(f"_{name}").alias(name) for name in ("mean", "std", "min", "max") if moments]
    return out.select(*keys, *cols)


def _split_parts(hist: DataFrame, held: DataFrame, by: list[str], carried: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """The values of the ``held`` parts with their place ``out`` in them, and the parts that this makes."""
    limits, known = ["_least", "_most", "_values"], ["_start", "_n", *carried]
    place = (F.col("_v").cast("double") - F.col("_least")) / (F.col("_most") - F.col("_least")) * F.ceil(F.col("_values") / PART_VALUES)
    rows = join_keys(hist, held.select(*by, *known, *limits), by).withColumn(
        out, F.when(F.col("_most") > F.col("_least"), F.floor(F.nanvl(place, F.lit(0.0)))).otherwise(0))
    v = F.col("_v").cast("double")
    upto = Window.partitionBy(*by).orderBy(out).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*by, out, *known).agg(
        F.sum("_c").alias("_bc"), F.min(v).alias("_least"), F.max(v).alias("_most"), F.count("_v").alias("_values"))
    parts = parts.withColumn("_end", F.col("_start") + F.sum("_bc").over(upto)).withColumn("_start", F.col("_end") - F.col("_bc"))
    return rows.drop(*known, *limits), parts


def _moments(buckets: DataFrame, whole, width: float) -> DataFrame:
    """Add mean, sample deviation and extremes of the whole key, from sums about the bucket edges."""
    edge = F.col("_b") * F.lit(width)
    mean = F.sum(F.col("_s1") + edge * F.col("_bc")).over(whole) / F.col("_n")
    gap = edge - F.col("_mean")
    square = F.col("_s2") + 2 * gap * F.col("_s1") + gap * gap * F.col("_bc")
    return buckets.withColumn("_mean", mean).withColumns({
        "_std": F.sqrt(F.try_divide(F.sum(square).over(whole), F.col("_n") - 1)),
        "_min": F.min("_least").over(whole), "_max": F.max("_most").over(whole)})
