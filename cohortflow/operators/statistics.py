"""Counts, durations, histograms, box tables, co-occurrence and cross-tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import taxonomy
from ..functions.text import AGE_GROUPS, GENDERS, age_group, normalize_gender
from .events import count_if
from .labels import inline_table, label_dim, label_family
from .ranking import exact_percentiles, join_keys

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def label_counts(events: DataFrame, column: str) -> DataFrame:
    """Events per label, nulls left out."""
    return (events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label"))
            .agg(F.count("*").alias("n")))


def top_k(counts: DataFrame, k: int, by: str = "n", tie=("label",)) -> DataFrame:
    return counts.orderBy(F.col(by).desc(), *tie).limit(k)


def label_event_file_counts(events: DataFrame, label: str, order) -> DataFrame:
    """Events and recordings per label; labels that never occur count 0."""
    per_file = events.groupBy("file_id", F.col(label).alias("label")).agg(
        F.count("*").alias("n"))
    counts = per_file.groupBy("label").agg(
        F.sum("n").alias("event_count"), F.count("*").alias("file_count"))
    return _zero_filled(label_dim(events.sparkSession, order), counts,
                        ["label"], ["event_count", "file_count"])


def _zero_filled(dim: DataFrame, counts: DataFrame, keys, columns) -> DataFrame:
    # only rows of the grid are kept, so the broadcast side is no larger than it
    inside = counts.join(F.broadcast(dim.select(*keys)), keys, "left_semi")
    return dim.join(F.broadcast(inside), keys, "left").na.fill(0, columns)


def duration_stats(events: DataFrame, keys: list[str], value: str = "dur_ms",
                   width: float = 1000) -> DataFrame:
    """Count, mean, median, sample deviation, min and max per key."""
    return exact_percentiles(events, keys, value, {"median": 0.5}, width, moments=True)


def duration_percentiles(events: DataFrame, keys: list[str]) -> DataFrame:
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return exact_percentiles(events, keys, "dur_ms", probs, width=1000)


def duration_median_iqr(events: DataFrame, label: str, k: int) -> DataFrame:
    """Quartiles and size of the ``k`` most frequent labels."""
    top = F.broadcast(top_k(label_counts(events, label), k).select(F.col("label").alias(label)))
    kept = events.join(top, label, "left_semi")
    return exact_percentiles(kept, [label], "dur_ms", QUARTILES, width=1000)


def family_durations(events: DataFrame) -> DataFrame:
    """Duration quartiles of all events and of each family but ``Other``.

    ``Other`` stays inside ``All``; only the histogram of each family is counted twice.
    """
    hist = events.groupBy("family", "dur_ms").agg(F.count("*").alias("_w"))
    both = hist.withColumn("group", F.explode(F.array(F.lit("All"), "family")))
    return exact_percentiles(both.where("group <> 'Other'"), ["group"], "dur_ms",
                             QUARTILES, width=1000, weight="_w")


def family_counts(events: DataFrame, family: str = "family") -> DataFrame:
    counts = events.groupBy(F.col(family).alias("label")).agg(F.count("*").alias("n"))
    return _zero_filled(label_dim(events.sparkSession, taxonomy.FAMILIES), counts,
                        ["label"], ["n"])


def label_share(events: DataFrame, label: str, order) -> DataFrame:
    """Count and per cent of all events, in table order, 0 for absent labels."""
    counts = events.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    dim = label_dim(events.sparkSession, order)
    return _zero_filled(dim, counts, ["label"], ["n"]).withColumn(
        "pct", F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)))


def events_per_file(events: DataFrame, *extra: str) -> DataFrame:
    return events.groupBy("file_id", *extra).agg(F.count("*").alias("n_events"))


def event_burden(events: DataFrame) -> DataFrame:
    """Median and quartiles of events per recording."""
    return exact_percentiles(events_per_file(events), [], "n_events", QUARTILES, width=100,
                             count="n_files")


def event_density(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Events per minute of recording."""
    length = headers.select("file_id", "dur_ms")
    return (
        events_per_file(events).join(length, "file_id")
        .withColumn("events_per_min", F.try_divide("n_events", F.col("dur_ms") / 60000))
    )


def describe_numeric(df: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Count, mean, deviation and exact quartiles; ``columns`` maps name -> width.

    The columns are turned into rows, so one pass serves all of them.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("x")).select("x.*")
    long = long.where(F.col("value").isNotNull())
    return exact_percentiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75},
                             width=max(columns.values()), moments=True)


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bins`` equal bins from min to max, the last one closed, none left out."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    bounds = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # a constant column gets a unit range around its value
    flat = F.col("low") == F.col("high")
    bounds = bounds.select(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    edges = bounds.select(F.struct("low", width.alias("width"))).scalar()
    placed = values.select(
        F.least(F.floor((F.col("x") - edges["low"]) / edges["width"]), F.lit(bins - 1))
        .cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    grid = bounds.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
                         .alias("bin"))
    return (
        grid.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])
        .select(F.col("bin").cast("bigint").alias("bin"),
                (F.col("low") + F.col("bin") * width).alias("bin_start"),
                (F.col("low") + (F.col("bin") + 1) * width).alias("bin_end"), "n")
    )


def box_stats(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 IQR of the box."""
    box = exact_percentiles(df, keys, value, QUARTILES, width)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    # repeated values say nothing new about the whiskers and go before the shuffle
    near = join_keys(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*keys, value).distinct(),
                     box.select(*keys, "q1", "q3"), keys)
    whiskers = near.groupBy(*keys).agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).cast("double").alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).cast("double").alias("whisker_high"))
    return join_keys(box, whiskers, keys)


def metric_median_iqr(metrics: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Median, quartiles and IQR of each metric; ``columns`` maps name -> width."""
    long = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("x")).select("x.*")
    out = exact_percentiles(long, ["metric"], "value", QUARTILES, max(columns.values()))
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def group_medians(metrics: DataFrame, group: str, columns: list[str], width: float) -> DataFrame:
    """Median of each metric per group, in long form."""
    return exact_percentiles(band_long(metrics, [group], columns), [group, "band"],
                             "value", {"median": 0.5}, width)


def band_long(metrics: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return metrics.unpivot(ids, columns, "band", "value")


def channel_means(channel_metrics: DataFrame, value: str) -> DataFrame:
    return channel_metrics.groupBy("channel").agg(F.avg(value).alias("mean"),
                                                  F.count("*").alias("n"))


def run_mean_std(runs: DataFrame, model: str, score: str) -> DataFrame:
    """Mean and population deviation of repeated scores per model."""
    return runs.groupBy(F.col(model).alias("model")).agg(
        F.count(score).alias("n_runs"), F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"))


# ---- labels per recording ----------------------------------------------
# The labels of a vocabulary are bits of a few numbers, so what occurs in a
# recording is a bitwise OR: a fixed-size, combinable state for any hot file.

#: Labels in one number of a mask.
WORD = 60


def label_masks(events: DataFrame, label: str, order, keep_unknown: bool = False) -> DataFrame:
    """``(file_id, mask)``: bit ``i % WORD`` of number ``i // WORD`` is set when label ``i`` of ``order`` occurs."""
    known = [(name, i) for i, name in enumerate(order) if keep_unknown or name != "Unknown"]
    if not known:
        return events.select("file_id", F.array(F.lit(0).cast("bigint")).alias("mask")).limit(0)
    place = F.create_map(*[F.lit(x) for pair in known for x in pair])
    marked = events.select("file_id", F.try_element_at(place, F.col(label)).alias("_i")).where("_i IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_i") % WORD)
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("_i") / WORD) == w, bit)), F.lit(0).cast("bigint"))
             for w in range(-(-len(order) // WORD))]
    return marked.groupBy("file_id").agg(F.array(*words).alias("mask"))


def has_label(mask: Column, index: int) -> Column:
    return F.get(mask, F.lit(index // WORD)).bitwiseAND(F.lit(1 << index % WORD).cast("bigint")) != 0


def n_labels(mask: Column | str) -> Column:
    """Number of labels in a mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, word: n + F.bit_count(word))


def mask_labels(mask: Column, order) -> Column:
    """Labels of a mask as an array in canonical order."""
    return F.filter(
        F.array(*[F.when(has_label(mask, i), F.lit(n)) for i, n in enumerate(order)]),
        lambda x: x.isNotNull())


def labels_per_file(masks: DataFrame) -> DataFrame:
    """Recordings by number of distinct labels, with the share of the total."""
    sizes = masks.groupBy(n_labels("mask").alias("num_labels")).agg(
        F.count("*").alias("n_files"))
    total = sizes.agg(F.sum("n_files")).scalar()
    return sizes.withColumn("pct", 100.0 * F.col("n_files") / total)


def single_vs_multiple(masks: DataFrame) -> DataFrame:
    many = n_labels("mask") > 1
    return masks.agg(
        F.count("*").alias("n_files"), count_if(~many).alias("single"),
        count_if(many).alias("multiple"),
        F.coalesce(F.try_divide(100.0 * count_if(many), F.count("*")), F.lit(0.0))
        .alias("pct_multiple"))


def label_sets(masks: DataFrame, order) -> DataFrame:
    """Sorted label list of every recording that has more than one."""
    return masks.where(n_labels("mask") > 1).select(
        "file_id", F.array_sort(mask_labels(F.col("mask"), order)).alias("labels"))


def presence_matrix(masks: DataFrame, order) -> DataFrame:
    """One row per recording, one 0/1 column per label of the order."""
    return masks.select("file_id", *[
        has_label(F.col("mask"), i).cast("bigint").alias(n) for i, n in enumerate(order)])


def label_cooccurrence(masks: DataFrame, order) -> DataFrame:
    """Recordings that have both labels of a pair, for pairs that occur.

    Recordings are first counted per distinct label set. There are at most
    ``2 ** len(order)`` sets, so pairs are formed on that small table only.
    """
    sets = masks.groupBy("mask").agg(F.count("*").alias("_files"))
    found = sets.select("_files", mask_labels(F.col("mask"), order).alias("_l"))
    pairs = F.flatten(F.transform("_l", lambda a, i: F.transform(
        F.slice("_l", i + 2, F.size("_l")),
        lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    return (
        found.select("_files", F.explode(pairs).alias("p"))
        .groupBy("p.label_a", "p.label_b").agg(F.sum("_files").alias("n_files"))
    )


def cooccurrence_matrix(masks: DataFrame, order) -> DataFrame:
    """The full symmetric matrix with a zero diagonal, one row per label."""
    pairs = label_cooccurrence(masks, order)
    mirrored = pairs.unionByName(pairs.select(
        F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), "n_files"))
    wide = mirrored.groupBy(F.col("label_a").alias("label")).pivot("label_b", list(order)).agg(
        F.sum("n_files"))
    return _zero_filled(label_dim(masks.sparkSession, order), wide, ["label"], list(order))


def presence_demographics(masks: DataFrame, meta: DataFrame) -> DataFrame:
    """Masks beside the distinct ``(file_id, age, gender)`` rows."""
    people = meta.select("file_id", "age", "gender").distinct()
    return masks.join(people, "file_id", "left")


def _label_by(people: DataFrame, order, group: Column, names, out: str) -> DataFrame:
    # counted per label set and group first, then spread over the labels
    counts = (
        people.groupBy("mask", group.alias(out)).agg(F.count("*").alias("_n"))
        .withColumn("label", F.explode(mask_labels(F.col("mask"), order)))
        .groupBy("label", out).agg(F.sum("_n").alias("n_files"))
    )
    grid = inline_table(
        people.sparkSession,
        [(a, b, i, j) for i, a in enumerate(order) for j, b in enumerate(names)],
        f"label string, {out} string, label_ord int, group_ord int")
    return _zero_filled(grid, counts, ["label", out], ["n_files"])


def label_by_age(people: DataFrame, order) -> DataFrame:
    return _label_by(people, order, age_group(F.col("age")),
                     [g[2] for g in AGE_GROUPS], "age_group")


def label_by_gender(people: DataFrame, order) -> DataFrame:
    return _label_by(people, order, normalize_gender(F.col("gender")), GENDERS, "gender")


def row_normalize(grid: DataFrame) -> DataFrame:
    """Cell over row sum, 0 for an empty row; the grid is labels x groups."""
    row = Window.partitionBy("label")
    return grid.withColumn("share", F.coalesce(
        F.try_divide(F.col("n_files").cast("double"), F.sum("n_files").over(row)), F.lit(0.0)))


# ---- people -------------------------------------------------------------

def demographics(people: DataFrame) -> DataFrame:
    """Per gender: age mean and deviation, size, class shares, share of all."""
    labelled = F.col("label").isin("normal", "abnormal")
    sizes = people.where(F.col("gender").isin("male", "female")).groupBy("gender").agg(
        F.avg("age").alias("mean_age"), F.stddev_samp("age").alias("std_age"),
        count_if(labelled).alias("n"), count_if(F.col("label") == "normal").alias("_normal"))
    total = sizes.agg(F.sum("n")).scalar()
    normal = F.try_divide(100.0 * F.col("_normal"), F.col("n"))
    return (
        sizes.withColumn("pct_normal", normal).withColumn("pct_abnormal", 100 - normal)
        .withColumn("pct_of_all", F.try_divide(100.0 * F.col("n"), total)).drop("_normal")
    )


def age_pyramid(people: DataFrame) -> DataFrame:
    """Recordings per gender, class and 5-year bin on [0, 100], 100 in the last."""
    ages = people.where(F.col("age").between(0, 100))
    slot = F.least(F.floor(F.col("age") / 5), F.lit(19)).cast("bigint")
    return ages.groupBy("gender", "label", slot.alias("age_bin")).agg(F.count("*").alias("n"))


def with_family(events: DataFrame, label: str = "label") -> DataFrame:
    return events.withColumn("family", label_family(F.col(label)))
