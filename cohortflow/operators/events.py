"""Annotated events: clocks against recording headers, reasons and checks.

Raw events:  ``file_id, row_no, file_start, start_time, end_time,
channel_names, comment``. Headers: ``file_id, split, sfreq, dur_ms, channels``
(array of normalised names). Times stay integer milliseconds until reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import channels as ch, taxonomy
from ..functions.binding import computed_once
from ..functions.clock import clock_ms, ms_since_start
from ..functions.text import strip
from . import labels
from .ranking import carry_forward, exact_percentiles

TOLERANCE_MS = 1

# Names of the reasons and issues.
REASONS = ("parse_failed_or_missing_time", "end_before_or_equal_start",
           "negative_time", "end_exceeds_edf", "other")
ISSUES = ("Still Parsing Error (Should be 0)", "Negative Duration (End <= Start)",
          "Event Exceeds EDF Duration", "Invalid Channel Names: ",
          "Channel Missing in EDF: ", "OK")


def count_if(cond: Column) -> Column:
    """Rows where ``cond`` holds; 0 rather than null for none."""
    return F.count(F.when(cond, 1))


def ffill_file_start(events: DataFrame) -> DataFrame:
    return carry_forward(events, "file_id", "row_no", "file_start")


def event_times(events: DataFrame, dialect: str = "strict", rollover: bool = True) -> DataFrame:
    """Add ``start_ms, end_ms, dur_ms``, from the file start or as plain clocks."""
    clocks = {"start_ms": clock_ms(F.col("start_time"), dialect),
              "end_ms": clock_ms(F.col("end_time"), dialect)}
    if rollover:
        clocks["_origin"] = clock_ms(F.col("file_start"))
    timed = computed_once(events, clocks)
    if rollover:
        origin = F.col("_origin")
        timed = timed.withColumns({
            "start_ms": ms_since_start(origin, F.col("start_ms")),
            "end_ms": ms_since_start(origin, F.col("end_ms"))}).drop("_origin")
    return timed.withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))


def prepare_events(events: DataFrame, vocabulary: str = "audit",
                   lookup: DataFrame | None = None) -> DataFrame:
    """Filled file start, times from it, channel list, raw and canonical label."""
    filled = event_times(ffill_file_start(events))
    listed = filled.withColumn("channels", ch.parse_channels(F.col("channel_names")))
    raw = listed.withColumn("label_raw", strip(F.coalesce("comment", F.lit("nan"))))
    return labels.map_label(raw, "label_raw", vocabulary, lookup)


def attach_headers(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Left join to readable recordings; events of other files get a status."""
    right = headers.select("file_id", "split", F.col("dur_ms").alias("edf_ms"),
                           F.col("channels").alias("edf_channels"), F.lit(True).alias("_found"))
    return (
        events.join(right, "file_id", "left")
        .withColumn("status", F.when(F.col("_found"), "ok")
                    .otherwise("csv_without_readable_edf"))
        .drop("_found")
    )


def valid_time() -> Column:
    start, end = F.col("start_ms"), F.col("end_ms")
    ok = ((start >= 0) & (end <= F.col("edf_ms") + TOLERANCE_MS) & (end - start > 0))
    return F.coalesce(ok, F.lit(False))


def channel_checks(events: DataFrame, vocab=ch.EXPECTED_22) -> DataFrame:
    names = F.col("channels")
    return (
        events.withColumn("invalid_channels", ch.not_in(names, ch.vocabulary(vocab)))
        .withColumn("missing_in_edf", ch.not_in(names, F.col("edf_channels")))
    )


def event_table(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Events of readable recordings with times, labels, validity and checks."""
    joined = attach_headers(prepare_events(events), headers)
    return channel_checks(joined.where("status = 'ok'")).withColumn("valid_time", valid_time())


def invalid_reason() -> Column:
    """First reason that holds for a row that is not valid."""
    start, end = F.col("start_ms"), F.col("end_ms")
    return (
        F.when(start.isNull() | end.isNull(), REASONS[0])
        .when(end <= start, REASONS[1])
        .when((start < 0) | (end < 0), REASONS[2])
        .when(end > F.col("edf_ms"), REASONS[3])
        .otherwise(REASONS[4])
    )


def detailed_issue() -> Column:
    """First issue of any row, with the offending channels in its text."""
    def listed(prefix, col):
        body = F.concat(F.lit("['"), F.array_join(col, "', '"), F.lit("']"))
        return F.concat(F.lit(prefix), body)

    start, end = F.col("start_ms"), F.col("end_ms")
    bad, gone = F.col("invalid_channels"), F.col("missing_in_edf")
    return (
        F.when(start.isNull() | end.isNull(), ISSUES[0])
        .when(end <= start, ISSUES[1])
        .when(end > F.col("edf_ms"), ISSUES[2])
        .when(F.size(bad) > 0, listed(ISSUES[3], bad))
        .when(F.size(gone) > 0, listed(ISSUES[4], gone))
        .otherwise(ISSUES[5])
    )


def issue_examples(table: DataFrame) -> DataFrame:
    """Row count and the first file of every issue other than OK."""
    return (
        table.withColumn("issue", detailed_issue()).where(F.col("issue") != ISSUES[5])
        .groupBy("issue")
        .agg(F.count("*").alias("n_rows"), F.min_by("file_id", "row_no").alias("file_id"))
    )


def invalid_rows(table: DataFrame) -> DataFrame:
    return table.where(~F.col("valid_time")).withColumn("invalid_reason", invalid_reason())


def reason_report(table: DataFrame) -> DataFrame:
    """Invalid rows per file beside the dominant reason, in one aggregation."""
    counts = invalid_rows(table).groupBy("file_id", "invalid_reason").agg(
        F.count("*").alias("n"))
    # at most one row per reason and file from here on
    first = F.struct(-F.col("n"), F.col("invalid_reason"))
    return counts.groupBy("file_id").agg(
        F.sum("n").alias("n_invalid_rows"), F.min_by("invalid_reason", first).alias("dominant_reason"),
        F.max("n").alias("dominant_count"))


def dominant_reason(table: DataFrame) -> DataFrame:
    """Most frequent reason per file; a tie goes to the smaller name."""
    return reason_report(table).drop("n_invalid_rows")


def file_summary(table: DataFrame) -> DataFrame:
    """One row per recording: counts, density, duration quartiles, failing rows.

    The counts ride on the histogram of the durations, so the event table is built once.
    """
    good, one = F.col("valid_time"), F.lit(1).cast("bigint")
    rows = lambda cond: (F.sum, F.when(cond, one).otherwise(0))
    named = table.withColumn("_valid_ms", F.when(good, F.col("dur_ms")))
    s = exact_percentiles(
        named, ["file_id", "split"], "_valid_ms", {"p25_ms": 0.25, "median_ms": 0.5, "p75_ms": 0.75}, width=1000,
        count="n_valid_events", totals={
            "edf_ms": (F.max, F.col("edf_ms")), "n_events": (F.sum, one), "n_rows_invalid_time": rows(~good),
            "n_rows_invalid_channels": rows(F.size("invalid_channels") > 0),
            "n_rows_channels_missing_in_edf": rows(F.size("missing_in_edf") > 0)})
    minutes = F.col("edf_ms") / 60000
    return s.select(
        "file_id", "split", minutes.alias("edf_duration_min"), "n_events", "n_valid_events",
        (F.col("n_valid_events") / F.greatest(minutes, F.lit(1e-9))).alias("event_density_per_min"), "n_rows_invalid_time",
        "n_rows_invalid_channels", "n_rows_channels_missing_in_edf", "p25_ms", "median_ms", "p75_ms")


def excess_seconds(table: DataFrame) -> DataFrame:
    """Events past the end of the recording and by how much."""
    return (
        invalid_rows(table).where(F.col("invalid_reason") == REASONS[3])
        .withColumn("excess_ms", F.col("end_ms") - F.col("edf_ms"))
    )


def missing_time_columns(table: DataFrame, columns) -> DataFrame:
    """Null counts per column among the rows of reason ``other``."""
    other = invalid_rows(table).where(F.col("invalid_reason") == REASONS[4])
    return other.agg(F.count("*").alias("n_rows"),
                     *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def channel_event_counts(table: DataFrame, vocab=ch.EXPECTED_22) -> DataFrame:
    """Mentions of each known channel in valid events; repeats count."""
    return (
        table.where("valid_time").select(F.explode("channels").alias("channel"))
        .where(F.col("channel").isin(*vocab))
        .groupBy("channel").agg(F.count("*").alias("n"))
    )


# ---- check tables -------------------------------------------------------

def checked_events(events: DataFrame) -> DataFrame:
    """Loose variant: no fill of the file start, 22 channels, ten event labels."""
    timed = event_times(events)
    named = timed.withColumn("channels", ch.parse_channels(F.col("channel_names"), "wrapped"))
    mapped = labels.map_label(named)
    start, end = F.col("start_ms"), F.col("end_ms")
    known = F.size(ch.not_in(F.col("channels"), ch.vocabulary(ch.EXPECTED_22))) == 0
    return (
        mapped.withColumn("ok_time", F.coalesce((start < end) & (start >= 0), F.lit(False)))
        .withColumn("ok_channels", (F.size("channels") > 0) & known)
        .withColumn("ok_label", F.col("label").isin(*taxonomy.EVENT_LABELS))
    )


def checked_events_strict(events: DataFrame) -> DataFrame:
    """Strict variant: plain clocks, 19 channels, the twelve clinical names."""
    timed = event_times(events, "sentinel", rollover=False)
    named = timed.withColumn("channels", ch.parse_channels(F.col("channel_names"), "unquoted"))
    mapped = labels.map_label(named, vocabulary="identity")
    start, end = F.col("start_ms"), F.col("end_ms")
    known = F.size(ch.not_in(F.col("channels"), ch.vocabulary(ch.SCALP_19))) == 0
    return (
        mapped.withColumn("ok_time", (start >= 0) & (end >= 0) & (end > start))
        .withColumn("ok_channels", (F.size("channels") > 0) & known)
        .withColumn("ok_label", F.col("label") != "Unknown")
    )


def check_table(checked: DataFrame, empty_files: DataFrame | None = None) -> DataFrame:
    """Files with events, and how many events pass each check.

    ``empty_files`` holds the ids of annotation files without any row.
    """
    # distinct files through a combined aggregation, not one set in one task
    per_file = checked.groupBy("file_id").agg(
        F.count("*").alias("n"),
        *[count_if(F.col(c)).alias(c) for c in ("ok_time", "ok_channels", "ok_label")])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    table = per_file.agg(
        F.count("*").alias("annotated_files"), zero("n").alias("total_events"),
        *[zero(c).alias(c) for c in ("ok_time", "ok_channels", "ok_label")])
    if empty_files is None:
        return table.withColumn("empty_files", F.lit(0).cast("bigint"))
    return table.withColumn("empty_files", empty_files.agg(F.count("*")).scalar())


def first_failures(checked: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` failing rows of every check in file and row order.

    The filter on the rank lets Spark keep only ``n`` rows per check and task
    before the shuffle.
    """
    names = ("time", "channels", "label")
    failed = F.filter(
        F.array(*[F.when(~F.col(f"ok_{c}"), F.lit(c)) for c in names]),
        lambda c: c.isNotNull())
    order = Window.partitionBy("check").orderBy("file_id", "row_no")
    return (
        checked.withColumn("check", F.explode(failed))
        .withColumn("failure_no", F.row_number().over(order))
        .where(F.col("failure_no") <= n)
        .select("check", F.col("failure_no").cast("bigint").alias("failure_no"), "file_id",
                "row_no", "file_start", "start_time", "end_time", "channel_names",
                "comment", "label")
    )


def allowed_label_check(events: DataFrame) -> DataFrame:
    """Rows whose trimmed comment is, or is not, one of the clinical names."""
    text = strip(F.coalesce("comment", F.lit("nan")))
    return events.agg(
        F.count("*").alias("total_rows"),
        count_if(text.isin(*taxonomy.CLINICAL_ORDER)).alias("valid_rows"),
        count_if(~text.isin(*taxonomy.CLINICAL_ORDER)).alias("invalid_rows"))


def disallowed_labels(events: DataFrame) -> DataFrame:
    text = strip(F.coalesce("comment", F.lit("nan")))
    return (
        events.select(text.alias("label")).where(~F.col("label").isin(*taxonomy.CLINICAL_ORDER))
        .groupBy("label").agg(F.count("*").alias("n"))
    )


def mapping_audit(events: DataFrame) -> DataFrame:
    """How much of the free text the ten event labels cover, by row and by string."""
    # one row per distinct string first: every later count is over that small table
    words = events.where(F.col("comment").isNotNull()).groupBy("comment").agg(
        F.count("*").alias("n"))
    mapped = labels.map_label(words)
    hit = F.col("label").isin(*taxonomy.EVENT_LABELS)
    rows = F.coalesce(F.sum("n"), F.lit(0))
    hits = F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return mapped.agg(
        rows.cast("bigint").alias("total_event_rows"),
        hits.cast("bigint").alias("mapped_event_rows"),
        F.count("*").alias("unique_raw"),
        count_if(hit).alias("mapped_unique_raw"),
        share(count_if(hit), F.count("*")).alias("frac_mapped_unique"),
        share(hits, rows).alias("frac_mapped_rows"))


def unmapped_labels(events: DataFrame) -> DataFrame:
    """Raw strings outside the ten event labels with count, key and label."""
    words = events.where(F.col("comment").isNotNull()).groupBy("comment").agg(
        F.count("*").alias("n"))
    return (
        labels.map_label(words).where(~F.col("label").isin(*taxonomy.EVENT_LABELS))
        .select(F.col("comment").alias("raw_comment"), "n",
                labels.comment_key(F.col("comment")).alias("normalized"),
                F.col("label").alias("mapped_canonical"))
    )


def relabel_events(events: DataFrame) -> DataFrame:
    """The event table with its comments replaced by clinical labels."""
    return labels.clinical_label(events).withColumn("comment", F.col("label")).drop("label")
