"""Queries of the event checks, statistics and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels as ch, taxonomy
from ..operators import events as ev, labels, linkage, statistics as st
from . import oracle_sql as o
from .registry import query, rounded, seconds

ORDER = taxonomy.COARSE_ORDER


def table(h):
    return ev.event_table(h.events(), h.headers())


def good(h):
    return table(h).where("valid_time").withColumn("merged", labels.merge_label(F.col("label")))


def families(h, dialect="ranged"):
    e = st.with_family(labels.clinical_label(h.events()))
    return ev.event_times(e, dialect, rollover=False)


# ---- the central table --------------------------------------------------


@query("event_table", f"""WITH {o.TABLE} SELECT event_id, file_id, split, fs AS file_start,
    start_time, end_time, round(start_ms / 1000, 6) AS start_sec, round(end_ms / 1000, 6) AS end_sec,
    round(dur_ms / 1000, 6) AS duration_sec, trim(coalesce(comment, 'nan')) AS label_raw, label,
    array_to_string(chans, ' ') AS channels, valid_time FROM ev""")
def _(h):
    t = table(h).select(
        "event_id", "file_id", "split", "file_start", "start_time", "end_time",
        F.col("start_ms").alias("start_sec"), F.col("end_ms").alias("end_sec"),
        F.col("dur_ms").alias("duration_sec"), "label_raw", "label",
        F.array_join("channels", " ").alias("channels"), "valid_time")
    return seconds(t, "start_sec", "end_sec", "duration_sec")


@query("attach_headers", f"""WITH {o.EVENTS} SELECT event_id, e.file_id, h.split, h.dur_ms AS edf_ms,
    CASE WHEN h.file_id IS NULL THEN 'csv_without_readable_edf' ELSE 'ok' END AS status
    FROM h_events e LEFT JOIN h_headers h ON e.file_id = h.file_id""")
def _(h):
    return ev.attach_headers(h.events(), h.headers()).select(
        "event_id", "file_id", "split", "edf_ms", "status")


_RENAMED = """SELECT CASE WHEN user_id % 9 = 4 THEN concat(file_id, '-lost') ELSE file_id END AS file_id FROM h_events"""


def _renamed(h):
    """Events of which some belong to recordings that no header names."""
    return h.events().withColumn("file_id", F.when(
        F.col("user_id") % 9 == 4, F.concat("file_id", F.lit("-lost"))).otherwise(F.col("file_id")))


@query("edf_csv_mapping", f"""WITH {o.EVENTS} SELECT coalesce(h.file_id, e.file_id) AS file_id,
    h.file_id IS NOT NULL AS has_readable_edf, e.file_id IS NOT NULL AS has_csv
    FROM (SELECT DISTINCT * FROM ({_RENAMED})) e
    FULL JOIN h_headers h ON e.file_id = h.file_id""")
def _(h):
    return linkage.edf_csv_mapping(h.headers(), _renamed(h))


@query("id_union", f"""WITH {o.EVENTS} SELECT file_id FROM h_headers UNION
    {_RENAMED}""")
def _(h):
    return h.headers().select("file_id").union(
        _renamed(h).select("file_id")).distinct()


@query("semi_processed", f"""WITH {o.EVENTS} SELECT event_id FROM h_events
    WHERE file_id IN (SELECT file_id FROM h_headers)""")
def _(h):
    return linkage.semi_processed(h.events(), h.headers()).select("event_id")


@query("missing_annotations", f"""WITH {o.EVENTS}, {o.PEOPLE} SELECT file_id, row_no FROM h_people
    WHERE label = 'abnormal' AND file_id NOT IN (SELECT file_id FROM h_events)""")
def _(h):
    return linkage.missing_annotations(h.people(), h.events()).select("file_id", "row_no")


@query("annotation_file_summary", f"""WITH {o.TABLE} SELECT file_id, split,
    round(max(edf_ms) / 60000, 6) AS edf_duration_min, count(*) AS n_events,
    count(*) FILTER (valid_time) AS n_valid_events,
    round(count(*) FILTER (valid_time) / greatest(max(edf_ms) / 60000, 1e-9), 6) AS event_density_per_min,
    count(*) FILTER (NOT valid_time) AS n_rows_invalid_time,
    count(*) FILTER (len(list_filter(chans, lambda c: c NOT IN {o.in_list(ch.EXPECTED_22)})) > 0)
      AS n_rows_invalid_channels,
    count(*) FILTER (len(list_filter(chans, lambda c: NOT list_contains(edf_channels, c))) > 0)
      AS n_rows_channels_missing_in_edf,
    round(quantile_cont(dur_ms, 0.25) FILTER (valid_time) / 1000, 6) AS p25_sec,
    round(quantile_cont(dur_ms, 0.5) FILTER (valid_time) / 1000, 6) AS median_sec,
    round(quantile_cont(dur_ms, 0.75) FILTER (valid_time) / 1000, 6) AS p75_sec
    FROM ev GROUP BY file_id, split""")
def _(h):
    s = ev.file_summary(table(h))
    for p in ("p25", "median", "p75"):
        s = s.withColumnRenamed(f"{p}_ms", f"{p}_sec")
    return rounded(seconds(s, "p25_sec", "median_sec", "p75_sec"),
                   "edf_duration_min", "event_density_per_min")


@query("annotation_file_status", f"""WITH {o.EVENTS}, s AS (SELECT DISTINCT file_id FROM h_events)
    SELECT s.file_id, CASE WHEN h.file_id IS NULL THEN 'csv_without_readable_edf' ELSE 'ok' END
      AS status, count(e.event_id) AS n_events
    FROM s JOIN h_events e ON e.file_id = s.file_id LEFT JOIN h_headers h ON h.file_id = s.file_id
    GROUP BY ALL""")
def _(h):
    return ev.attach_headers(h.events(), h.headers()).groupBy("file_id", "status").agg(
        F.count("*").alias("n_events"))


@query("dominant_reason", f"""WITH {o.TABLE}, c AS (SELECT file_id, invalid_reason, count(*) AS n
    FROM bad GROUP BY ALL) SELECT file_id, invalid_reason AS dominant_reason, n AS dominant_count
    FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, invalid_reason) = 1""")
def _(h):
    return ev.dominant_reason(table(h))


@query("reason_report", f"""WITH {o.TABLE}, c AS (SELECT file_id, invalid_reason, count(*) AS n
    FROM bad GROUP BY file_id, invalid_reason)
    SELECT file_id, (sum(n) OVER (PARTITION BY file_id))::bigint AS n_invalid_rows,
    invalid_reason AS dominant_reason, n AS dominant_count FROM c
    QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, invalid_reason) = 1""")
def _(h):
    return ev.reason_report(table(h))


@query("missing_time_columns", f"""WITH {o.TABLE} SELECT count(*) AS n_rows,
    count(*) FILTER (fs IS NULL) AS null_file_start,
    count(*) FILTER (start_time IS NULL) AS null_start_time,
    count(*) FILTER (end_time IS NULL) AS null_end_time FROM bad WHERE invalid_reason = 'other'""")
def _(h):
    return ev.missing_time_columns(table(h), ("file_start", "start_time", "end_time"))


@query("excess_seconds", f"""WITH {o.TABLE}, x AS (SELECT end_ms - edf_ms AS v FROM bad
      WHERE invalid_reason = 'end_exceeds_edf')
    SELECT count(*) AS n, round(avg(v) / 1000, 6) AS mean, round(stddev_samp(v) / 1000, 6) AS std,
    round(min(v) / 1000, 6) AS min, round(quantile_cont(v, 0.25) / 1000, 6) AS p25,
    round(quantile_cont(v, 0.5) / 1000, 6) AS p50, round(quantile_cont(v, 0.75) / 1000, 6) AS p75,
    round(max(v) / 1000, 6) AS max FROM x""")
def _(h):
    d = st.describe_numeric(ev.excess_seconds(table(h)), {"excess_ms": 1000})
    return seconds(d.drop("column"), "mean", "std", "min", "p25", "p50", "p75", "max")


@query("top_excess", f"""WITH {o.TABLE} SELECT event_id, file_id, label,
    round((end_ms - edf_ms) / 1000, 6) AS excess_sec FROM bad
    WHERE invalid_reason = 'end_exceeds_edf' ORDER BY end_ms - edf_ms DESC, event_id LIMIT 30""")
def _(h):
    top = st.top_k(ev.excess_seconds(table(h)), 30, "excess_ms", ("event_id",))
    return seconds(top.select("event_id", "file_id", "label",
                              F.col("excess_ms").alias("excess_sec")), "excess_sec")


@query("channel_event_counts", f"""WITH {o.TABLE}, c AS (SELECT unnest(chans) AS channel FROM ev
    WHERE valid_time) SELECT channel, count(*) AS n FROM c
    WHERE channel IN {o.in_list(ch.EXPECTED_22)} GROUP BY channel""")
def _(h):
    return ev.channel_event_counts(table(h))


# ---- check tables -------------------------------------------------------

_LOOSE = f"""{o.PREP}, raw AS (SELECT p.*, {o.t1('file_start')} AS f0,
      {o.channels('channel_names', 'wrapped')} AS wrapped FROM prep p),
  chk AS (SELECT *, coalesce(({o.roll('s_clock', 'f0')}) < ({o.roll('e_clock', 'f0')}), false) AS ok_time,
      len(wrapped) > 0 AND len(list_filter(wrapped, lambda c: c NOT IN {o.in_list(ch.EXPECTED_22)})) = 0
        AS ok_channels,
      label IN {o.in_list(taxonomy.EVENT_LABELS)} AS ok_label FROM raw)"""


@query("event_check_table", f"""WITH {_LOOSE} SELECT count(DISTINCT file_id) AS annotated_files,
    count(*) AS total_events, count(*) FILTER (ok_time) AS ok_time,
    count(*) FILTER (ok_channels) AS ok_channels, count(*) FILTER (ok_label) AS ok_label,
    0::bigint AS empty_files FROM chk""")
def _(h):
    return ev.check_table(ev.checked_events(h.events()))


@query("first_failures", f"""WITH {_LOOSE}, f AS (
      SELECT 'time' AS "check", * FROM chk WHERE NOT ok_time UNION ALL
      SELECT 'channels', * FROM chk WHERE NOT ok_channels UNION ALL
      SELECT 'label', * FROM chk WHERE NOT ok_label),
    r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY file_id, row_no) AS failure_no
      FROM f)
    SELECT "check", failure_no, file_id, row_no, file_start, start_time, end_time, channel_names,
    comment, label FROM r WHERE failure_no <= 10""")
def _(h):
    return ev.first_failures(ev.checked_events(h.events()))


_STRICT = f"""{o.EVENTS}, d(key, lab) AS ({o.lookup(taxonomy.IDENTITY)}), chk AS (SELECT e.*,
    {o.t3('start_time')} >= 0 AND {o.t3('end_time')} >= 0
      AND {o.t3('end_time')} > {o.t3('start_time')} AS ok_time,
    len({o.channels('channel_names', 'unquoted')}) > 0 AND len(list_filter(
      {o.channels('channel_names', 'unquoted')}, lambda c: c NOT IN {o.in_list(ch.SCALP_19)})) = 0
      AS ok_channels, d.lab IS NOT NULL AS ok_label
    FROM h_events e JOIN h_headers h ON h.file_id = e.file_id AND h.label = 'abnormal'
    LEFT JOIN d ON d.key = {o.key_audit('e.comment')})"""


@query("event_check_table_strict", f"""WITH {_STRICT} SELECT count(DISTINCT file_id)
    AS annotated_files, count(*) AS total_events, count(*) FILTER (ok_time) AS ok_time,
    count(*) FILTER (ok_channels) AS ok_channels, count(*) FILTER (ok_label) AS ok_label,
    0::bigint AS empty_files FROM chk""")
def _(h):
    abnormal = h.headers().where("label = 'abnormal'")
    return ev.check_table(ev.checked_events_strict(linkage.semi_processed(h.events(), abnormal)))


_ALLOWED = o.in_list(taxonomy.CLINICAL_ORDER)


@query("allowed_label_check", f"""WITH {o.EVENTS}, t AS (SELECT trim(coalesce(comment, 'nan')) AS c
    FROM h_events) SELECT count(*) AS total_rows, count(*) FILTER (c IN {_ALLOWED}) AS valid_rows,
    count(*) FILTER (c NOT IN {_ALLOWED}) AS invalid_rows FROM t""")
def _(h):
    return ev.allowed_label_check(h.events())


@query("disallowed_labels", f"""WITH {o.EVENTS}, t AS (SELECT trim(coalesce(comment, 'nan')) AS label
    FROM h_events) SELECT label, count(*) AS n FROM t WHERE label NOT IN {_ALLOWED} GROUP BY label""")
def _(h):
    return ev.disallowed_labels(h.events())


_TEN = o.in_list(taxonomy.EVENT_LABELS)
_WORDS = f"""{o.PREP}, words AS (SELECT comment, label, count(*) AS n FROM prep
    WHERE comment IS NOT NULL GROUP BY ALL)"""


@query("mapping_audit", f"""WITH {_WORDS} SELECT sum(n)::bigint AS total_event_rows,
    (sum(n) FILTER (label IN {_TEN}))::bigint AS mapped_event_rows, count(*) AS unique_raw,
    count(*) FILTER (label IN {_TEN}) AS mapped_unique_raw,
    round(count(*) FILTER (label IN {_TEN}) / count(*), 6) AS frac_mapped_unique,
    round(sum(n) FILTER (label IN {_TEN}) / sum(n), 6) AS frac_mapped_rows FROM words""")
def _(h):
    return rounded(ev.mapping_audit(h.events()), "frac_mapped_unique", "frac_mapped_rows")


@query("unmapped_labels", f"""WITH {_WORDS} SELECT comment AS raw_comment, n,
    {o.key_audit('comment')} AS normalized, label AS mapped_canonical FROM words
    WHERE label NOT IN {_TEN}""")
def _(h):
    return ev.unmapped_labels(h.events())


# ---- counts and durations ----------------------------------------------


@query("label_counts", f"""WITH {o.GOOD} SELECT 'canonical' AS kind, label, count(*) AS n FROM good
    GROUP BY label UNION ALL SELECT 'merged', merged, count(*) FROM good GROUP BY merged
    UNION ALL SELECT 'raw', comment, count(*) FROM good WHERE comment IS NOT NULL GROUP BY comment""")
def _(h):
    g = good(h)
    # one pass over the events for all three label kinds
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label"))
                      for k, c in (("canonical", "label"), ("merged", "merged"), ("raw", "comment"))])
    each = g.select(F.explode(kinds).alias("x")).select("x.*").where("label IS NOT NULL")
    return each.groupBy("kind", "label").agg(F.count("*").alias("n"))


@query("top_labels", f"""WITH {o.EVENTS} SELECT comment AS label, count(*) AS n FROM h_events
    WHERE comment IS NOT NULL GROUP BY comment ORDER BY n DESC, comment LIMIT 20""")
def _(h):
    return st.top_k(st.label_counts(h.events(), "comment"), 20)


@query("label_event_file_counts", f"""WITH {o.PREP}, dim(label, ord) AS ({o.order_dim(ORDER)}),
    m AS (SELECT file_id, {o.coarse('label')} AS label FROM prep)
    SELECT dim.label, dim.ord, count(m.file_id) AS event_count,
    count(DISTINCT m.file_id) AS file_count FROM dim LEFT JOIN m ON m.label = dim.label
    GROUP BY ALL""")
def _(h):
    e = labels.map_label(h.events()).withColumn("merged", labels.merge_label(F.col("label")))
    return st.label_event_file_counts(e, "merged", ORDER)


@query("duration_stats", f"""WITH {o.GOOD} SELECT merged AS label, count(*) AS n,
    round(avg(dur_ms) / 1000, 6) AS mean, round(median(dur_ms) / 1000, 6) AS median,
    round(stddev_samp(dur_ms) / 1000, 6) AS std, round(min(dur_ms) / 1000, 6) AS min,
    round(max(dur_ms) / 1000, 6) AS max FROM good GROUP BY merged""")
def _(h):
    s = st.duration_stats(good(h), ["merged"]).withColumnRenamed("merged", "label")
    return seconds(s, "mean", "median", "std", "min", "max")


_P = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_PSQL = ", ".join(f"round(quantile_cont(dur_ms, {p}) / 1000, 6) AS {n}" for n, p in _P.items())


@query("duration_percentiles", f"""WITH {o.GOOD} SELECT 'all' AS label, count(*) AS n, {_PSQL} FROM good
    UNION ALL SELECT merged, count(*), {_PSQL} FROM good GROUP BY merged""")
def _(h):
    # every event counts once for its label and once for the whole
    g = good(h).withColumn("group", F.explode(F.array(F.lit("all"), "merged")))
    return seconds(st.duration_percentiles(g, ["group"]).withColumnRenamed("group", "label"), *_P)


_Q = ", ".join(f"round(quantile_cont(dur_ms, {p}) / 1000, 6) AS {n}"
               for n, p in st.QUARTILES.items())


@query("duration_median_iqr", f"""WITH {o.GOOD}, top AS (SELECT label FROM good GROUP BY label
    ORDER BY count(*) DESC, label LIMIT 8) SELECT label, count(*) AS n, {_Q} FROM good
    WHERE label IN (SELECT label FROM top) GROUP BY label""")
def _(h):
    return seconds(st.duration_median_iqr(good(h), "label", 8), *st.QUARTILES)


@query("family_durations", f"""WITH {o.FAMILY}, d AS (SELECT family, round(e4 - s4)::bigint AS dur_ms
    FROM fam WHERE e4 > s4) SELECT 'All' AS "group", count(*) AS n, {_Q} FROM d UNION ALL
    SELECT family, count(*), {_Q} FROM d WHERE family <> 'Other' GROUP BY family""")
def _(h):
    e = families(h).where("dur_ms > 0").withColumn("dur_ms", F.round("dur_ms").cast("bigint"))
    return seconds(st.family_durations(e), *st.QUARTILES)


@query("family_counts", f"""WITH {o.FAMILY}, dim(label, ord) AS ({o.order_dim(taxonomy.FAMILIES)})
    SELECT dim.label, dim.ord, count(fam.event_id) AS n FROM dim
    LEFT JOIN fam ON fam.family = dim.label GROUP BY ALL""")
def _(h):
    return st.family_counts(st.with_family(labels.clinical_label(h.events())))


@query("label_share", f"""WITH {o.FAMILY}, dim(label, ord) AS ({o.order_dim(taxonomy.CLINICAL_ORDER)})
    SELECT dim.label, dim.ord, count(rel.event_id) AS n,
    round(100 * count(rel.event_id) / (SELECT count(*) FROM rel), 6) AS pct FROM dim
    LEFT JOIN rel ON rel.label = dim.label GROUP BY ALL""")
def _(h):
    return rounded(st.label_share(labels.clinical_label(h.events()), "label",
                                  taxonomy.CLINICAL_ORDER), "pct")


@query("events_per_file", f"""WITH {o.GOOD} SELECT file_id, count(*) AS n_events FROM good
    GROUP BY file_id""")
def _(h):
    return st.events_per_file(good(h))


@query("events_per_file_label", f"""WITH {o.GOOD} SELECT file_id, merged, count(*) AS n_events
    FROM good GROUP BY file_id, merged""")
def _(h):
    return st.events_per_file(good(h), "merged")


@query("event_burden", f"""WITH {o.EVENTS}, c AS (SELECT count(*) AS n FROM h_events GROUP BY file_id)
    SELECT count(*) AS n_files, round(quantile_cont(n, 0.25), 6) AS q1,
    round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3 FROM c""")
def _(h):
    return rounded(st.event_burden(h.events()), *st.QUARTILES)


@query("event_density", f"""WITH {o.EVENTS} SELECT h.file_id, count(*) AS n_events, h.dur_ms,
    round(count(*) / (h.dur_ms / 60000), 6) AS events_per_min FROM h_events e
    JOIN h_headers h USING (file_id) GROUP BY h.file_id, h.dur_ms""")
def _(h):
    return rounded(st.event_density(h.events(), h.headers()), "events_per_min")


@query("describe_numeric", f"""WITH {o.EVENTS}, c AS (SELECT file_id, count(*) AS n_events FROM h_events
      GROUP BY file_id), l AS (SELECT 'n_events' AS "column", n_events::double AS v FROM c UNION ALL
      SELECT 'dur_ms', dur_ms::double FROM h_headers)
    SELECT "column", count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
    min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
    round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM l GROUP BY "column" """)
def _(h):
    c = st.events_per_file(h.events()).join(h.headers().select("file_id", "dur_ms"), "file_id",
                                            "full")
    return rounded(st.describe_numeric(c, {"n_events": 10, "dur_ms": 1000}),
                   "mean", "std", "p25", "p50", "p75")


@query("equal_width_histogram", f"""WITH {o.GOOD}, v AS (SELECT dur_ms / 1000 AS x FROM good),
    b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 80 AS w FROM v),
    c AS (SELECT least(floor((x - lo) / w), 79)::bigint AS bin, count(*) AS n FROM v, b GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * w, 6) AS bin_start, round(lo + (g.bin + 1) * w, 6) AS bin_end,
    coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, 80)) AS bin) g CROSS JOIN b
    LEFT JOIN c ON c.bin = g.bin""")
def _(h):
    x = good(h).select((F.col("dur_ms") / 1000).alias("x"))
    return rounded(st.equal_width_histogram(x, "x", 80), "bin_start", "bin_end")


@query("box_stats", f"""WITH {o.GOOD}, b AS (SELECT merged, count(*) AS n, quantile_cont(dur_ms, 0.25) AS a,
      quantile_cont(dur_ms, 0.5) AS m, quantile_cont(dur_ms, 0.75) AS c FROM good GROUP BY merged)
    SELECT b.merged AS label, n, round(a / 1000, 6) AS q1, round(m / 1000, 6) AS median,
    round(c / 1000, 6) AS q3,
    round(min(dur_ms) FILTER (dur_ms >= a - 1.5 * (c - a)) / 1000, 6) AS whisker_low,
    round(max(dur_ms) FILTER (dur_ms <= c + 1.5 * (c - a)) / 1000, 6) AS whisker_high
    FROM good JOIN b ON b.merged = good.merged GROUP BY b.merged, n, a, m, c""")
def _(h):
    b = st.box_stats(good(h), ["merged"], "dur_ms", 1000).withColumnRenamed("merged", "label")
    return seconds(b, *st.QUARTILES, "whisker_low", "whisker_high")


@query("union_parts", f"""WITH {o.GOOD} SELECT event_id, merged FROM good WHERE merged = 'Slowing'
    UNION ALL SELECT event_id, merged FROM good WHERE merged = 'Epileptiform'""")
def _(h):
    g = good(h).select("event_id", "merged")
    return g.where("merged = 'Slowing'").unionByName(g.where("merged = 'Epileptiform'"))


# ---- labels per recording ----------------------------------------------

_MERGED = f"{o.PREP}, mrg AS (SELECT DISTINCT file_id, {o.coarse('label')} AS label FROM prep), " \
          f"pres AS (SELECT * FROM mrg WHERE label <> 'Unknown'), " \
          f"dim(label, ord) AS ({o.order_dim(ORDER)})"


def masks(h):
    e = labels.map_label(h.events()).withColumn("merged", labels.merge_label(F.col("label")))
    return st.label_masks(e, "merged", ORDER)


@query("labels_per_file", f"""WITH {_MERGED}, c AS (SELECT file_id, count(*) AS num_labels FROM pres
    GROUP BY file_id) SELECT num_labels, count(*) AS n_files,
    round(100 * count(*) / (SELECT count(*) FROM c), 6) AS pct FROM c GROUP BY num_labels""")
def _(h):
    return rounded(st.labels_per_file(masks(h)), "pct")


@query("single_vs_multiple", f"""WITH {_MERGED}, c AS (SELECT file_id, count(*) AS k FROM pres
    GROUP BY file_id) SELECT count(*) AS n_files, count(*) FILTER (k = 1) AS single,
    count(*) FILTER (k > 1) AS multiple, round(100 * count(*) FILTER (k > 1) / count(*), 6)
    AS pct_multiple FROM c""")
def _(h):
    return rounded(st.single_vs_multiple(masks(h)), "pct_multiple")


@query("label_sets", f"""WITH {_MERGED} SELECT file_id, string_agg(label, '+' ORDER BY label) AS labels
    FROM pres GROUP BY file_id HAVING count(*) > 1""")
def _(h):
    return st.label_sets(masks(h), ORDER).withColumn("labels", F.array_join("labels", "+"))


_COLUMNS = ", ".join(
    f"(max(CASE WHEN label = {o.quoted(n)} THEN 1 ELSE 0 END))::bigint AS \"{n}\"" for n in ORDER)


@query("presence_matrix", f"WITH {_MERGED} SELECT file_id, {_COLUMNS} FROM pres GROUP BY file_id")
def _(h):
    return st.presence_matrix(masks(h), ORDER)


_PAIRS = f"""{_MERGED}, pairs AS (SELECT a.label AS label_a, b.label AS label_b, da.ord AS oa,
    db.ord AS ob, count(*) AS n_files FROM pres a JOIN pres b ON a.file_id = b.file_id
    JOIN dim da ON da.label = a.label JOIN dim db ON db.label = b.label
    WHERE a.label <> b.label GROUP BY ALL)"""


@query("label_cooccurrence", f"WITH {_PAIRS} SELECT label_a, label_b, n_files FROM pairs WHERE oa < ob")
def _(h):
    return st.label_cooccurrence(masks(h), ORDER)


@query("top_pairs", f"""WITH {_PAIRS} SELECT label_a, label_b, n_files FROM pairs WHERE oa < ob
    ORDER BY n_files DESC, label_a, label_b LIMIT 15""")
def _(h):
    return st.top_k(st.label_cooccurrence(masks(h), ORDER), 15, "n_files", ("label_a", "label_b"))


_CELLS = ", ".join(
    f"coalesce(sum(n_files) FILTER (label_b = {o.quoted(n)}), 0)::bigint AS \"{n}\"" for n in ORDER)


@query("cooccurrence_matrix", f"""WITH {_PAIRS} SELECT dim.label, dim.ord, {_CELLS} FROM dim
    LEFT JOIN pairs ON pairs.label_a = dim.label GROUP BY dim.label, dim.ord""")
def _(h):
    return st.cooccurrence_matrix(masks(h), ORDER)


@query("presence_demographics", f"""WITH {_MERGED}, {o.PEOPLE}, meta AS (SELECT DISTINCT file_id, age,
    gender FROM h_people) SELECT p.file_id, count(*) AS n_labels, m.age, m.gender FROM pres p
    LEFT JOIN meta m ON m.file_id = p.file_id GROUP BY ALL""")
def _(h):
    return st.presence_demographics(masks(h), h.people()).select(
        "file_id", st.n_labels("mask").alias("n_labels"), "age", "gender")


_WHO = f"""{_MERGED}, {o.PEOPLE}, meta AS (SELECT DISTINCT file_id, age, gender FROM h_people),
  who AS (SELECT p.label, CASE WHEN m.age <= 0 OR m.age > 120 THEN NULL WHEN m.age <= 10 THEN '0–10'
     WHEN m.age <= 20 THEN '11–20' WHEN m.age <= 30 THEN '21–30' WHEN m.age <= 40 THEN '31–40'
     WHEN m.age <= 50 THEN '41–50' WHEN m.age <= 60 THEN '51–60' WHEN m.age <= 70 THEN '61–70'
     WHEN m.age <= 120 THEN '70+' END AS age_group,
     CASE m.gender WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'x' THEN 'Other' END
       AS gender
     FROM pres p LEFT JOIN meta m ON m.file_id = p.file_id),
  ages(age_group, gord) AS ({o.order_dim([g[2] for g in st.AGE_GROUPS])}),
  genders(gender, gord) AS ({o.order_dim(st.GENDERS)}),
  by_age AS (SELECT d.label, a.age_group, d.ord AS label_ord, a.gord AS group_ord,
     count(w.label) AS n_files FROM dim d CROSS JOIN ages a
     LEFT JOIN who w ON w.label = d.label AND w.age_group = a.age_group GROUP BY ALL)"""


@query("label_by_age", f"WITH {_WHO} SELECT * FROM by_age")
def _(h):
    return st.label_by_age(st.presence_demographics(masks(h), h.people()), ORDER)


@query("label_by_gender", f"""WITH {_WHO} SELECT d.label, g.gender, d.ord AS label_ord,
    g.gord AS group_ord, count(w.label) AS n_files FROM dim d CROSS JOIN genders g
    LEFT JOIN who w ON w.label = d.label AND w.gender = g.gender GROUP BY ALL""")
def _(h):
    return st.label_by_gender(st.presence_demographics(masks(h), h.people()), ORDER)


@query("row_normalize", f"""WITH {_WHO} SELECT label, age_group, round(CASE WHEN sum(n_files)
    OVER (PARTITION BY label) = 0 THEN 0 ELSE n_files / sum(n_files) OVER (PARTITION BY label) END, 6)
    AS share FROM by_age""")
def _(h):
    grid = st.label_by_age(st.presence_demographics(masks(h), h.people()), ORDER)
    return rounded(st.row_normalize(grid), "share").select("label", "age_group", "share")


# ---- people -------------------------------------------------------------


@query("demographics", f"""WITH {o.PEOPLE}, g AS (SELECT gender, avg(age) AS ma, stddev_samp(age) AS sa,
      count(*) AS n, count(*) FILTER (label = 'normal') AS k FROM h_people
      WHERE gender IN ('male', 'female') GROUP BY gender)
    SELECT gender, round(ma, 6) AS mean_age, round(sa, 6) AS std_age, n,
    round(100 * k / n, 6) AS pct_normal, round(100 - 100 * k / n, 6) AS pct_abnormal,
    round(100 * n / sum(n) OVER (), 6) AS pct_of_all FROM g""")
def _(h):
    return rounded(st.demographics(h.people()), "mean_age", "std_age", "pct_normal",
                   "pct_abnormal", "pct_of_all")


@query("age_pyramid", f"""WITH {o.PEOPLE} SELECT gender, label, least(floor(age / 5), 19)::bigint AS age_bin,
    count(*) AS n FROM h_people WHERE age >= 0 AND age <= 100 AND gender IN ('male', 'female')
    GROUP BY ALL""")
def _(h):
    return st.age_pyramid(h.people().where("gender IN ('male', 'female')"))


@query("recording_length_histogram", f"""WITH {o.PEOPLE}, v AS (SELECT try_cast(minutes AS double) AS x
      FROM h_people WHERE try_cast(minutes AS double) IS NOT NULL),
    b AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS w FROM v),
    c AS (SELECT least(floor((x - lo) / w), 29)::bigint AS bin, count(*) AS n FROM v, b GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * w, 6) AS bin_start, round(lo + (g.bin + 1) * w, 6) AS bin_end,
    coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, 30)) AS bin) g CROSS JOIN b
    LEFT JOIN c ON c.bin = g.bin""")
def _(h):
    from ..sources.tables import coerce_numeric
    return rounded(st.equal_width_histogram(coerce_numeric(h.people(), "minutes"), "minutes", 30),
                   "bin_start", "bin_end")


@query("run_mean_std", f"""WITH {o.SCORES}, r AS (SELECT input_len % 3 AS model, input_len AS run,
      avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS acc FROM h_scores GROUP BY ALL)
    SELECT model, count(*) AS n_runs, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std
    FROM r GROUP BY model""")
def _(h):
    runs = h.scores().groupBy((F.col("input_len") % 3).alias("model"),
                              F.col("input_len").alias("run")).agg(
        F.avg(F.when(F.col("y") == F.col("pred"), 1.0).otherwise(0.0)).alias("acc"))
    return rounded(st.run_mean_std(runs, "model", "acc"), "mean", "std")
