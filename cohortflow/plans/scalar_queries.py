"""Queries of the column expressions and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels as ch, taxonomy, text
from ..functions.clock import clock_ms, parse_clock, seconds_since_start
from ..operators import events as ev, integrity, labels, linkage, statistics as st
from ..sources import edf, tables
from . import oracle_sql as o
from .pipelines import derive_manifest
from .registry import query, rounded, seconds

# ---- manifest texts -----------------------------------------------------


@query("clean_stem", f"WITH {o.MANIFEST} SELECT row_no, stem FROM man")
def _(h):
    return h.manifest().select("row_no", text.clean_stem(F.col("file_name")).alias("stem"))


@query("normalize_class", f"WITH {o.MANIFEST} SELECT row_no, label FROM man")
def _(h):
    return h.manifest().select("row_no", text.normalize_class(F.col("raw_label")).alias("label"))


@query("normalize_split", f"WITH {o.MANIFEST} SELECT row_no, split FROM man")
def _(h):
    return h.manifest().select("row_no", text.normalize_split(F.col("raw_split")).alias("split"))


@query("parse_source_year", f"WITH {o.MANIFEST} SELECT row_no, source, year FROM man2")
def _(h):
    return derive_manifest(h.manifest()).select("row_no", "source", "year")


@query("make_age", f"WITH {o.MANIFEST} SELECT row_no, age FROM man2")
def _(h):
    return h.manifest().select(
        "row_no", text.make_age(F.col("age_years"), F.col("age_months")).alias("age"))


@query("coerce_numeric", f"""WITH {o.PEOPLE} SELECT row_no, try_cast(minutes AS double) AS minutes
    FROM h_people WHERE try_cast(minutes AS double) IS NOT NULL""")
def _(h):
    return tables.coerce_numeric(h.people(), "minutes").select("row_no", "minutes")


@query("normalize_gender", f"""WITH {o.MANIFEST} SELECT row_no, CASE WHEN gender IS NULL
    THEN 'Unknown' WHEN lower(trim(gender)) IN ('m', 'male') THEN 'Male'
    WHEN lower(trim(gender)) IN ('f', 'female') THEN 'Female' ELSE 'Other' END AS gender
    FROM h_manifest""")
def _(h):
    return h.manifest().select("row_no", text.normalize_gender(F.col("gender")).alias("gender"))


@query("age_group", f"""WITH {o.PEOPLE} SELECT row_no, CASE WHEN age <= 0 OR age > 120 THEN NULL
    WHEN age <= 10 THEN '0–10' WHEN age <= 20 THEN '11–20' WHEN age <= 30 THEN '21–30'
    WHEN age <= 40 THEN '31–40' WHEN age <= 50 THEN '41–50' WHEN age <= 60 THEN '51–60'
    WHEN age <= 70 THEN '61–70' WHEN age <= 120 THEN '70+' END AS age_group FROM h_people""")
def _(h):
    return h.people().select("row_no", text.age_group(F.col("age")).alias("age_group"))


@query("recording_group", f"""WITH {o.FILES} SELECT path,
    CASE split_part(path, '/', 4) WHEN 'abnormal' THEN 'Abnormal' ELSE 'Normal' END AS "group",
    CASE split_part(path, '/', 3) WHEN 'train' THEN 'train' ELSE 'eval' END AS subset FROM inv""")
def _(h):
    return h.files().select("path", text.recording_group(F.col("path")).alias("group"),
                            text.recording_subset(F.col("path")).alias("subset"))


@query("release_folder", f"""WITH {o.RELEASE} SELECT row_no, k.modality, f.folder
    FROM man m CROSS JOIN (VALUES ('edf'), ('annotation'), ('report')) k(modality)
    LEFT JOIN folders f ON f.split = m.split AND f.label = m.label AND f.modality = k.modality""")
def _(h):
    each = derive_manifest(h.manifest()).withColumn(
        "modality", F.explode(F.array(*[F.lit(m) for m in linkage.FOLDER_NAMES])))
    return each.select("row_no", "modality", linkage.release_folder(
        F.col("split"), F.col("label"), F.col("modality")).alias("folder"))


# ---- clocks -------------------------------------------------------------


@query("parse_clock", f"""WITH c AS ({o.host(o.hosts.CLOCKS_SQL)}) SELECT event_id,
    {o.t1('clock')} AS strict_ms, {o.t2('clock')} AS loose_ms,
    round({o.t3('clock')}, 6) AS sentinel_ms, round(({o.t4('clock')})::double, 6) AS ranged_ms,
    {o.t5('clock')} AS dotted_ms, round(({o.t1('clock')}) / 1000, 6) AS strict_sec FROM c""")
def _(h):
    c = F.col("clock")
    return h.clocks().select(
        "event_id", clock_ms(c, "strict").alias("strict_ms"), clock_ms(c, "loose").alias("loose_ms"),
        F.round(clock_ms(c, "sentinel"), 6).alias("sentinel_ms"),
        F.round(clock_ms(c, "ranged"), 6).alias("ranged_ms"),
        clock_ms(c, "dotted").alias("dotted_ms"),
        F.round(parse_clock(c), 6).alias("strict_sec"))


@query("ffill_file_start", f"WITH {o.PREP} SELECT event_id, file_id, fs AS file_start FROM filled")
def _(h):
    return ev.ffill_file_start(h.events()).select("event_id", "file_id", "file_start")


@query("seconds_since_start", f"""WITH {o.PREP} SELECT event_id,
    round(start_ms / 1000, 6) AS start_sec, round(end_ms / 1000, 6) AS end_sec FROM prep""")
def _(h):
    e = ev.ffill_file_start(h.events())
    return e.select("event_id", *[
        F.round(seconds_since_start(F.col("file_start"), F.col(f"{n}_time")), 6).alias(f"{n}_sec")
        for n in ("start", "end")])


@query("event_duration", f"""WITH {o.PREP} SELECT event_id,
    round((end_ms - start_ms) / 1000, 6) AS rollover_sec,
    round((({o.t2('end_time')}) - ({o.t2('start_time')})) / 1000, 6) AS plain_sec FROM prep""")
def _(h):
    plain = clock_ms(F.col("end_time"), "loose") - clock_ms(F.col("start_time"), "loose")
    e = ev.event_times(ev.ffill_file_start(h.events()))
    return e.select("event_id", F.round(F.col("dur_ms") / 1000, 6).alias("rollover_sec"),
                    F.round(plain / 1000, 6).alias("plain_sec"))


@query("log1p_duration", f"""WITH {o.PREP} SELECT event_id, CASE WHEN end_ms >= start_ms
    THEN round(ln(1 + (end_ms - start_ms) / 1000), 6) END AS log_sec FROM prep""")
def _(h):
    e = ev.event_times(ev.ffill_file_start(h.events()))
    return e.select("event_id", F.round(
        text.log1p_duration(F.col("dur_ms") / 1000), 6).alias("log_sec"))


# ---- comments and labels ------------------------------------------------


@query("normalize_comment", f"""WITH {o.EVENTS} SELECT event_id, {o.key_full('comment')} AS full_key,
    {o.key_audit('comment')} AS audit_key, {o.key_clinical('comment')} AS clinical_key
    FROM h_events""")
def _(h):
    c = F.col("comment")
    return h.events().select("event_id", *[
        labels.comment_key(c, r).alias(f"{r}_key") for r in ("full", "audit", "clinical")])


@query("map_label", f"WITH {o.PREP} SELECT event_id, label FROM prep")
def _(h):
    return labels.map_label(h.events()).select("event_id", "label")


@query("map_label_from_table", f"""WITH {o.EVENTS}, w AS (
      SELECT DISTINCT {o.key_full('comment')} AS k FROM h_events),
    v AS (SELECT k, CASE WHEN contains(k, 'spike') THEN 'Spike and Wave'
            WHEN contains(k, 'delta') THEN 'Delta Slow Wave' END AS lab FROM w)
    SELECT event_id, coalesce(v.lab, 'Unknown') AS label FROM h_events e
    LEFT JOIN v ON v.k = {o.key_full('e.comment')} AND v.k <> ''""")
def _(h):
    # a vocabulary that is itself a table: the words of the events with a class
    e = h.events()
    word = F.lower("comment")
    table = e.select(F.col("comment").alias("variant"), F.when(
        word.contains("spike"), "Spike and Wave").when(
        word.contains("delta"), "Delta Slow Wave").alias("canonical")).where(
        "variant IS NOT NULL AND canonical IS NOT NULL").distinct()
    lookup = labels.label_lookup(h.spark, "full", table)
    return labels.map_label(e, vocabulary="full", lookup=lookup).select("event_id", "label")


@query("map_label_identity", f"""WITH {o.EVENTS}, d(key, lab) AS ({o.lookup(taxonomy.IDENTITY)})
    SELECT event_id, coalesce(d.lab, 'Unknown') AS label FROM h_events e
    LEFT JOIN d ON d.key = {o.key_audit('e.comment')}""")
def _(h):
    return labels.map_label(h.events(), vocabulary="identity").select("event_id", "label")


@query("clinical_label", f"WITH {o.FAMILY} SELECT event_id, label FROM rel")
def _(h):
    return labels.clinical_label(h.events()).select("event_id", "label")


@query("merge_label", f"WITH {o.PREP} SELECT event_id, {o.coarse('label')} AS merged FROM prep")
def _(h):
    return labels.map_label(h.events()).select(
        "event_id", labels.merge_label(F.col("label")).alias("merged"))


@query("label_family", f"WITH {o.FAMILY} SELECT event_id, family FROM fam")
def _(h):
    return st.with_family(labels.clinical_label(h.events())).select("event_id", "family")


@query("relabel_events", f"""WITH {o.FAMILY} SELECT event_id, file_id, row_no, file_start,
    start_time, end_time, channel_names, label AS comment FROM rel""")
def _(h):
    return ev.relabel_events(h.events()).select(
        "event_id", "file_id", "row_no", "file_start", "start_time", "end_time",
        "channel_names", "comment")


@query("relabel_tally", f"WITH {o.FAMILY} SELECT label, count(*) AS n FROM rel GROUP BY label")
def _(h):
    return st.label_counts(labels.clinical_label(h.events()), "label")


# ---- channels -----------------------------------------------------------


@query("norm_channel", f"""WITH {o.EVENTS} SELECT event_id,
    upper(replace(trim(channel_names), ' ', '')) AS name FROM h_events""")
def _(h):
    return h.events().select("event_id", ch.norm_channel(F.col("channel_names")).alias("name"))


@query("parse_channels", f"""WITH {o.EVENTS} SELECT event_id,
    array_to_string({o.channels('channel_names')}, '+') AS spaced,
    array_to_string({o.channels('channel_names', 'wrapped')}, '+') AS wrapped,
    array_to_string({o.channels('channel_names', 'unquoted')}, '+') AS unquoted FROM h_events""")
def _(h):
    return h.events().select("event_id", *[
        F.array_join(ch.parse_channels(F.col("channel_names"), d), "+").alias(d)
        for d in ("spaced", "wrapped", "unquoted")])


@query("channel_check", f"""WITH {o.TABLE} SELECT event_id,
    array_to_string(list_filter(chans, lambda c: c NOT IN {o.in_list(ch.EXPECTED_22)}), '+') AS invalid,
    array_to_string(list_filter(chans, lambda c: NOT list_contains(edf_channels, c)), '+') AS missing
    FROM ev""")
def _(h):
    t = ev.event_table(h.events(), h.headers())
    return t.select("event_id", F.array_join("invalid_channels", "+").alias("invalid"),
                    F.array_join("missing_in_edf", "+").alias("missing"))


_KNOWN = "[" + ", ".join(o.quoted(c) for c in ch.EXPECTED_22) + "]"
_INVENTORY = f"""h AS (SELECT *, string_split(channel_text, ' ') AS c FROM h_headers),
   d AS (SELECT *, list_sort(list_filter({_KNOWN}, lambda x: NOT list_contains(c, x))) AS miss,
     list_sort(list_filter(c, lambda x: NOT list_contains({_KNOWN}, x))) AS extra FROM h)"""


@query("channel_inventory", f"""WITH {o.EVENTS}, {_INVENTORY} SELECT file_id,
    len(c)::bigint AS n_channels, len(miss)::bigint AS missing_expected,
    len(extra)::bigint AS extra_channels, array_to_string(miss, ' ') AS missing_list,
    array_to_string(extra, ' ') AS extra_list FROM d""")
def _(h):
    return edf.channel_inventory(h.headers()).select(
        "file_id", "n_channels", "missing_expected", "extra_channels", "missing_list",
        "extra_list")


@query("channel_set_diff", f"""WITH {o.EVENTS}, h AS (SELECT *,
      string_split(channel_text, ' ') AS c FROM h_headers)
    SELECT file_id, array_to_string(list_sort(list_filter(
      [{', '.join(o.quoted(c) for c in ch.SCALP_19)}], lambda x: NOT list_contains(c, x))), ' ') AS missing
    FROM h""")
def _(h):
    diff = F.array_except(ch.vocabulary(ch.SCALP_19), "channels")
    return h.headers().select("file_id", F.array_join(F.array_sort(diff), " ").alias("missing"))


@query("worst_channels", f"""WITH {o.EVENTS}, {_INVENTORY} SELECT split, file_id, sfreq,
    len(c)::bigint AS n_channels, len(miss)::bigint AS missing_expected,
    len(extra)::bigint AS extra_channels FROM d ORDER BY len(miss) DESC, file_id LIMIT 10""")
def _(h):
    return edf.worst_channels(edf.channel_inventory(h.headers()), 10).select(
        "split", "file_id", "sfreq", "n_channels", "missing_expected", "extra_channels")


@query("edf_inventory_counts", f"""WITH {o.EVENTS}
    SELECT 'split' AS kind, split AS value, count(*) AS n FROM h_headers GROUP BY split
    UNION ALL SELECT 'sfreq', cast(cast(sfreq AS bigint) AS varchar), count(*) FROM h_headers
    GROUP BY sfreq""")
def _(h):
    heads = h.headers()
    by_rate = edf.inventory_by_rate(heads).select(
        F.lit("sfreq").alias("kind"), F.col("sfreq").cast("bigint").cast("string").alias("value"),
        "n")
    return edf.inventory_by_split(heads).select(
        F.lit("split").alias("kind"), F.col("split").alias("value"), "n").unionByName(by_rate)


# ---- predicates ---------------------------------------------------------


@query("valid_time", f"WITH {o.TABLE} SELECT event_id, valid_time FROM ev")
def _(h):
    return ev.event_table(h.events(), h.headers()).select("event_id", "valid_time")


@query("invalid_reason", f"WITH {o.TABLE} SELECT event_id, invalid_reason FROM bad")
def _(h):
    return ev.invalid_rows(ev.event_table(h.events(), h.headers())).select(
        "event_id", "invalid_reason")


_ISSUE = f"""iss AS (SELECT *, list_filter(chans, lambda c: c NOT IN {o.in_list(ch.EXPECTED_22)}) AS inv,
      list_filter(chans, lambda c: NOT list_contains(edf_channels, c)) AS gone FROM ev),
   issues AS (SELECT *, CASE WHEN start_ms IS NULL OR end_ms IS NULL
       THEN 'Still Parsing Error (Should be 0)'
     WHEN end_ms <= start_ms THEN 'Negative Duration (End <= Start)'
     WHEN end_ms > edf_ms THEN 'Event Exceeds EDF Duration'
     WHEN len(inv) > 0 THEN 'Invalid Channel Names: [''' || array_to_string(inv, ''', ''') || ''']'
     WHEN len(gone) > 0 THEN 'Channel Missing in EDF: [''' || array_to_string(gone, ''', ''') || ''']'
     ELSE 'OK' END AS issue FROM iss)"""


@query("detailed_issue", f"WITH {o.TABLE}, {_ISSUE} SELECT event_id, issue FROM issues")
def _(h):
    return ev.event_table(h.events(), h.headers()).select(
        "event_id", ev.detailed_issue().alias("issue"))


@query("issue_examples", f"""WITH {o.TABLE}, {_ISSUE} SELECT issue, count(*) AS n_rows,
    arg_min(file_id, row_no) AS file_id FROM issues WHERE issue <> 'OK' GROUP BY issue""")
def _(h):
    return ev.issue_examples(ev.event_table(h.events(), h.headers()))


@query("valid_duration", f"""WITH {o.EVENTS} SELECT event_id, d AS dur_ms FROM (SELECT event_id,
    ({o.t2('end_time')}) - ({o.t2('start_time')}) AS d FROM h_events) x WHERE d > 0""")
def _(h):
    e = ev.event_times(h.events(), "loose", rollover=False)
    return e.where("dur_ms > 0").select("event_id", "dur_ms")


@query("duration_window", f"""WITH {o.FAMILY} SELECT event_id, family, e5 - s5 AS dur_ms FROM fam
    WHERE e5 > s5 AND e5 - s5 BETWEEN 100 AND 60000""")
def _(h):
    e = ev.event_times(st.with_family(labels.clinical_label(h.events())), "dotted", rollover=False)
    return e.where("dur_ms > 0").where(F.col("dur_ms").between(100, 60000)).select(
        "event_id", "family", "dur_ms")


@query("valid_manifest_rows", f"""WITH {o.MANIFEST} SELECT row_no, stem, split, label FROM man
    WHERE split IN ('train', 'evaluation') AND label IN ('Normal', 'Abnormal')""")
def _(h):
    return linkage.valid_manifest_rows(derive_manifest(h.manifest())).select(
        "row_no", "stem", "split", "label")


_NAMED = """CASE o_orderkey % 7 WHEN 0 THEN 'metadata/verification_'
   WHEN 1 THEN '.git/' WHEN 2 THEN 'train/missing_' WHEN 3 THEN 'train/x/' WHEN 4 THEN 'copy_log'
   ELSE 'metadata/' END"""
_RELEASE_PATHS = f"""SELECT concat({_NAMED}, CASE WHEN o_orderkey % 50 = 5 THEN 'sha256.txt'
   ELSE concat(cast(o_orderkey AS string), '.edf') END) AS path, o_orderkey FROM {{orders}}"""


@query("release_file_filter", f"""WITH p AS ({o.host(_RELEASE_PATHS)}) SELECT o_orderkey, path FROM p
    WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^(verification_|copy_log|missing_|duplicate_|destination_folder_validation)')
    AND NOT list_has_any(string_split(path, '/'), ['sha256.txt', '.git', '__pycache__', '.DS_Store', 'Thumbs.db'])""")
def _(h):
    return integrity.release_file_filter(
        h.spark.sql(_RELEASE_PATHS, orders=h.table("orders"))).select("o_orderkey", "path")
