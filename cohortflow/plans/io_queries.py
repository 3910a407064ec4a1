"""Queries of readers, writers and the end-to-end jobs.

Files are derived from the driver's tables. Where a query needs them on disk
they go to a new folder below the shared folder of the cluster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import integrity, linkage as ln, signal as sg
from ..sources import edf, tables
from . import oracle_sql as o, pipelines
from ..shared import shared_path
from .registry import query, rounded
from .release_queries import COUNTS, FILE_COUNTS, _CHECK, _PLAN, _SUMMARY, _contents, inventory

# ---- delimited text -----------------------------------------------------

_RENAMED = """SELECT file_name AS "File Name", cast(row_no AS varchar) AS "Date",
   coalesce(gender, '') AS "Gender", age_years AS "Age (Years)", age_months AS "Age (Months)",
   raw_label AS "Label (Normal/Abnormal)" FROM h_manifest"""


def _manifest_file(h):
    path = shared_path(h.spark, "manifest")
    m = h.manifest().select(
        F.col("file_name").alias("File Name"), F.col("row_no").cast("string").alias(" Date "),
        F.coalesce("gender", F.lit("")).alias("Gender"), F.col("age_years").alias("Age (Years)"),
        F.col("age_months").alias("Age (Months)"),
        F.col("raw_label").alias("Label (Normal/Abnormal)"))
    m.write.option("sep", "\t").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("read_manifest", f"WITH {o.MANIFEST} {_RENAMED}")
def _(h):
    return tables.read_manifest(h.spark, _manifest_file(h))


@query("read_labels", f"""WITH {o.PEOPLE} SELECT file_id AS file_name, lower(upper(label)) AS label, age,
    gender, minutes AS "edf_length (minutes)" FROM h_people""")
def _(h):
    path = shared_path(h.spark, "labels")
    h.people().select(
        F.col("file_id").alias("file_name "), F.upper("label").alias("label"), "age", "gender",
        F.col("minutes").alias(" edf_length (minutes)")).write.option("header", True).csv(path)
    return tables.read_labels(h.spark, path)


@query("write_table", f"""WITH {o.PEOPLE} SELECT row_no, gender, label, minutes FROM h_people""")
def _(h):
    path = shared_path(h.spark, "table")
    tables.write_table(h.people().select("row_no", "gender", "label", "minutes"), path)
    return h.spark.read.option("sep", "\t").option("header", True).schema(
        "row_no bigint, gender string, label string, minutes string").csv(path)


@query("write_checksum_text", f"""WITH d AS ({o.host('''SELECT concat('release/', source, '/',
   CASE WHEN doc_id % 10 = 3 THEN 'missing_' ELSE '' END, cast(doc_id AS string), '.txt') AS path,
   text, doc_id FROM {documents}''')}) SELECT sha256(text) || '  ' || path AS value FROM d
   WHERE doc_id % 10 <> 3""")
def _(h):
    path = shared_path(h.spark, "sha256")
    tables.write_checksum_text(integrity.sha256_manifest(_contents(h)), path)
    return h.spark.read.text(path)


@query("resolve_columns", f"""WITH {o.EVENTS} SELECT event_id, start_time, end_time, comment AS label,
    cast(NULL AS varchar) AS channel_names FROM h_events""")
def _(h):
    odd = h.events().select(
        "event_id", F.col("start_time").alias(" START time "), F.col("end_time").alias("Stop clock"),
        F.col("comment").alias("My Label"))
    return tables.resolve_columns(odd, {
        "event_id": ("event_id", ()), "start_time": ("start time", ("start",)),
        "end_time": ("end time", ("end", "stop")), "label": ("comment", ("label",)),
        "channel_names": ("channel names", ("channel",))})


# ---- annotation files ---------------------------------------------------
# One file holds up to 200 consecutive event numbers of a recording. The header
# of every third file is reordered, of every other third lacks the channels.

_BLOCK = "cast(floor(event_id / 200) AS bigint)"


def annotation_files(h):
    def cell(c):
        text = F.coalesce(c, F.lit(""))
        return F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))

    e = h.events().withColumn("block", F.expr(_BLOCK))
    start, end, chans, comment, first = (cell(F.col(c)) for c in (
        "start_time", "end_time", "channel_names", "comment", "file_start"))
    kind = F.col("block") % 3
    line = (
        F.when(kind == 0, F.concat_ws(",", F.lit("male"), F.lit("34"), first, start, end, chans,
                                      comment))
        .when(kind == 1, F.concat_ws(",", comment, end, start, chans, first))
        .otherwise(F.concat_ws(",", first, start, end, comment)))
    head = (
        F.when(kind == 0, "Gender,Age,File Start,Start time,End time,Channel names,Comment")
        .when(kind == 1, "Comment,End time,Start time, Channel names ,File Start")
        .otherwise("File Start,Start time,End time,Comment"))
    end_of_line = F.when(kind == 0, "\n").otherwise("\r\n")
    # bounded: at most 200 lines meet in one file
    files = e.groupBy("file_id", "block", head.alias("head"), end_of_line.alias("eol")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    return files.select(
        F.concat(F.lit("file:/csv/"), F.col("block"), F.lit("/"), F.col("file_id"), F.lit(".csv"))
        .alias("path"),
        F.concat_ws("", "head", "eol", F.array_join(
            F.transform("lines", lambda x: F.concat(x["line"], F.col("eol"))), "")).alias("value"))


@query("read_annotations", f"""WITH {o.EVENTS}, b AS (SELECT *, {_BLOCK} AS block FROM h_events)
    SELECT file_id, row_number() OVER (PARTITION BY file_id, block ORDER BY event_id) - 1 AS row_no,
    nullif(file_start, '') AS file_start, start_time, end_time,
    CASE WHEN block % 3 <> 2 THEN nullif(channel_names, '') END AS channel_names,
    CASE WHEN comment <> 'nan' THEN comment END AS comment FROM b""")
def _(h):
    """Read from files, in blocks that cut most of them several times."""
    root = shared_path(h.spark, "annotations")
    files = annotation_files(h)
    _lay_out(files.select(F.replace("path", F.lit("file:/csv/"), F.lit("")).alias("path"), F.encode("value", "UTF-8").alias("content")), root)
    return tables.read_annotations(h.spark, root, block_bytes=1000, archives=True)


# ---- EDF files ----------------------------------------------------------
# Every host recording becomes the bytes of an EDF file: one record per chunk,
# a tenth of a micro-volt per digit. Some files are damaged on purpose.

_NUMBER = "cast(regexp_extract(file_id, '[0-9]+$', 0) AS bigint)"


def edf_files(h, damaged=True, extra=()):
    """(path, length, content) of the recordings; ``extra`` channels repeat the samples of the first one."""
    def text(value, width):
        return F.rpad(value if not isinstance(value, str) else F.lit(value), width, " ")

    digit = lambda x: F.least(F.greatest(F.round(x * 1000), F.lit(-32768)), F.lit(32767)).cast("int")
    word = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(65536)).cast("bigint")), 4, "0")
    swap = lambda x: F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2))
    hexed = F.array_join(F.transform("samples", lambda x: swap(word(digit(x.cast("double"))))), "")
    place = F.array_position(F.array(*[F.lit(c) for c in o.hosts.SCALP_19_MIXED]), F.col("channel"))
    names = [*o.hosts.SCALP_19_MIXED, *extra]
    rows = h.signals().select("file_id", "sfreq", "chunk", place.alias("k"), hexed.alias("data"))
    for i in range(len(extra)):
        rows = rows.unionByName(rows.where("k = 1").withColumn("k", F.lit(20 + i).cast("bigint")))
    whole = rows.groupBy("file_id", "sfreq").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "k", "data"))).alias("rows"))
    number = F.regexp_extract("file_id", "[0-9]+$", 0).cast("bigint")
    ns = len(names)
    repeat = lambda value, width: F.repeat(text(value, width), ns)
    harm = lambda kind: F.lit(damaged) & (number % 5 == kind)
    count = F.when(harm(1), F.concat(F.lit("4"), F.repeat(F.chr(F.lit(0)), 7))).otherwise(
        text("4", 8))
    low = F.when(harm(2), repeat("abc", 8)).otherwise(repeat("-3276.8", 8))
    seconds = text(F.when(F.col("sfreq") == 200, "0.32").otherwise("0.64"), 8)
    header = F.concat(
        text("0", 8), text("X", 80), text("X", 80), text("01.01.20", 8), text("00.00.00", 8),
        text(str(256 * (ns + 1)), 8), text("", 44), count, seconds, text(str(ns), 4),
        F.concat(*[text(c, 16) for c in names]), repeat("", 80), repeat("uV", 8),
        low, repeat("3276.7", 8), repeat("-32768", 8), repeat("32767", 8), repeat("", 80),
        repeat("64", 8), repeat("", 32))
    content = F.concat(F.encode(header, "ISO-8859-1"), F.unhex(F.array_join(
        F.transform("rows", lambda r: r["data"]), "")))
    content = F.when(harm(3), F.substring(content, 1, 1000)).otherwise(content)
    return whole.select(
        F.concat(F.lit("file:/edf/"), F.col("file_id"), F.lit(".edf")).alias("path"),
        F.length(content).cast("bigint").alias("length"), content.alias("content"))


def edf_folder(h, damaged=True, extra=()):
    """The same as files that tasks write to a new shared folder, by class and split; some names begin with ``_`` or ``.``."""
    number = F.regexp_extract("path", r"_(\d+)\.edf$", 1).cast("bigint")
    folder = F.concat(F.when(number % 3 == 0, "eval").otherwise("train"), F.lit("/"), F.when(number % 2 == 0, "abnormal").otherwise("normal"),
                      F.when(number % 11 == 4, "/_more/.part/").otherwise("/"))
    root = shared_path(h.spark, "edf")
    tables.write_files(edf_files(h, damaged, extra).select(
        F.concat(folder, F.substring_index("path", "/", -1)).alias("path"), "content"), root)
    return root


_EDF = f"""{o.SIGNAL}, f AS (SELECT file_id, sfreq, count(*) AS k,
      split_part(file_id, '_', 2)::bigint % 5 AS d FROM h_signal GROUP BY file_id, sfreq),
  e AS (SELECT *, CASE d WHEN 1 THEN 'Critical Header Corruption (Null Bytes)' WHEN 2 THEN 'ValueError'
      WHEN 3 THEN 'Other Error' ELSE 'Valid' END AS status, k // 19 AS n_records FROM f)"""


@query("read_edf_headers", f"""WITH {_EDF} SELECT file_id, status,
    CASE WHEN status = 'Valid' THEN sfreq END AS sfreq,
    CASE WHEN status = 'Valid' THEN n_records END AS n_records,
    CASE WHEN status = 'Valid' THEN n_records * 64 END AS n_samples,
    CASE WHEN status = 'Valid' AND n_records > 0 THEN round((n_records * 64 - 1) / sfreq, 6) END
      AS duration_sec,
    CASE WHEN status = 'Valid' THEN 19::bigint END AS n_channels FROM e""")
def _(h):
    heads = edf.read_edf_headers(h.spark, edf_folder(h))
    return rounded(heads.select(
        "file_id", "status", "sfreq", "n_records", "n_samples", "duration_sec",
        F.when(F.col("channels").isNotNull(), F.size("channels")).cast("bigint")
        .alias("n_channels")), "duration_sec")


@query("edf_corruption_status", f"""WITH {_EDF} SELECT file_id, status FROM e WHERE status <> 'Valid'""")
def _(h):
    return edf.parse_headers(edf_files(h)).where("status <> 'Valid'").select("file_id", "status")


@query("corruption_breakdown", f"""WITH {_EDF} SELECT status, count(*) AS n FROM e
    WHERE status <> 'Valid' GROUP BY status""")
def _(h):
    return edf.corruption_breakdown(edf.parse_headers(edf_files(h)))


@query("read_edf_signals", f"""WITH {_EDF} SELECT s.file_id, s.channel, s.chunk, s.start,
    round(sum(least(greatest(round(x::double * 1000), -32768), 32767) * 0.1), 3) AS total,
    count(*) AS n FROM (SELECT *, unnest(samples) AS x FROM h_signal) s JOIN e ON e.file_id = s.file_id
    WHERE e.status = 'Valid' AND s.chunk < e.n_records GROUP BY ALL""")
def _(h):
    s = edf.read_edf_signals(h.spark, edf_folder(h), chunk_sec=0.1)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return s.select("file_id", "channel", "chunk", "start", F.round(total, 3).alias("total"),
                    F.size("samples").cast("bigint").alias("n"))


@query("scan_folder", f"""WITH {_EDF} SELECT file_id, CASE WHEN n % 3 = 0 THEN 'evaluation' ELSE 'train' END AS split,
    CASE WHEN n % 2 = 0 THEN 'Abnormal' ELSE 'Normal' END AS label, n % 11 = 4 AS hidden,
    CASE WHEN d = 3 THEN 1000 ELSE 5120 + k * 128 END AS length FROM (SELECT *, split_part(file_id, '_', 2)::bigint AS n FROM e) x""")
def _(h):
    found = tables.scan_files(h.spark, edf_folder(h), ("edf",))
    return found.select(tables.clean_id(F.col("path")).alias("file_id"), "split", "label", F.col("path").contains("/_more/.part/").alias("hidden"), "length")


# ---- jobs ---------------------------------------------------------------

#: Percents of each class in the split that is designed.
SPLIT = {"train": 45, "evaluation": 15}


def _split(h):
    return pipelines.build_split(h.manifest(), inventory(h), percent=SPLIT)


@query("build_split_selected", f"""WITH RECURSIVE {o.LINKED}, {o.split_plan('valid', SPLIT)}
    SELECT a.stem, a.split, a.label, v.source, v.year, v.edf_path, v.annotation_csv_path, v.report_path
    FROM assigned a JOIN valid v ON v.stem = a.stem""")
def _(h):
    return _split(h).selected.select("stem", "split", "label", "source", "year", "edf_path",
                                     "annotation_csv_path", "report_path")


@query("build_split_summary", f"""WITH RECURSIVE {o.LINKED}, {o.split_plan('valid', SPLIT)},
    tg(split, label, target) AS (SELECT 'train', label, tr FROM tgt UNION ALL SELECT 'evaluation', label, evl FROM tgt)
    SELECT tg.split, tg.label, tg.target::bigint AS target, count(a.stem) AS n
    FROM tg LEFT JOIN assigned a ON a.split = tg.split AND a.label = tg.label GROUP BY ALL""")
def _(h):
    return _split(h).summary


@query("build_split_missing", f"""WITH {o.LINKED} SELECT stem, missing_reason FROM reasoned
    WHERE missing_reason <> ''""")
def _(h):
    return _split(h).missing.select("stem", "missing_reason")


@query("validated_labels", f"""WITH {o.GOOD} SELECT label, count(*) AS n FROM good GROUP BY label""")
def _(h):
    return pipelines.validate_annotations(h.events(), h.headers()).label_counts


# ---- release jobs -------------------------------------------------------

def _release_folder(h):
    """Every file of the host inventory, written by tasks with its own path as content."""
    root = shared_path(h.spark, "release")
    _lay_out(h.files().select(F.expr("substring(path, 10)").alias("path"), F.encode("path", "UTF-8").alias("content")), root)
    return root


def _lay_out(files, root):
    """One file in 64 lies on its own, the others in archives: millions of files and folders would take a block of the disk each."""
    own = F.coalesce(F.crc32(F.encode("path", "UTF-8")) % 64 == 0, F.lit(False))
    tables.write_files(files.where(own), root)
    tables.write_archives(files.where(~own), root)


def _old_recordings(h, root):
    """Recordings with an upper-case suffix are in place already, with other bytes."""
    names = h.files().where("path LIKE '%.EDF'").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).distinct()
    _lay_out(names.select(F.explode(F.array(*[
        F.concat(F.lit(f"{s}/{c}/edf/"), "name") for s in ln.SPLITS for c in ("normal", "abnormal")])).alias("path"),
        F.encode(F.lit("old"), "UTF-8").alias("content")), root)


#: Copies of fewer bytes go into archives: as files of their own they waste a block of 4 KB each.
PACK_BELOW = 1 << 16


@query("package_release", f"""WITH {_PLAN.replace("FROM rel r", "FROM (SELECT * FROM uniq WHERE split IN ('train', 'evaluation') AND label IN ('Normal', 'Abnormal')) r")}
    SELECT file_name, stem, split, label, modality, folder, substr(source_path, 10) AS source, destination_path, status,
    CASE status WHEN 'copied' THEN strlen(source_path) END AS bytes,
    CASE status WHEN 'copied' THEN sha256(source_path) WHEN 'already_exists' THEN sha256('old') END AS digest FROM plan""")
def _(h):
    """The written copy log beside the digests of the files in the release."""
    root, reports = shared_path(h.spark, "packaged"), shared_path(h.spark, "reports")
    _old_recordings(h, root)
    sources = _release_folder(h)
    done = pipelines.package_release(h.spark, h.manifest(), sources, root, COUNTS, FILE_COUNTS, archives=True, pack_below=PACK_BELOW)
    # reports hold the whole paths of all sources
    pipelines.write_reports(done, reports, compression="gzip")
    log = h.spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema(
        "file_name string, stem string, split string, label string, modality string, folder string, source_path string, "
        "destination_path string, status string, bytes bigint").csv(f"{reports}/copy_log").na.fill("", ["source_path", "destination_path"])
    digests = integrity.checksum_folder(h.spark, root, archives=True).withColumnRenamed("path", "destination_path")
    return log.join(digests, "destination_path", "left").withColumn(
        "source", F.when(F.col("source_path") == "", "").otherwise(F.expr("split_part(source_path, '/release-', 2)"))).withColumn(
        "source", F.regexp_replace("source", "^[^/]*/", "")).drop("source_path")


_REPORTS = {
    "recording_counts": "split, label, expected_count, actual_count, status", "missing": "split, label, modality, stem, expected_folder",
    "matched": "split, label, modality, stem, matched_path", "extra": "split, label, modality, stem, path",
    "duplicates": "split, label, modality, stem, path, first_path, duplicate_count", "repeated_rows": "stem, row_no",
    "summary": "split, label, modality, expected_count, actual_file_count, matched_stems, missing_stems, extra_stems, status",
    "verdict": "missing, extra, duplicates, verdict"}
_SAME = "i.stem = w.stem AND i.split = w.split AND i.label = w.label AND i.modality = w.modality"


@query("verify_release", f"""WITH {_SUMMARY}, {_CHECK}, act AS (SELECT i.* REPLACE (substr(path, 10) AS path), f.folder
      FROM inv i JOIN folders f USING (split, label, modality)),
    dup AS (SELECT split, label, modality, stem, path, min(path) OVER w AS first_path, count(*) OVER w AS duplicate_count
      FROM act WINDOW w AS (PARTITION BY split, label, modality, stem)),
    missing AS (SELECT w.split, w.label, w.modality, w.stem, f.folder AS expected_folder FROM want w JOIN folders f USING (split, label, modality)
      WHERE NOT EXISTS (SELECT 1 FROM act i WHERE {_SAME})),
    matched AS (SELECT w.split, w.label, w.modality, w.stem, i.path AS matched_path FROM want w JOIN act i ON {_SAME}),
    extra AS (SELECT split, label, modality, stem, path FROM act i WHERE NOT EXISTS (SELECT 1 FROM want w WHERE {_SAME})),
    repeated AS (SELECT stem, row_no FROM man2 WHERE split IN ('train', 'evaluation') AND label IN ('Normal', 'Abnormal')
      QUALIFY count(*) OVER (PARTITION BY stem) > 1),
    d AS (SELECT * FROM dup WHERE duplicate_count > 1),
    verdict AS (SELECT sum(missing_stems)::bigint AS missing, sum(extra_stems)::bigint AS extra,
      (SELECT count(*) FROM (SELECT DISTINCT split, label, modality, stem FROM d) x) AS duplicates,
      CASE WHEN bool_and(status = 'OK') AND (SELECT bool_and(status = 'OK') FROM rc) AND NOT EXISTS (SELECT 1 FROM d)
        THEN 'SUCCESS' ELSE 'CHECK REQUIRED' END AS verdict FROM rs)
    """ + " UNION ALL ".join(f"SELECT '{name}' AS report, concat_ws('|', {columns}) AS line FROM {view}" for (name, columns), view in zip(
        _REPORTS.items(), ("rc", "missing", "matched", "extra", "d", "repeated", "rs", "verdict"))))
def _(h):
    """All reports, read back from the text that the job wrote."""
    reports = shared_path(h.spark, "reports")
    pipelines.write_reports(pipelines.verify_release(h.spark, h.manifest(), _release_folder(h), COUNTS, FILE_COUNTS, archives=True), reports)
    lines = [h.spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(f"{reports}/{name}").select(
        F.lit(name).alias("report"), F.concat_ws("|", *columns.split(", ")).alias("line")) for name, columns in _REPORTS.items()]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out
