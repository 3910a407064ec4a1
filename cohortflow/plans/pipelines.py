"""The end-to-end jobs, composed of lazy operators, and the sink of their reports."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.channels import SCALP_19, norm_channel, vocabulary
from ..operators import events, integrity, linkage, signal, split, statistics
from ..shared import stored
from ..sources import edf, tables


def derive_manifest(raw: DataFrame) -> DataFrame:
    """Stem, class, source, year and age of ``(file_name, row_no, raw_label, ...)``."""
    stem = text.clean_stem(F.col("file_name"))
    out = raw.withColumn("stem", stem).withColumn(
        "label", text.normalize_class(F.col("raw_label")))
    origin = text.parse_source_year(F.col("stem"))
    out = out.withColumn("_o", origin).withColumn("source", F.col("_o.source")).withColumn(
        "year", F.col("_o.year")).drop("_o")
    if "age_years" in raw.columns:
        out = out.withColumn("age", text.make_age(F.col("age_years"), F.col("age_months")))
    if "raw_split" in raw.columns:
        out = out.withColumn("split", text.normalize_split(F.col("raw_split")))
    return out


@dataclass
class SplitResult:
    duplicates: DataFrame
    missing: DataFrame
    selected: DataFrame
    unused: DataFrame
    summary: DataFrame
    coverage: DataFrame


def build_split(raw: DataFrame, files: DataFrame, targets=split.TARGETS, percent: dict[str, int] | None = None) -> SplitResult:
    """Manifest rows and a file inventory to an exact stratified split, of fixed numbers or of ``percent`` of each class."""
    manifest = derive_manifest(raw)
    linked = linkage.link_files(linkage.dedup_first(manifest, "stem", "row_no"), files)
    valid = split.strata(linked.where("missing_reason = ''"))
    counts = split.stratum_counts(valid)
    targets = split.share_targets(counts, percent) if percent else targets
    plan = split.plan_split(counts, targets)
    chosen = split.assign_split(split.select_records(valid, plan), plan)
    return SplitResult(
        duplicates=linkage.duplicate_rows(manifest),
        missing=linked.where("missing_reason <> ''"),
        selected=split.sort_manifest(chosen),
        unused=linkage.unused_records(valid, chosen),
        summary=split.check_targets(chosen, targets),
        coverage=linkage.split_coverage(chosen))


@dataclass
class ValidationResult:
    mapping: DataFrame
    files: DataFrame
    events: DataFrame
    label_counts: DataFrame
    channel_counts: DataFrame
    reasons: DataFrame
    excess: DataFrame


def validate_annotations(rows: DataFrame, headers: DataFrame) -> ValidationResult:
    """Annotation rows and recording headers to event table, summaries and reasons."""
    readable = headers.where("status = 'Valid'") if "status" in headers.columns else headers
    table = events.event_table(rows, readable)
    return ValidationResult(
        mapping=linkage.edf_csv_mapping(readable, rows),
        files=events.file_summary(table), events=table,
        label_counts=statistics.label_counts(table.where("valid_time"), "label"),
        channel_counts=events.channel_event_counts(table),
        reasons=events.reason_report(table), excess=events.excess_seconds(table))


#: Seconds of the longest window of ``recording_signal_stats``, and of the samples a task holds at a time.
LONGEST_WINDOW, CHUNK_SEC = 10.0, 600.0


def scalp_frames(spark: SparkSession, root: str, tmax: float | None = None, chunk_sec: float | None = CHUNK_SEC,
                 halo_sec: float = LONGEST_WINDOW) -> DataFrame:
    """Frames of the 19 standard channels: references and ECG are left out before any measure."""
    return edf.read_edf_frames(spark, root, tmax, chunk_sec, halo_sec).withColumn("signals", F.filter(
        "signals", lambda s: F.array_contains(vocabulary(SCALP_19), norm_channel(s["channel"]))))


def assess_signals(spark: SparkSession, root: str, chunk_sec: float | None = CHUNK_SEC) -> DataFrame:
    """Recordings below a folder to one row of quality measures each, in one pass over their samples."""
    labels = tables.scan_files(spark, root, ("edf",)).select(
        tables.clean_id(F.col("path")).alias("file_id"),
        text.recording_group(F.col("path")).alias("group"),
        text.recording_subset(F.col("path")).alias("subset"))
    return signal.recording_signal_stats(scalp_frames(spark, root, chunk_sec=chunk_sec), labels)


def extract_features(spark: SparkSession, root: str, tmax: float = 60.0, seconds: float = 2.0) -> DataFrame:
    """Features of the first ``tmax`` seconds of the 19 channels of every readable recording, with split and class."""
    frames = scalp_frames(spark, root, tmax, None, 0.0)
    psd = signal.welch_psd(signal.frames_to_signals(frames), F.col("sfreq") * seconds)
    heads = edf.read_edf_headers(spark, root).where("status = 'Valid'").select("file_id", "split", "label")
    return heads.join(signal.signal_features(psd), "file_id")


@dataclass
class QualityResult:
    channels: DataFrame
    files: DataFrame


def check_channels(spark: SparkSession, root: str, seconds: float = 2.0, chunk_sec: float = CHUNK_SEC) -> QualityResult:
    """Quality of every channel and recording below a folder; each table is one pass over the samples."""
    states = signal.signal_states(scalp_frames(spark, root, chunk_sec=chunk_sec, halo_sec=seconds), [signal.quality_spectrum(seconds=seconds)])
    return QualityResult(signal.channel_measures(states), signal.file_measures(
        states, edf.read_edf_headers(spark, root).where("status = 'Valid'")))


# ---- releases -----------------------------------------------------------

def write_reports(result, folder: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Every table of a job's result as delimited text, in a folder below ``folder`` named like it."""
    for report in fields(result):
        tables.write_table(getattr(result, report.name), f"{folder.rstrip('/')}/{report.name}", mode=mode, compression=compression)


def release_inventory(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """Every file below a folder with its ``uri`` and, by the path relative to the folder, what it is."""
    files = integrity.relative_paths(tables.list_files(spark, root, archives), root)
    # folders are recognised by the slashes around their names
    return tables.describe_paths(files.withColumn("path", F.concat(F.lit("/"), "path"))).withColumn(
        "path", F.expr("substring(path, 2)"))


@dataclass
class ReleaseCheck:
    recording_counts: DataFrame
    repeated_rows: DataFrame
    matched: DataFrame
    missing: DataFrame
    extra: DataFrame
    duplicates: DataFrame
    summary: DataFrame
    verdict: DataFrame


def verify_release(spark: SparkSession, raw: DataFrame, root: str, counts: dict[tuple[str, str], int],
                   file_counts: dict[tuple[str, str, str], int], archives: bool = False) -> ReleaseCheck:
    """Manifest rows against the files of a release: what fits, is missing, too much or there twice, and a verdict.

    ``counts`` has the recordings to expect of each split and class, ``file_counts`` the files
    of each release folder. The folder is listed once and kept as a stored table. With
    ``archives``, files in ZIP archives count as if they were unpacked where the archive lies.
    """
    rows = stored(linkage.valid_manifest_rows(derive_manifest(raw)), "manifest")
    manifest = linkage.dedup_first(rows, "stem", "row_no")
    actual = stored(linkage.in_release_folders(release_inventory(spark, root, archives)), "inventory")
    wanted = linkage.expected_items(manifest)
    recordings = linkage.recording_count_check(manifest, counts)
    summary = linkage.release_summary(wanted, actual, file_counts)
    duplicates = linkage.duplicate_files(actual)
    return ReleaseCheck(
        recording_counts=recordings, repeated_rows=linkage.duplicate_rows(rows),
        matched=linkage.match_release(wanted, actual), missing=linkage.missing_release(wanted, actual),
        extra=linkage.extra_release(actual, wanted), duplicates=duplicates, summary=summary,
        verdict=linkage.release_verdict(summary, recordings, duplicates))


@dataclass
class Packaging:
    copy_log: DataFrame
    missing: DataFrame
    summary: DataFrame
    duplicate_sources: DataFrame
    recording_counts: DataFrame
    folder_counts: DataFrame


def package_release(spark: SparkSession, raw: DataFrame, sources: str, root: str, counts: dict[tuple[str, str], int],
                    file_counts: dict[tuple[str, str, str], int], overwrite: bool = False, archives: bool = False,
                    pack_below: int = 0) -> Packaging:
    """Copy the files that manifest rows require from class folders below ``sources`` into the folders of a release.

    The copies are made before this returns; the log has a row per required file, with the
    bytes that were copied. Files that are there already stay as they are, unless ``overwrite``.
    Of several files with one stem the one with the smallest path is taken. With ``archives``,
    files in ZIP archives count on both sides as if they were unpacked where the archive lies;
    none may replace a file in an archive. Copies are files of their own, but for those of fewer
    than ``pack_below`` bytes that replace no such file: these go into archives right below
    ``root``, as each would take a block of the disk. They unpack to the folders of the release.
    """
    if pack_below and not archives:
        raise ValueError("copies in archives count only with archives=True")
    manifest = linkage.release_manifest(derive_manifest(raw), "before_filter")
    found = stored(release_inventory(spark, sources, archives).where("modality IS NOT NULL").withColumn(
        "path", F.col("uri")).drop("uri"), "inventory")
    store, name = tables.open_store(root)
    store.create_dir(name, recursive=True)
    there = integrity.relative_paths(tables.placed(tables.list_files(spark, root, archives)).select("path", "at"), root)
    plan = stored(linkage.copy_plan(manifest, found, there.select("path"), overwrite), "copy-plan")
    wanted = plan.where("status = 'copied'")
    if archives:
        held = there.where("at IS NOT NULL").select(F.col("path").alias("destination_path"))
        if overwrite and not wanted.join(held, "destination_path", "left_semi").isEmpty():
            raise ValueError("files in archives of the release cannot be overwritten")
        # of a file that lies there and in an archive one is taken
        where = found.groupBy(F.col("path").alias("source_path")).agg(F.min(F.struct("place", "at", "length")).alias("_p"))
        wanted = wanted.join(where, "source_path").select("destination_path", "source_path", "_p.*")
    if pack_below:
        loose = there.where("at IS NULL").select(F.col("path").alias("destination_path"), F.lit(True).alias("_loose"))
        wanted = wanted.join(loose, "destination_path", "left").withColumn("pack", (F.col("length") < pack_below) & F.col("_loose").isNull())
    copied = tables.copy_files(wanted, root)
    log = plan.join(copied, "destination_path", "left").select(*plan.columns, "bytes")
    after = release_inventory(spark, root, archives).withColumn("path", F.concat(F.lit("/"), "path"))
    return Packaging(
        copy_log=log, missing=plan.where("status = 'missing'"), summary=linkage.copy_summary(plan),
        duplicate_sources=linkage.duplicate_pairs(found),
        recording_counts=linkage.recording_count_check(manifest, counts),
        folder_counts=linkage.folder_count_check(after, "", file_counts))
