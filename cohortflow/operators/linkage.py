"""Files against a manifest: linking, reconciliation, copy plans and checks.

Manifest: ``file_name, stem, split, label`` (class) and more. File inventory:
``stem, modality, path`` with ``split`` and ``label`` of the folder a file is in
(both null or absent for folders that have none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.channels import SCALP_19, vocabulary
from .events import count_if
from .labels import inline_table

# Files every recording of a class must have, and their folders.
REQUIRED = {"Normal": ("edf", "report"), "Abnormal": ("edf", "annotation", "report")}
FOLDER_NAMES = {"edf": "edf", "annotation": "annotations", "report": "reports"}
SPLITS = ("train", "evaluation")
FOLDER_KEYS = ("split", "label", "modality")


def release_folder(split: Column, label: Column, modality: Column) -> Column:
    """Relative target folder, null for a combination that has none."""
    names = F.create_map(*[F.lit(x) for pair in FOLDER_NAMES.items() for x in pair])
    known = split.isin(*SPLITS) & (
        ((label == "Normal") & modality.isin(*REQUIRED["Normal"]))
        | ((label == "Abnormal") & modality.isin(*REQUIRED["Abnormal"])))
    return F.when(known, F.concat_ws("/", split, F.lower(label), names[modality]))


def folder_dim(spark: SparkSession, targets: dict[tuple[str, str, str], int] | None = None) -> DataFrame:
    """The ten release folders with the number of files each should hold."""
    rows = [(s, c, m, (targets or {}).get((s, c, m), 0))
            for s in SPLITS for c in REQUIRED for m in REQUIRED[c]]
    dim = inline_table(spark, rows,
                       "split string, label string, modality string, expected_count bigint")
    return dim.withColumn("folder", release_folder(*[F.col(k) for k in FOLDER_KEYS]))


def in_release_folders(files: DataFrame) -> DataFrame:
    """Files that lie in, or anywhere below, one of the ten release folders and are of its kind.

    ``path`` is relative to the release; split and class come from its first folders alone.
    """
    placed = files.drop("split", "label").withColumn("folder", F.substring_index("path", "/", 3))
    folders = folder_dim(files.sparkSession).select("folder", *FOLDER_KEYS)
    return placed.join(F.broadcast(folders), ["folder", "modality"])


def valid_manifest_rows(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("split").isin(*SPLITS) & F.col("label").isin(*REQUIRED))


# ---- duplicates ---------------------------------------------------------

def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, as a combined aggregation instead of a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(
        *[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def duplicate_rows(df: DataFrame, key: str = "stem") -> DataFrame:
    """All rows of keys that occur more than once."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(twice, key, "left_semi")


def release_manifest(manifest: DataFrame, dedup_stage: str = "after_filter") -> DataFrame:
    """Valid rows, one per stem, deduplicated before or after the filter."""
    if dedup_stage == "before_filter":
        return valid_manifest_rows(dedup_first(manifest, "stem", "row_no"))
    return dedup_first(valid_manifest_rows(manifest), "stem", "row_no")


def duplicate_files(files: DataFrame, keys=("split", "label", "modality", "stem")) -> DataFrame:
    """Every path of a stem that has more than one file in a folder.

    One row per path: a joined text of all paths would grow with the group.
    """
    keys = list(keys)
    groups = files.groupBy(*keys).agg(
        F.count("*").alias("duplicate_count"), F.min("path").alias("first_path"))
    many = groups.where("duplicate_count > 1").withColumnsRenamed({k: f"_{k}" for k in keys})
    # files outside release folders have null keys, which form groups too
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rest = [c for c in files.columns if c not in keys]
    return files.join(many, same).select(*keys, *rest, "duplicate_count", "first_path")


def duplicate_pairs(files: DataFrame, keys=("label", "modality", "stem")) -> DataFrame:
    """``(first_path, duplicate_path)`` for every file that is not the first."""
    dup = duplicate_files(files.select(*keys, "path"), keys)
    return dup.where("path <> first_path").select(
        *keys, "first_path", F.col("path").alias("duplicate_path"))


def first_files(files: DataFrame, keys) -> DataFrame:
    """The smallest path of each key, so the choice never depends on a walk."""
    return files.groupBy(*keys).agg(F.min("path").alias("path"))


# ---- linking ------------------------------------------------------------

def link_files(manifest: DataFrame, files: DataFrame, csv_for_normal: bool = False,
               csv_for_abnormal: bool = True) -> DataFrame:
    """Attach EDF, annotation and report paths and say which are missing.

    EDF and report files must lie in the folder of the row's class, annotations
    in any. All five indexes come from one aggregation and one join by stem.
    """
    def smallest(modality, label=None):
        here = F.col("modality") == modality
        if label:
            here = here & (F.col("label") == label)
        return F.min(F.when(here, F.col("path")))

    index = files.groupBy("stem").agg(
        smallest("edf", "Normal").alias("_edf_n"), smallest("edf", "Abnormal").alias("_edf_a"),
        smallest("report", "Normal").alias("_rep_n"),
        smallest("report", "Abnormal").alias("_rep_a"),
        smallest("annotation").alias("_csv"))
    normal, abnormal = F.col("label") == "Normal", F.col("label") == "Abnormal"

    def of_class(n, a):
        path = F.when(normal, F.col(n)).when(abnormal, F.col(a))
        return F.coalesce(path, F.lit(""))

    linked = (
        manifest.join(index, "stem", "left")
        .withColumn("edf_path", of_class("_edf_n", "_edf_a"))
        .withColumn("annotation_csv_path", of_class("_csv", "_csv"))
        .withColumn("report_path", of_class("_rep_n", "_rep_a"))
        .drop("_edf_n", "_edf_a", "_rep_n", "_rep_a", "_csv")
    )
    word = F.lower("label")
    needs_csv = (normal & F.lit(csv_for_normal)) | (abnormal & F.lit(csv_for_abnormal))

    def lacking(path, what):
        return (F.col(path) == "") & what

    reason = F.concat_ws(
        ", ",
        F.when(~(normal | abnormal), "invalid or missing label"),
        F.when(lacking("edf_path", normal | abnormal),
               F.concat(F.lit("missing "), word, F.lit(" edf"))),
        F.when(lacking("report_path", normal | abnormal),
               F.concat(F.lit("missing "), word, F.lit(" report"))),
        F.when(lacking("annotation_csv_path", needs_csv),
               F.concat(F.lit("missing "), word, F.lit(" csv annotation"))))
    return linked.withColumn("missing_reason", reason)


def edf_csv_mapping(headers: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every id of either side and what exists for it."""
    edf = headers.select("file_id").distinct().withColumn("_e", F.lit(True))
    csv = annotations.select("file_id").distinct().withColumn("_c", F.lit(True))
    return edf.join(csv, "file_id", "full").select(
        "file_id", F.col("_e").isNotNull().alias("has_readable_edf"),
        F.col("_c").isNotNull().alias("has_csv"))


def semi_processed(events: DataFrame, metrics: DataFrame) -> DataFrame:
    return events.join(metrics.select("file_id"), "file_id", "left_semi")


def missing_annotations(recordings: DataFrame, annotated: DataFrame) -> DataFrame:
    """Abnormal recordings without an annotation file."""
    return recordings.where(F.lower("label") == "abnormal").join(
        annotated.select("file_id"), "file_id", "left_anti")


def unused_records(valid: DataFrame, selected: DataFrame) -> DataFrame:
    return valid.join(selected.select("stem"), "stem", "left_anti")


def folder_difference(folder: DataFrame, reference: DataFrame) -> DataFrame:
    """File names of ``reference`` that ``folder`` lacks, sorted."""
    names = reference.select("name").distinct()
    return names.join(folder.select("name"), "name", "left_anti").orderBy("name")


# ---- release ------------------------------------------------------------

def expected_items(manifest: DataFrame) -> DataFrame:
    """One row per file that a manifest row requires."""
    wanted = None
    for label, modalities in REQUIRED.items():
        items = F.array(*[F.lit(m) for m in modalities])
        hit = F.col("label") == label
        wanted = F.when(hit, items) if wanted is None else wanted.when(hit, items)
    return manifest.select("file_name", "stem", "split", "label",
                           F.explode(wanted).alias("modality"))


_ITEM = ["split", "label", "modality", "stem"]


def match_release(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected items with every path found for them in their folder."""
    return expected.join(actual.select(*_ITEM, F.col("path").alias("matched_path")), _ITEM)


def missing_release(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual.select(*_ITEM), _ITEM, "left_anti").withColumn(
        "expected_folder", release_folder(*[F.col(k) for k in FOLDER_KEYS]))


def extra_release(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Files in one of the release folders that nothing expects there."""
    folder = release_folder(*[F.col(k) for k in FOLDER_KEYS])
    return (
        actual.withColumn("folder", folder).where(F.col("folder").isNotNull())
        .join(expected.select(*_ITEM), _ITEM, "left_anti")
        .withColumn("status", F.lit("extra_or_wrong_folder"))
    )


def copy_plan(manifest: DataFrame, files: DataFrame, existing: DataFrame | None = None,
              overwrite: bool = False) -> DataFrame:
    """One row per required file: where it comes from, where it goes, its status.

    ``missing`` without a source; otherwise ``copied``, or ``already_exists``
    when the destination is among ``existing(path)`` and must not be replaced.
    """
    classed = first_files(files.where("modality <> 'annotation'"), ["stem", "label", "modality"])
    csv = first_files(files.where("modality = 'annotation'"), ["stem", "modality"])
    sources = classed.unionByName(csv.select(
        "stem", F.explode(F.array(*[F.lit(c) for c in REQUIRED])).alias("label"),
        "modality", "path"))
    folder = release_folder(*[F.col(k) for k in FOLDER_KEYS])
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    plan = (
        expected_items(manifest).join(sources, ["stem", "label", "modality"], "left")
        .withColumn("folder", folder)
        .withColumn("source_path", F.coalesce("path", F.lit("")))
        .withColumn("destination_path",
                    F.coalesce(F.concat_ws("/", "folder", F.nullif(name, F.lit(""))), F.lit("")))
        .withColumn("destination_path",
                    F.when(F.col("path").isNull(), "").otherwise(F.col("destination_path")))
    )
    status = F.when(F.col("path").isNull(), "missing")
    if existing is not None and not overwrite:
        there = existing.select(F.col("path").alias("destination_path")).distinct()
        plan = plan.join(there.withColumn("_there", F.lit(True)), "destination_path", "left")
        status = status.when(F.col("_there"), "already_exists")
    return plan.withColumn("status", status.otherwise("copied")).select(
        "file_name", "stem", "split", "label", "modality", "folder",
        "source_path", "destination_path", "status")


def copy_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("split", "label", "modality", "status").agg(F.count("*").alias("n"))


def inventory_counts(files: DataFrame) -> DataFrame:
    """Distinct stems per modality and class."""
    stems = files.groupBy("modality", "label", "stem").agg(F.count("*").alias("_n"))
    return stems.groupBy("modality", "label").agg(
        F.count("*").alias("n_stems"), F.sum("_n").alias("n_files"))


def split_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "label").agg(F.count("*").alias("n"))


def split_coverage(manifest: DataFrame) -> DataFrame:
    """Rows per class, source and year in each split, 0 for none."""
    return manifest.groupBy("label", "source", "year").agg(
        count_if(F.col("split") == "train").alias("train"),
        count_if(F.col("split") == "evaluation").alias("evaluation"))


def _verdict(ok: Column) -> Column:
    return F.when(ok, "OK").otherwise("CHECK")


def recording_count_check(manifest: DataFrame, targets: dict[tuple[str, str], int]) -> DataFrame:
    """Expected and actual recordings of each split and class."""
    dim = inline_table(manifest.sparkSession, [(s, c, n) for (s, c), n in targets.items()],
                       "split string, label string, expected_count bigint")
    counts = manifest.groupBy("split", "label").agg(F.count("*").alias("actual_count"))
    inside = counts.join(F.broadcast(dim.select("split", "label")), ["split", "label"],
                         "left_semi")
    return (
        dim.join(F.broadcast(inside), ["split", "label"], "left").na.fill(0, ["actual_count"])
        .withColumn("status", _verdict(F.col("actual_count") == F.col("expected_count")))
    )


def folder_count_check(files: DataFrame, root: str,
                       targets: dict[tuple[str, str, str], int]) -> DataFrame:
    """Expected and actual files that lie directly in each release folder."""
    dim = folder_dim(files.sparkSession, targets)
    base = root.rstrip("/")
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    placed = files.select(parent.alias("_dir"), *FOLDER_KEYS)
    folder = F.concat_ws("/", F.lit(base), release_folder(*[F.col(k) for k in FOLDER_KEYS]))
    direct = placed.where(F.col("_dir") == folder)
    counts = direct.groupBy(*FOLDER_KEYS).agg(F.count("*").alias("actual_count"))
    return (
        dim.join(F.broadcast(counts), list(FOLDER_KEYS), "left").na.fill(0, ["actual_count"])
        .withColumn("status", _verdict(F.col("actual_count") == F.col("expected_count")))
    )


def release_summary(expected: DataFrame, actual: DataFrame,
                    targets: dict[tuple[str, str, str], int]) -> DataFrame:
    """Per folder: files, and stems that match, are missing or are extra."""
    want = expected.select(*_ITEM).distinct().withColumn("_w", F.lit(1))
    have = actual.groupBy(*_ITEM).agg(F.count("*").alias("_files"))
    both = want.join(have, _ITEM, "full")
    wanted, found = F.col("_w").isNotNull(), F.col("_files").isNotNull()
    counts = both.groupBy(*FOLDER_KEYS).agg(
        F.coalesce(F.sum("_files"), F.lit(0)).alias("actual_file_count"),
        count_if(wanted & found).alias("matched_stems"),
        count_if(wanted & ~found).alias("missing_stems"),
        count_if(~wanted & found).alias("extra_stems"))
    names = ["actual_file_count", "matched_stems", "missing_stems", "extra_stems"]
    dim = folder_dim(expected.sparkSession, targets)
    inside = counts.join(F.broadcast(dim.select(*FOLDER_KEYS)), list(FOLDER_KEYS), "left_semi")
    ok = ((F.col("actual_file_count") == F.col("expected_count"))
          & (F.col("missing_stems") == 0) & (F.col("extra_stems") == 0))
    return (
        dim.join(F.broadcast(inside), list(FOLDER_KEYS), "left").na.fill(0, names)
        .withColumn("status", _verdict(ok))
    )


def release_verdict(summary: DataFrame, record_check: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Totals over all folders and SUCCESS only when every check passed."""
    totals = summary.agg(
        F.sum("missing_stems").alias("missing"), F.sum("extra_stems").alias("extra"),
        F.bool_and(F.col("status") == "OK").alias("folders_ok"))
    counts = record_check.agg(F.bool_and(F.col("status") == "OK"))
    groups = duplicates.select(*_ITEM).distinct().agg(F.count("*"))
    one = totals.withColumn("counts_ok", counts.scalar()).withColumn(
        "duplicates", groups.scalar())
    good = ((F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0)
            & F.col("folders_ok") & F.col("counts_ok"))
    return one.withColumn("verdict", F.when(good, "SUCCESS").otherwise("CHECK REQUIRED"))


def stem_intersect(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select(*_ITEM).intersect(actual.select(*_ITEM))


def stem_except(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*_ITEM).subtract(right.select(*_ITEM))


# ---- recordings ---------------------------------------------------------

def integrity_table(recordings: DataFrame, files: DataFrame, sfreq: float = 200.0,
                    vocab=SCALP_19) -> DataFrame:
    """Counts and per cents of readable, complete and linked recordings.

    ``recordings``: ``file_id, split, label, readable, channels, sfreq, n_samples``;
    ``files``: ``stem, split, label, modality`` of reports and annotations. A report counts
    in the recording's own split and class only; splits and classes may be spelled as in
    folder names. A null split or class has no reports.
    """
    stem = lambda c: F.lower(c).alias("_stem")
    own = [F.when(F.lower("split") == "train", "train").when(
        F.lower("split").isin("evaluation", "eval", "test"), "evaluation").alias("_split"),
        F.lower("label").alias("_class")]
    reports = files.where("modality = 'report'").select(stem("stem"), *own).distinct().withColumn(
        "_rep", F.lit(True))
    annotations = files.where("modality = 'annotation'").select(stem("stem")).distinct().withColumn(
        "_csv", F.lit(True))
    r = recordings.select("*", stem("file_id"), *own).join(
        reports, ["_stem", "_split", "_class"], "left").join(annotations, "_stem", "left")
    ok = F.col("readable")
    abnormal = F.lower("label") == "abnormal"
    full_set = F.size(F.array_except(vocabulary(vocab), "channels")) == 0
    checks = {
        "readable": ok, "channel_set": ok & full_set,
        "sampling_rate": ok & (F.col("sfreq") == sfreq),
        "has_samples": ok & (F.col("n_samples") > 0),
        "report": F.col("_rep"), "annotation": abnormal & F.col("_csv"),
    }
    sums = r.agg(F.count("*").alias("_all"), count_if(abnormal).alias("_ab"),
                 *[count_if(c).alias(k) for k, c in checks.items()])
    rows = F.array(*[
        F.struct(F.lit(k).alias("check"), F.col(k).alias("n"),
                 F.col("_ab" if k == "annotation" else "_all").alias("total"))
        for k in checks])
    return sums.select(F.explode(rows).alias("x")).select("x.*").withColumn(
        "pct", F.try_divide(100.0 * F.col("n"), F.col("total")))
