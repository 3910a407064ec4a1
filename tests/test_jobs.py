"""Packaging and verification of a release on real files."""

import hashlib
import os
import zipfile
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import integrity, linkage as ln
from cohortflow.plans import io_queries, pipelines
from cohortflow.plans.hosts import Hosts
from cohortflow.plans.queries import QUERIES
from cohortflow.sources import tables

ROWS = [("mh_2020_1.edf", 1, "abnormal", "train"), ('"E:/x/MH_2020_2.EDF"', 2, "Normal", "eval"),
        ("mh_2020_3", 3, "normal", "training"), ("mh_2020_3.edf", 4, "abnormal", "train"),
        ("mh_2020_4", 5, "normal", "hold"), ("mh_2020_5", 6, "", "train"), (None, 7, None, None)]
FILES = {"abnormal/edf/mh_2020_1.edf": b"one", "abnormal/csv/mh_2020_1.csv": b"a,b", "abnormal/rep/deep/mh_2020_1.txt": b"",
         "normal/edf/mh_2020_2.EDF": b"two" * 700_000, "normal/rep/mh_2020_2.pdf": b"pdf", "normal/b/mh_2020_2.edf": b"first",
         "normal/edf/mh_2020_3.edf": b"three", "normal/edf/other.bin": b"?", "normal/edf/mh_2020_4.edf": b"four"}
COUNTS = {("train", "Normal"): 1, ("evaluation", "Normal"): 1, ("train", "Abnormal"): 1, ("evaluation", "Abnormal"): 0}
# the report of recording 3 is missing
FILE_COUNTS = {("train", "Normal", "edf"): 1, ("train", "Normal", "report"): 1, ("evaluation", "Normal", "edf"): 1,
               ("evaluation", "Normal", "report"): 1, ("train", "Abnormal", "edf"): 1, ("train", "Abnormal", "annotation"): 1,
               ("train", "Abnormal", "report"): 1}


def raw(spark, rows=ROWS):
    return spark.createDataFrame(rows, "file_name string, row_no int, raw_label string, raw_split string").withColumn(
        "stem_of", F.lit("extra"))


@pytest.fixture()
def folders(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def package(spark, folders, **more):
    return pipelines.package_release(spark, raw(spark), str(folders / "src"), str(folders / "train" / "out"), COUNTS, FILE_COUNTS, **more)


def whole(folders):
    root = folders / "train" / "out"
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_package_and_verify(spark, folders):
    done = package(spark, folders)
    assert whole(folders) == {
        "train/abnormal/edf/mh_2020_1.edf": b"one", "train/abnormal/annotations/mh_2020_1.csv": b"a,b",
        "train/abnormal/reports/mh_2020_1.txt": b"", "evaluation/normal/edf/mh_2020_2.edf": b"first",
        "evaluation/normal/reports/mh_2020_2.pdf": b"pdf", "train/normal/edf/mh_2020_3.edf": b"three"}
    log = {(r.stem, r.modality): (r.status, r.bytes) for r in done.copy_log.collect()}
    assert log == {("mh_2020_1", "edf"): ("copied", 3), ("mh_2020_1", "annotation"): ("copied", 3), ("mh_2020_1", "report"): ("copied", 0),
                   ("mh_2020_2", "edf"): ("copied", 5), ("mh_2020_2", "report"): ("copied", 3),
                   ("mh_2020_3", "edf"): ("copied", 5), ("mh_2020_3", "report"): ("missing", None)}
    assert [(r.stem, r.modality) for r in done.missing.collect()] == [("mh_2020_3", "report")]
    assert [r.duplicate_path.rsplit("/", 2)[1:] for r in done.duplicate_sources.collect()] == [["edf", "mh_2020_2.EDF"]]
    assert {r.status for r in done.recording_counts.collect()} == {"OK"}
    assert [(r.folder, r.actual_count) for r in done.folder_counts.where("status <> 'OK'").collect()] == [("train/normal/reports", 0)]

    # a parent folder named train, and folders of that name further down, do not count as a split
    root = folders / "train" / "out"
    for name in ("train/normal/edf/abnormal/evaluation/mh_2020_3.EDF", "train/normal/edf/stray.edf",
                 "train/normal/edf/notes.txt", "elsewhere/mh_2020_3.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    check = pipelines.verify_release(spark, raw(spark), str(root), COUNTS, FILE_COUNTS)
    pipelines.write_reports(check, str(folders / "reports"))
    read = lambda name: spark.read.option("sep", "\t").option("header", True).csv(str(folders / "reports" / name)).collect()
    assert [(r.stem, r.modality, r.expected_folder) for r in read("missing")] == [("mh_2020_3", "report", "train/normal/reports")]
    assert [r.path for r in read("extra")] == ["train/normal/edf/stray.edf"]
    assert {r.path for r in read("duplicates")} == {"train/normal/edf/mh_2020_3.edf", "train/normal/edf/abnormal/evaluation/mh_2020_3.EDF"}
    assert len(read("matched")) == 7 and {r.row_no for r in read("repeated_rows")} == {"3", "4"}
    [last] = read("verdict")
    assert (last.missing, last.extra, last.duplicates, last.verdict) == ("1", "1", "1", "CHECK REQUIRED")
    with pytest.raises(Exception, match="(?i)already exists"):
        pipelines.write_reports(check, str(folders / "reports"))


def test_packaging_again(spark, folders):
    package(spark, folders)
    (folders / "train/out/train/abnormal/edf/mh_2020_1.edf").write_bytes(b"changed")
    again = package(spark, folders)
    assert {r.status: r.n for r in again.copy_log.groupBy("status").agg(F.count("*").alias("n")).collect()} == {
        "already_exists": 6, "missing": 1}
    assert whole(folders)["train/abnormal/edf/mh_2020_1.edf"] == b"changed"
    package(spark, folders, overwrite=True)
    assert whole(folders)["train/abnormal/edf/mh_2020_1.edf"] == b"one" and len(whole(folders)) == 6


def test_release_as_it_should_be(spark, folders):
    rows = [r for r in ROWS if r[1] in (1, 2)]
    root = str(folders / "good")
    pipelines.package_release(spark, raw(spark, rows), str(folders / "src"), root, COUNTS, FILE_COUNTS)
    counts = {k: v for k, v in COUNTS.items() if k != ("train", "Normal")}
    files = {k: v for k, v in FILE_COUNTS.items() if k[:2] != ("train", "Normal")}
    check = pipelines.verify_release(spark, raw(spark, rows), root, counts, files)
    assert check.verdict.first().verdict == "SUCCESS"


def test_nothing_to_package(spark, folders):
    done = pipelines.package_release(spark, raw(spark, []), str(folders / "src"), str(folders / "none"), COUNTS, FILE_COUNTS)
    assert done.copy_log.count() == 0 and {r.actual_count for r in done.folder_counts.collect()} == {0}
    check = pipelines.verify_release(spark, raw(spark, []), str(folders / "none"), COUNTS, FILE_COUNTS)
    assert check.matched.count() == 0 and check.verdict.first().verdict == "CHECK REQUIRED"


def test_a_failed_copy_leaves_no_file(spark, folders):
    plan = spark.createDataFrame([("file:" + str(folders / "src/absent.edf"), "train/x.edf")], "source_path string, destination_path string")
    with pytest.raises(Exception):
        tables.copy_files(plan, str(folders / "part"))
    assert not [p for p in (folders / "part").rglob("*") if p.is_file()]


def test_release_folders_by_their_first_names(spark):
    files = spark.createDataFrame([("train/normal/edf/a.edf", "edf", "a"), ("train/normal/annotations/a.csv", "annotation", "a"),
                                   ("x/train/normal/edf/a.edf", "edf", "a"), ("train/normal/edf/a.txt", "report", "a")],
                                  "path string, modality string, stem string").withColumns({"split": F.lit("?"), "label": F.lit("?")})
    assert [(r.path, r.split, r.label) for r in ln.in_release_folders(files).collect()] == [("train/normal/edf/a.edf", "train", "Normal")]


def pack(folder, inner=""):
    """The files below a folder, but for every third, in two ZIP archives that lie there."""
    names = sorted(p for p in folder.rglob("*") if p.is_file())
    for k in (0, 1):
        with zipfile.ZipFile(folder / inner / f"part{k}.ZIP", "w") as z:
            for p in names[k::3]:
                z.write(p, str(p.relative_to(folder / inner)))
    for p in [*names[::3], *names[1::3]]:
        p.unlink()


def test_release_in_archives(spark, folders):
    """Files in archives count like files of their own, in every report; copies come from both."""
    loose = package(spark, folders)
    want, log = whole(folders), sorted(map(repr, loose.copy_log.collect()))
    reports = {f: sorted(map(repr, getattr(loose, f).collect())) for f in ("missing", "duplicate_sources", "recording_counts", "folder_counts")}
    pack(folders / "src")
    assert len(list((folders / "src").rglob("*.ZIP"))) == 2
    root = str(folders / "train" / "new")
    done = pipelines.package_release(spark, raw(spark), str(folders / "src"), root, COUNTS, FILE_COUNTS, archives=True)
    new = folders / "train" / "new"
    assert {str(p.relative_to(new)): p.read_bytes() for p in new.rglob("*") if p.is_file()} == want
    assert sorted(map(repr, done.copy_log.collect())) == log
    assert {f: sorted(map(repr, getattr(done, f).collect())) for f in reports} == reports

    check = lambda **more: {f.name: sorted(map(repr, getattr(pipelines.verify_release(
        spark, raw(spark), root, COUNTS, FILE_COUNTS, **more), f.name).drop("uri", "length", "modificationTime", "place", "at").collect()))
        for f in fields(pipelines.ReleaseCheck)}
    before = check()
    pack(new)
    assert check(archives=True) == before != check()
    sums = {r.path: r.digest for r in integrity.checksum_folder(spark, root, archives=True).collect()}
    assert sums == {n: hashlib.sha256(c).hexdigest() for n, c in want.items()}

    # what an archive of the release holds is there already, and cannot be replaced
    again = pipelines.package_release(spark, raw(spark), str(folders / "src"), root, COUNTS, FILE_COUNTS, archives=True)
    assert {r.status for r in again.copy_log.collect()} == {"already_exists", "missing"}
    with pytest.raises(ValueError, match="cannot be overwritten"):
        pipelines.package_release(spark, raw(spark), str(folders / "src"), root, COUNTS, FILE_COUNTS, overwrite=True, archives=True)


def test_release_of_many_small_files_takes_few_files(spark, tmp_path):
    """A release of 2828 files, most in folders of their own, takes some archives and one loose file in 64."""
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 700 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(700).selectExpr("id AS c_custkey", "0.5D AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    h = Hosts(spark, str(tmp_path))
    root = io_queries._release_folder(h)
    found = {r.path for r in pipelines.release_inventory(spark, root, True).collect()}
    assert found == {r.path.removeprefix("/release/") for r in h.files().collect()} and len(found) > 2800
    assert sum(len(d) + len(f) for _, d, f in os.walk(root.removeprefix("file:"))) < 300
    # the release that is packaged: the copies, and the recordings in place before
    packaged = tmp_path / "out"
    io_queries._old_recordings(h, str(packaged))
    old = h.files().where("path LIKE '%.EDF'").selectExpr("split_part(path, '/', -1)").distinct().count()
    assert tables.list_files(spark, str(packaged), True).count() == 4 * old
    assert sum(len(d) + len(f) for _, d, f in os.walk(packaged)) < old


def test_reports_of_paths_are_written_compressed(spark, folders):
    """Compressed reports read as they do without, and take less of the disk."""
    done = package(spark, folders)
    read = lambda name: sorted(map(repr, spark.read.option("sep", "\t").option("header", True).csv(str(folders / name)).collect()))
    size = lambda name: sum(p.stat().st_size for p in (folders / name).rglob("part-*"))
    pipelines.write_reports(done, str(folders / "plain"))
    pipelines.write_reports(done, str(folders / "small"), compression="gzip")
    for f in fields(pipelines.Packaging):
        assert read(f"plain/{f.name}") == read(f"small/{f.name}")
    assert not list((folders / "small").rglob("*.csv")) and not list((folders / "plain").rglob("*.gz"))
    tables.write_table(done.copy_log.crossJoin(spark.range(200)).coalesce(1), str(folders / "long"))
    tables.write_table(done.copy_log.crossJoin(spark.range(200)).coalesce(1), str(folders / "long.gz"), compression="gzip")
    assert read("long") == read("long.gz") and size("long.gz") * 5 < size("long")


def test_small_copies_in_archives(spark, folders):
    """Small copies lie in archives, in every report like files of their own; larger ones, and those that replace a file, do not."""
    loose = package(spark, folders)
    want = whole(folders)
    reports = lambda done: {f.name: sorted(map(repr, getattr(done, f.name).collect())) for f in fields(pipelines.Packaging)}
    new = folders / "train" / "new"
    make = lambda **more: pipelines.package_release(
        spark, raw(spark), str(folders / "src"), str(new), COUNTS, FILE_COUNTS, archives=True, **more)
    replaced = new / "train/abnormal/annotations/mh_2020_1.csv"
    replaced.parent.mkdir(parents=True)
    replaced.write_bytes(b"old")
    done = make(pack_below=5, overwrite=True)
    assert reports(done) == reports(loose)
    own = {str(p.relative_to(new)): p.read_bytes() for p in new.rglob("*") if p.is_file() and p.suffix != ".zip"}
    assert own == {k: v for k, v in want.items() if len(v) >= 5 or k == str(replaced.relative_to(new))} and len(own) == 3
    held = {}
    for p in new.rglob("*.zip"):
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and not held.keys() & set(z.namelist())
            held |= {i.filename: z.read(i) for i in z.infolist()}
    assert held == {k: v for k, v in want.items() if k not in own}
    sums = {r.path: r.digest for r in integrity.checksum_folder(spark, str(new), archives=True).collect()}
    assert sums == {n: hashlib.sha256(c).hexdigest() for n, c in want.items()}
    again = make(pack_below=5)
    assert {r.status for r in again.copy_log.collect()} == {"already_exists", "missing"} and len(list(new.rglob("*.zip"))) <= len(held)
    with pytest.raises(ValueError, match="archives=True"):
        pipelines.package_release(spark, raw(spark), str(folders / "src"), str(new), COUNTS, FILE_COUNTS, pack_below=5)


def test_packaging_many_small_files_takes_few_files(spark, tmp_path):
    """The query's copies: some archives beside one recording in 64 that was there before, and all of them counted and hashed."""
    spark.range(9000).selectExpr("id AS o_orderkey", "id % 900 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(900).selectExpr("id AS c_custkey", "0.5D AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    rows = QUERIES["package_release"](Hosts(spark, str(tmp_path))).collect()
    copied = [r for r in rows if r.status == "copied"]
    assert len(copied) > 400 and all(r.digest == hashlib.sha256(f"/release/{r.source}".encode()).hexdigest() for r in copied)
    [root] = [f"{base}/{d}" for d in set(os.listdir(base)) - before if d.startswith("packaged-")]
    assert sum(len(d) + len(f) for _, d, f in os.walk(root)) < len(copied) / 4
