"""Readers and writers on real files."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import events as ev, integrity, signal as sg
from cohortflow.plans import pipelines
from cohortflow.sources import edf, tables

NAMES = ["FP1", "fp 2", "O1"]


def edf_bytes(waves, fs=200, records=None, ns_text=None, phys_min="-100", unit="uV"):
    """A small EDF file: one-second records, digital range equal to a tenth of a unit."""
    n, count = len(waves), len(waves[0]) // fs
    field = lambda values, width: b"".join(str(v).encode().ljust(width) for v in values)
    head = (field(["0"], 8) + field(["X", "X"], 80) + field(["01.01.20", "00.00.00"], 8)
            + field([256 * (n + 1)], 8) + field([""], 44)
            + field([count if records is None else records], 8) + field(["1"], 8)
            + (ns_text or field([n], 4)))
    head += (field(NAMES[:n], 16) + field([""] * n, 80) + field([unit] * n, 8)
             + field([phys_min] * n, 8) + field(["100"] * n, 8) + field(["-1000"] * n, 8)
             + field(["1000"] * n, 8) + field([""] * n, 80) + field([fs] * n, 8) + field([""] * n, 32))
    data = b"".join(
        np.round(np.asarray(w[r * fs:(r + 1) * fs]) * 10).astype("<i2").tobytes()
        for r in range(count) for w in waves)
    return head + data


@pytest.fixture(scope="module")
def waves():
    t = np.arange(600) / 200
    return [np.round(50 * np.sin(2 * np.pi * f * t), 1) for f in (10, 4, 20)]


@pytest.fixture(scope="module")
def release(tmp_path_factory, waves):
    root = tmp_path_factory.mktemp("release")
    good = edf_bytes(waves)
    files = {
        "train/abnormal/mh_2020_1.edf": good,
        "train/normal/mh 2020+2.EDF": edf_bytes(waves[:2]),
        "eval/normal/mh_2020_3.edf": edf_bytes(waves, records=-1),
        "eval/normal/volts.edf": edf_bytes(waves, unit="V"),
        "bad/null.edf": good[:184] + b"\x00" * 8 + good[192:],
        "bad/words.edf": edf_bytes(waves, ns_text=b"abc "),
        "bad/float.edf": edf_bytes(waves, phys_min="x"),
        "bad/short.edf": good[:100],
        "bad/cut.edf": good[:400],
        "bad/partial.edf": good[:-500],
        "notes/readme.txt": b"no recording",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root, files


def test_headers(spark, release):
    root, _ = release
    rows = {r.file_id: r for r in edf.read_edf_headers(spark, str(root)).collect()}
    assert len(rows) == 10
    one = rows["mh_2020_1"]
    assert (one.status, one.sfreq, one.n_samples) == ("Valid", 200.0, 600)
    assert one.duration_sec == pytest.approx(599 / 200) and one.channels == ["FP1", "FP2", "O1"]
    assert rows["mh_2020_3"].n_samples == 600
    assert rows["partial"].n_records == 2
    status = {k: r.status for k, r in rows.items() if r.status != "Valid"}
    assert status == {"null": edf.NULL_BYTES, "words": edf.NULL_BYTES, "float": "ValueError",
                      "short": "Other Error", "cut": "Other Error"}
    assert "mh 2020+2" in rows


def test_header_only_equals_whole_file(spark, release):
    root, _ = release
    cols = ["file_id", "status", "sfreq", "n_samples", "dur_ms", "channels"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][dD][fF]").load(str(root))
    whole = edf.parse_headers(files.select("path", "length", "content"))
    a = {tuple(map(str, r)) for r in edf.read_edf_headers(spark, str(root)).select(cols).collect()}
    assert a == {tuple(map(str, r)) for r in whole.select(cols).collect()}


@pytest.mark.parametrize("chunk", [None, 1.0])
def test_samples(spark, release, waves, chunk):
    root, _ = release
    rows = edf.read_edf_signals(spark, str(root), chunk_sec=chunk).where(
        "file_id = 'mh_2020_1'").orderBy("channel", "start").collect()
    for i, name in enumerate(NAMES):
        x = np.concatenate([r.samples for r in rows if r.channel == name])
        np.testing.assert_allclose(x, waves[i], atol=1e-4)
    volts = edf.read_edf_signals(spark, str(root)).where("file_id = 'volts' AND channel = 'O1'")
    np.testing.assert_allclose(volts.first().samples, waves[2] * 1e6, rtol=1e-5, atol=1)


def test_cropped_read(spark, release):
    root, _ = release
    rows = edf.read_edf_signals(spark, str(root), tmax=1.5, chunk_sec=1.0).where(
        "file_id = 'mh_2020_1' AND channel = 'O1'").collect()
    assert sum(len(r.samples) for r in rows) == 301 and {r.n_samples for r in rows} == {301}


def test_assess_signals(spark, release):
    root, _ = release
    whole = pipelines.assess_signals(spark, str(root / "train"))
    rows = {r.file_id: r for r in whole.collect()}
    assert set(rows) == {"mh_2020_1", "mh 2020+2"}
    assert rows["mh_2020_1"].group == "Abnormal" and rows["mh_2020_1"].subset == "train"
    parts = {r.file_id: r for r in pipelines.assess_signals(
        spark, str(root / "train"), chunk_sec=1.0).collect()}
    for k, r in rows.items():
        assert parts[k].snr == pytest.approx(r.snr)
        assert parts[k].Delta == pytest.approx(r.Delta)
        assert parts[k].correlation == pytest.approx(r.correlation)


def test_inventory(spark, release):
    root, _ = release
    files = tables.scan_files(spark, str(root), ("edf",))
    assert files.count() == 10
    found = {r.file_id: (r.split, r.label) for r in tables.scan_recordings(files).collect()}
    assert found["mh_2020_1"] == ("train", "abnormal")
    assert found["mh_2020_3"] == ("test", "normal") and "null" not in found
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string" in plan
    assert "content" not in plan.split("ReadSchema")[1]


ANNOTATIONS = {
    "a.csv": 'Gender,Age,File Start,Start time,End time,Channel names,Comment\n'
             'male,34,23:59:50:000,23:59:59:000,00:00:01:500,"FP1, O1",spike\n'
             ',,,00:00:05:000,00:00:06:000,FP1 FP2,"said ""delta"", twice"\n'
             '\n'
             ',,,bad,00:00:09:000,,NA\n',
    "b.csv": 'Comment,End time, Start time \r\n'
             '"two\nlines",00:00:03:000,00:00:01:000\r\n'
             'slow,00:00:05:000',
    "deep/c.csv": "File Start,Start time,End time,Channel names,Comment\n",
    "skip.txt": "Comment\nx\n",
}


def test_annotations(spark, tmp_path):
    for name, content in ANNOTATIONS.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    rows = {(r.file_id, r.row_no): r for r in tables.read_annotations(spark, str(tmp_path)).collect()}
    assert len(rows) == 5
    assert rows[("a", 1)].comment == 'said "delta", twice' and rows[("a", 1)].file_start is None
    assert rows[("a", 0)].channel_names == "FP1, O1"
    last = [r for (f, n), r in rows.items() if f == "a" and r.start_time == "bad"][0]
    assert last.comment is None and last.channel_names is None
    assert rows[("b", 0)].comment == "two\nlines" and rows[("b", 0)].start_time == "00:00:01:000"
    assert rows[("b", 1)].start_time is None and rows[("b", 1)].channel_names is None
    ids = {r.file_id for r in tables.annotation_ids(spark, str(tmp_path)).collect()}
    assert ids == {"a", "b", "c"}
    times = ev.event_times(ev.ffill_file_start(
        tables.read_annotations(spark, str(tmp_path)).where("file_id = 'a'"))).orderBy("row_no")
    got = [(r.start_ms, r.end_ms) for r in times.collect()]
    assert got == [(9000, 11500), (15000, 16000), (None, 19000)]


def test_validation_from_disk(spark, release, tmp_path):
    """Events of one readable recording, one without a recording, one empty file."""
    head = "File Start,Start time,End time,Channel names,Comment\n"
    texts = {
        "mh_2020_1": head + "10:00:00:000,10:00:00:500,10:00:01:500,FP1 XX,spike\n"
                            ",10:00:01:000,10:00:09:000,FP1,delta\n,bad,10:00:01:000,FP1,delta\n",
        "lost": head + "10:00:00:000,10:00:01:000,10:00:02:000,FP1,spike\n",
        "mh_2020_3": head,
    }
    for name, content in texts.items():
        (tmp_path / f"{name}.csv").write_text(content)
    root, _ = release
    rows = tables.read_annotations(spark, str(tmp_path))
    headers = edf.read_edf_headers(spark, str(root))
    result = pipelines.validate_annotations(rows, headers)
    summary = result.files.collect()
    assert len(summary) == 1
    s = summary[0]
    assert (s.file_id, s.split, s.n_events, s.n_valid_events) == ("mh_2020_1", "train", 3, 1)
    assert (s.n_rows_invalid_time, s.n_rows_invalid_channels) == (2, 1)
    assert s.median_ms == 1000.0
    assert {(r.label, r.n) for r in result.label_counts.collect()} == {("Spike and Wave", 1)}
    reasons = {r.invalid_reason for r in ev.invalid_rows(result.events).collect()}
    assert reasons == {"end_exceeds_edf", "parse_failed_or_missing_time"}
    assert [r.excess_ms for r in result.excess.collect()] == [9000 - 2995]
    ids = tables.annotation_ids(spark, str(tmp_path))
    empty = tables.empty_annotations(ids, rows)
    check = ev.check_table(ev.checked_events(rows), empty).first()
    assert (check.annotated_files, check.empty_files, check.total_events) == (2, 1, 4)
    mapping = {r.file_id: (r.has_readable_edf, r.has_csv) for r in result.mapping.collect()}
    assert mapping["lost"] == (False, True) and mapping["volts"] == (True, False)


def test_manifest(spark, tmp_path):
    path = tmp_path / "recordings.tsv"
    path.write_text(" File Name \tDate\tGender\tAge (Years)\tAge (Months)\tLabel (Normal/Abnormal)\n"
                    'x.edf\t\tmale\tNA\t6\tNormal\n')
    row = tables.read_manifest(spark, str(path)).first()
    assert row["Date"] == "" and row["Age (Years)"] == "NA" and row["File Name"] == "x.edf"
    with pytest.raises(ValueError, match="missing required columns"):
        tables.read_manifest(spark, str(path), tables.RELEASE_COLUMNS)


def test_checksums(spark, release, tmp_path):
    root, files = release
    spark_files = spark.read.format("binaryFile").option(
        "recursiveFileLookup", True).load(str(root)).select(
        F.regexp_replace("path", f"^file:/*{root}/", "").alias("path"), "content")
    named = spark_files.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    got = {r.path: r.digest for r in integrity.sha256_manifest(named).collect()}
    assert len(got) == len(files)
    for name, content in files.items():
        digest = hashlib.sha256(content).hexdigest()
        assert digest in got.values(), name
    out = str(tmp_path / "sums")
    tables.write_checksum_text(integrity.sha256_manifest(named), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(f"{d}  {p}" for p, d in got.items())
    assert {r.status for r in integrity.verify_checksums(
        integrity.sha256_manifest(named), named).collect()} == {"OK"}
