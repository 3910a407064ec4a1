"""Cases that an earlier version lost."""

import hashlib
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import channels
from cohortflow.operators import evaluation, integrity, linkage, ranking, signal, split, statistics
from cohortflow.plans import io_queries, pipelines
from cohortflow.plans.hosts import Hosts
from cohortflow.shared import shared_path, stored
from cohortflow.sources import edf, tables

from .test_files import edf_bytes


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffFile Start ,Start time,End time,Channel names,Comment\n1,2,3,C3,x\n", encoding="utf-8")
    assert tables.read_annotations(spark, str(tmp_path)).first().file_start == "1"
    (tmp_path / "m.tsv").write_text("\ufeffFile Name\tDate\nx.edf\t1\n", encoding="utf-8")
    assert tables._text_csv(spark, str(tmp_path / "m.tsv"), "\t").columns == ["File Name", "Date"]


def test_long_channel_lists_stay_whole(spark):
    names = [f"CHANNEL{i:03d}" for i in range(100)]
    n, text = channels.set_difference(channels.vocabulary(names), F.array().cast("array<string>"))
    assert tuple(spark.range(1).select(n, text).first()) == (100, " ".join(names))


def test_duplicates_outside_release_folders(spark):
    files = spark.createDataFrame([(None, None, "recording", "a", "x/a.edf"), (None, None, "recording", "a", "y/a.edf")],
                                  "split string, label string, modality string, stem string, path string")
    assert linkage.duplicate_files(files).count() == 2 and linkage.duplicate_pairs(files).count() == 1


def test_channel_deviation_over_chunks(spark):
    chunks = spark.createDataFrame([("f", "C3", [1.0, 2.0, 6.0]), ("f", "C3", [1e3, -5.0]), ("f", "C4", [3.0]), ("f", "C4", [])],
                                   "file_id string, channel string, samples array<float>")
    want = {r.channel: r.s for r in chunks.select("channel", F.explode("samples").alias("x")).groupBy("channel").agg(F.stddev_pop("x").alias("s")).collect()}
    got = {r.channel: r["std"] for r in signal.channel_deviation(chunks).collect()}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_stored_tables_lie_in_the_shared_folder(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stored(spark.range(3).where("id > 5"), "empty").count() == 0


def test_crop_fetches_its_records_only(spark, tmp_path, monkeypatch):
    """Ten records of a second, two channels of 200 Hz: a crop of 1.5 s is two records of 800 bytes."""
    x = np.arange(2000) % 100
    (tmp_path / "a.edf").write_bytes(edf_bytes([x, -x]))
    ranges = edf.record_ranges(edf._read_heads(spark, str(tmp_path)), 1.5)
    fetched, read = [], edf._read_range
    monkeypatch.setattr(edf, "_read_range", lambda path, begin, size: fetched.append((begin, size)) or read(path, begin, size))
    frames = list(edf._fetch(1.5)(ranges.toArrow().to_batches()))
    assert fetched == [(256 * 3, 2 * 800)] and len(frames) == 1
    got = {s["channel"]: s for s in frames[0].column("signals").to_pylist()[0]}
    assert [len(s["samples"]) for s in got.values()] == [301, 301]
    chunks = edf.record_ranges(edf._read_heads(spark, str(tmp_path)), None, 4.0).select("chunk", "first", "take").collect()
    assert sorted(map(tuple, chunks)) == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    # with a halo of two seconds a chunk fetches two records of the next one, the last none
    fetched.clear()
    halo = edf.record_ranges(edf._read_heads(spark, str(tmp_path)), None, 4.0, 2.0)
    frames = [f.to_pylist()[0] for f in edf._fetch(None)(halo.orderBy("chunk").toArrow().to_batches())]
    assert fetched == [(768, 6 * 800), (768 + 4 * 800, 6 * 800), (768 + 8 * 800, 2 * 800)]
    assert [(s["start"], s["own"], len(s["samples"])) for f in frames for s in f["signals"][:1]] == [
        (0, 800, 1200), (800, 800, 1200), (1600, 400, 400)]
    tasks = edf.read_edf_frames(spark, str(tmp_path), chunk_sec=1.0).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 2


def test_listing_sees_every_name(spark, tmp_path):
    """Names and folders that begin with ``_`` or ``.``, and characters that URLs escape."""
    names = ["a.edf", "_b.edf", ".c.edf", "_x/d.EDF", "x y/.z/e+f%20.edf", "x y/g.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(edf_bytes([np.arange(400)]))
    (tmp_path / "empty").mkdir()
    found = tables.scan_files(spark, str(tmp_path), ("edf",)).collect()
    assert {r.path for r in found} == {f"file:{tmp_path}/{n}" for n in names[:5]} and {r.length for r in found} == {512 + 800}
    heads = {r.file_id: r.status for r in edf.read_edf_headers(spark, str(tmp_path)).collect()}
    assert heads == dict.fromkeys(["a", "_b", ".c", "d", "e+f%20"], "Valid")


def test_jobs_from_files(spark, tmp_path):
    """Features and channel quality from a folder; only the scalp channels count."""
    t = np.arange(2000) / 200
    (tmp_path / "train/normal").mkdir(parents=True)
    wave = lambda f: 500 * np.sin(2 * np.pi * f * t)
    (tmp_path / "train/normal/a.edf").write_bytes(edf_bytes([wave(10), wave(3)]))
    root = str(tmp_path)
    rows = {r.channel: r for r in pipelines.check_channels(spark, root, chunk_sec=3.0).channels.collect()}
    whole = {r.channel: r for r in pipelines.check_channels(spark, root).channels.collect()}
    assert set(rows) == set(whole) and rows
    for c, r in rows.items():
        assert r.snr_db == pytest.approx(whole[c].snr_db) and r.alpha_peak_hz == whole[c].alpha_peak_hz
    file = pipelines.check_channels(spark, root, chunk_sec=3.0).files.first()
    assert (file.split, file.label, file.sfreq) == ("train", "Normal", 200.0) and file.mean_snr_db is not None
    got = pipelines.extract_features(spark, root, tmax=5.0).first()
    assert got.Alpha_Peak_Hz == 10.0 and got.split == "train"


def test_more_labels_than_bits(spark):
    order = [f"L{i:03d}" for i in range(130)]
    rows = [("a", "L000"), ("a", "L059"), ("a", "L060"), ("a", "L129"), ("b", "L129"), ("b", "L129"), ("b", None), ("c", "other")]
    masks = statistics.label_masks(spark.createDataFrame(rows, "file_id string, label string"), "label", order)
    sets = {r.file_id: r.labels for r in masks.select("file_id", statistics.mask_labels(F.col("mask"), order).alias("labels")).collect()}
    assert sets == {"a": ["L000", "L059", "L060", "L129"], "b": ["L129"]}
    pairs = statistics.label_cooccurrence(masks, order).collect()
    assert len(pairs) == 6 and {(r.label_a, r.label_b) for r in pairs} >= {("L000", "L059"), ("L060", "L129")}


def test_percentiles_inside_one_bucket(spark, monkeypatch):
    """All values lie in one bucket, which is split many times; a null key and a constant key beside it."""
    monkeypatch.setattr(ranking, "PART_VALUES", 16)
    x = np.random.default_rng(1).beta(0.3, 5, 3000)
    rows = [(k, float(v)) for k in ("a", None) for v in x] + [("b", 0.25)] * 5
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in statistics.box_stats(df, ["k"], "v", 1000.0).collect()}
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    for k in ("a", None):
        assert np.allclose([got[k].q1, got[k].median, got[k].q3], [q1, q2, q3], rtol=1e-12)
        assert got[k].whisker_high == x[x <= q3 + 1.5 * (q3 - q1)].max() and got[k].n == 3000
    assert (got["b"].q1, got["b"].whisker_low, got["b"].n) == (0.25, 0.25, 5)


def test_roc_of_crowded_and_unbounded_scores(spark):
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.random(500) * 1e-9, rng.normal(0, 1e6, 500)])
    y = rng.integers(0, 2, 1000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(None, 1)], "score double, y int")
    rows = evaluation.score_cumulation(df, 8).collect()
    assert len(rows) == 1001
    for r in rows:
        assert r.tp == (y[s >= r.score].sum() if r.score is not None else y.sum() + 1)


def test_checksums_of_a_folder(spark, tmp_path):
    """The root's own name is an excluded one; excluded names below it are left out."""
    root = tmp_path / "sha256.txt"
    for name in ("a/x 1.edf", "b+c.csv", "copy_log.csv", "a/Thumbs.db"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * 1000)
    want = {n: hashlib.sha256(n.encode() * 1000).hexdigest() for n in ("a/x 1.edf", "b+c.csv")}
    manifest = integrity.checksum_folder(spark, str(root))
    assert {r.path: r.digest for r in manifest.collect()} == want
    tables.write_checksum_text(manifest, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [f"{d}  {p}" for p, d in sorted(want.items())]


CSV_PIECES = ["a", "é", ",", "\n", "\r\n", "\r", '"', '""', '"x,\ny"', "word", " ", "\n\n"]


def test_annotation_blocks(spark, tmp_path):
    """Blocks of any size give the rows of the whole text: quotes, lines inside cells, empty lines, a quote without partner."""
    rnd = random.Random(11)
    texts = ["", "﻿Comment,File Start\n1,2\n", "Comment", "\n\nComment\r\n\r\nx\r\n", 'Comment\n"a\nb"\n"c', 'Comment\n"\n"\n"\n']
    for _ in range(60):
        texts.append("Comment, End time\n" + "".join(rnd.choice(CSV_PIECES) for _ in range(rnd.randint(0, 60))))
    for i, t in enumerate(texts):
        (tmp_path / f"_{i}.csv").write_bytes(t.encode())
    whole = spark.createDataFrame([(f"file:/x/_{i}.csv", t) for i, t in enumerate(texts)], "path string, value string")
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(tables.parse_annotations(whole))
    assert len(want) > 100
    for size in (1, 7, 50, 1 << 20):
        assert key(tables.read_annotations(spark, str(tmp_path), block_bytes=size)) == want, size
    parts = tables.read_annotations(spark, str(tmp_path), block_bytes=7).select(F.spark_partition_id()).distinct().count()
    assert parts > 4


def test_annotations_in_archives(spark, tmp_path):
    """Files in archives give the rows of files of their own, whatever the size of the blocks."""
    rnd = random.Random(5)
    for i in range(40):
        (tmp_path / "loose" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / f"d{i % 3}" / f"_{i}.csv").write_bytes((rnd.choice(("", "\ufeff")) + "Comment, End time\n" + "".join(
            rnd.choice(CSV_PIECES) for _ in range(rnd.randint(0, 60)))).encode())
    names = sorted(p for p in (tmp_path / "loose").rglob("*.csv"))
    for k in (0, 1):
        (tmp_path / "packed" / f"sub{k}").mkdir(parents=True)
        with zipfile.ZipFile(tmp_path / "packed" / f"sub{k}" / "a.zip", "w") as z:
            for p in names[k::3]:
                z.write(p, str(p.relative_to(tmp_path / "loose")))
    for p in names[2::3]:
        (tmp_path / "packed" / p.name).write_bytes(p.read_bytes())
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(tables.read_annotations(spark, str(tmp_path / "loose")))
    assert len(want) > 60
    for size in (7, 50, 1 << 20):
        assert key(tables.read_annotations(spark, str(tmp_path / "packed"), block_bytes=size, archives=True)) == want, size
    assert len(tables.read_annotations(spark, str(tmp_path / "packed")).select("file_id").distinct().collect()) < 15
    with zipfile.ZipFile(tmp_path / "packed" / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "Comment\nx\n")
    with pytest.raises(Exception, match="only files stored as they are"):
        tables.read_annotations(spark, str(tmp_path / "packed"), archives=True)


def test_files_of_one_block_are_read_once(spark, tmp_path, monkeypatch):
    """Only files of several blocks pass through the count of quotes; the query keeps its small files in archives."""
    (tmp_path / "a.csv").write_text('Comment\n"x\ny"\nz\n')
    (tmp_path / "b.csv").write_text('Comment\n' + "".join(f'"{i}\n"\n' for i in range(50)))
    seen = []
    monkeypatch.setattr(tables, "stored", lambda df, name: seen.append(stored(df, name)) or seen[-1] if name == "csv-blocks" else stored(df, name))
    got = tables.read_annotations(spark, str(tmp_path), block_bytes=100)
    assert {r.path.rsplit("/", 1)[1] for r in seen[0].collect()} == {"b.csv"}
    assert {r.file_id: r.n for r in got.groupBy("file_id").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 50}

    spark.range(4000).selectExpr("id AS event_id", "id % 90 AS user_id", "1.5D AS value").write.parquet(str(tmp_path / "sf" / "events.parquet"))
    roots = []
    monkeypatch.setattr(io_queries, "shared_path", lambda s, name: roots.append(str(tmp_path / name)) or roots[-1])
    rows = io_queries.query.__globals__["QUERIES"]["read_annotations"](Hosts(spark, str(tmp_path / "sf")))
    assert rows.count() == 4000
    assert sum(len(f) + len(d) for _, d, f in os.walk(roots[0])) < 300  # 1800 files


def test_share_targets_follow_the_data(spark):
    rows = spark.createDataFrame([(str(i), "Normal" if i % 3 else "Abnormal", f"s{i % 4}") for i in range(400)], "stem string, label string, stratum string")
    for part in (rows, rows.where("int(stem) < 30")):
        counts = split.stratum_counts(part)
        targets = split.share_targets(counts, {"train": 50, "evaluation": 20})
        plan = split.plan_split(counts, targets)
        done = split.check_targets(split.assign_split(split.select_records(part, plan), plan), targets).collect()
        size = {r.label: r["count"] for r in part.groupBy("label").count().collect()}
        assert {(r.split, r.label): r.n for r in done} == {
            (s, c): n * p // 100 for c, n in size.items() for s, p in (("train", 50), ("evaluation", 20))}


def test_folder_is_verified_by_streams(spark, tmp_path):
    for name in ("a.txt", "_b.txt", "sub/.c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 1000)
    stored_ = integrity.checksum_folder(spark, str(tmp_path))
    assert {r.path: r.digest for r in stored_.collect()} == {
        n: hashlib.sha256(n.encode() * 1000).hexdigest() for n in ("a.txt", "_b.txt", "sub/.c.txt")}
    rows = spark.createDataFrame([*stored_.collect(), ("0", "lost.txt")], "digest string, path string")
    (tmp_path / "_b.txt").write_text("changed")
    found = integrity.verify_folder(spark, str(tmp_path), rows)
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.path: r.status for r in found.collect()} == {
        "a.txt": "OK", "_b.txt": "MISMATCH", "sub/.c.txt": "OK", "lost.txt": "MISSING"}
    uris = spark.createDataFrame([("hdfs://data/data/x/a",), ("hdfs://data/x/a",)], "path string")
    assert [r.path for r in integrity.relative_paths(uris, "hdfs://data/data").collect()] == ["x/a"]
