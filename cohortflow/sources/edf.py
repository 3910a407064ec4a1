"""EDF recordings: headers without samples, and samples as frames.

Header fields are fixed-width text, so they are cut out of the bytes by built-in
expressions. Only the samples need Python: an Arrow kernel fetches the int16
records of a file by byte range and turns them into channel arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.binding import computed_once
from ..functions.channels import EXPECTED_22, norm_channel, set_difference, vocabulary
from ..operators.signal import frames_to_signals
from .tables import clean_id, describe_paths, list_files, open_store

# Width in bytes of the per-signal header fields, in file order.
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8),
                 ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("prefilter", 80),
                 ("samples", 8), ("reserved", 32))
# Micro-volts per unit of the physical dimension; others stay as is.
MICROVOLTS = {"uv": 1.0, "µv": 1.0, "mv": 1e3, "v": 1e6, "nv": 1e-3}
NULL_BYTES = "Critical Header Corruption (Null Bytes)"

_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _field(at, width) -> Column:
    """Text of ``width`` header bytes from the 0-based position ``at``."""
    begin = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.decode(F.substring(F.col("content"), begin, F.lit(width)), "ISO-8859-1")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _number(text: Column, pattern: str, kind: str) -> Column:
    return F.when(_trim(text).rlike(pattern), _trim(text).try_cast(kind))


def _per_signal(name: str) -> Column:
    """Array with the texts of one field, one per signal."""
    before = 0
    for field, width in SIGNAL_FIELDS:
        if field == name:
            break
        before += width
    base = F.lit(256) + F.col("_ns") * before
    return F.transform(F.sequence(F.lit(0), F.col("_ns") - 1),
                       lambda i: _field(base + i * width, width))


def parse_headers(files: DataFrame, keep_content: bool = False) -> DataFrame:
    """Header table of ``(path, length, content)``; content may be the head only.

    A header that cannot be read gets a status and an error instead of numbers,
    so no recording is lost.
    """
    ns = _number(_field(252, 4), _INT, "int")
    head = files.withColumn("_ns_text", _field(252, 4)).withColumn(
        "_ns", F.when(ns.between(1, 9999), ns))
    raw = computed_once(head, {
        "_hb": _field(184, 8), "_nr": _field(236, 8), "_rd": _field(244, 8),
        **{f"_{n}": F.when(F.col("_ns").isNotNull(), _per_signal(n))
           for n in ("label", "unit", "phys_min", "phys_max", "dig_min", "dig_max", "samples")},
    })
    as_int = lambda arr: F.transform(arr, lambda t: _number(t, _INT, "int"))
    as_float = lambda arr: F.transform(arr, lambda t: _number(t, _FLOAT, "double"))
    num = raw.withColumns({
        "header_bytes": _number(F.col("_hb"), _INT, "bigint"),
        "_records": _number(F.col("_nr"), _INT, "bigint"),
        "record_sec": _number(F.col("_rd"), _FLOAT, "double"),
        "spr": as_int(F.col("_samples")),
        "_pmin": as_float(F.col("_phys_min")), "_pmax": as_float(F.col("_phys_max")),
        "_dmin": as_float(F.col("_dig_min")), "_dmax": as_float(F.col("_dig_max")),
    })
    gap = lambda arr: F.exists(arr, lambda v: v.isNull())
    texts = F.concat("_ns_text", "_hb", "_nr", "_rd", *[
        F.coalesce(F.array_join(f"_{n}", ""), F.lit(""))
        for n in ("phys_min", "phys_max", "dig_min", "dig_max", "samples")])
    # a file that ends inside its header is short, whatever its fields say
    short = (F.length("content") < 256) | (
        F.length("content") < 256 + 256 * F.coalesce("_ns", F.lit(0)))
    bad_int = (F.col("_ns").isNull() | F.col("header_bytes").isNull()
               | F.col("_records").isNull() | F.coalesce(gap(F.col("spr")), F.lit(True)))
    bad_float = (F.col("record_sec").isNull() | gap(F.col("_pmin")) | gap(F.col("_pmax"))
                 | gap(F.col("_dmin")) | gap(F.col("_dmax")))
    status = (
        F.when(F.length("content") < 256, "Other Error")
        .when(texts.contains("\x00"), NULL_BYTES)
        .when(short, "Other Error")
        .when(bad_int, NULL_BYTES)
        .when(F.coalesce(bad_float, F.lit(True)), "ValueError")
        .when((F.col("record_sec") <= 0) | (F.aggregate(
            "spr", F.lit(0), lambda a, v: a + v) <= 0), "ValueError")
        .otherwise("Valid")
    )
    error = (F.when(F.col("status") == NULL_BYTES, "invalid literal for int() in the header")
             .when(F.col("status") == "ValueError", "could not convert a header field")
             .when(F.col("status") == "Other Error", "file ends inside the header"))
    ok = F.col("status") == "Valid"
    record_bytes = F.aggregate("spr", F.lit(0).cast("bigint"), lambda a, v: a + v) * 2
    present = F.floor((F.col("length") - F.col("header_bytes")) / record_bytes)
    names = F.transform("_label", _trim)
    # EDF+ keeps its annotations in a signal of its own, which is no channel
    kept = F.filter(F.sequence(F.lit(0), F.col("_ns") - 1),
                    lambda i: ~F.get(names, i).startswith("EDF Annotations"))
    unit_key = lambda i: F.lower(_trim(F.get(F.col("_unit"), i)))
    scale = F.create_map(*[F.lit(x) for pair in MICROVOLTS.items() for x in pair])

    def signal(i: Column) -> Column:
        gain = F.try_divide(
            F.get(F.col("_pmax"), i) - F.get(F.col("_pmin"), i),
            F.get(F.col("_dmax"), i) - F.get(F.col("_dmin"), i))
        gain = F.coalesce(gain, F.lit(1.0))
        units = F.coalesce(F.try_element_at(scale, unit_key(i)), F.lit(1.0))
        spr = F.get(F.col("spr"), i)
        return F.struct(
            F.get(names, i).alias("channel"), i.alias("index"), spr.alias("spr"),
            (spr / F.col("record_sec")).alias("sfreq"), (gain * units).alias("gain"),
            ((F.get(F.col("_pmin"), i) - F.get(F.col("_dmin"), i) * gain) * units)
            .alias("offset"))

    out = num.withColumn("status", status).withColumn("error", error)
    out = out.withColumn("signals", F.when(ok, F.transform(kept, signal)))
    # the size of the file decides when it disagrees with the record count
    out = out.withColumn("n_records", F.when(ok, F.greatest(present, F.lit(0)).cast("bigint")))
    out = out.withColumn("sfreq", F.array_max(F.transform("signals", lambda s: s["sfreq"])))
    out = out.withColumn("n_samples", F.round(
        F.col("n_records") * F.col("record_sec") * F.col("sfreq")).cast("bigint"))
    seconds = F.when(F.col("n_samples") > 0, (F.col("n_samples") - 1) / F.col("sfreq"))
    return out.select(
        clean_id(F.col("path")).alias("file_id"), "path", "length", "status", "error",
        "sfreq", "n_records", "record_sec", "n_samples", seconds.alias("duration_sec"),
        F.round(seconds * 1000).cast("bigint").alias("dur_ms"),
        F.transform("signals", lambda s: s["channel"]).alias("channel_names"),
        F.transform("signals", lambda s: norm_channel(s["channel"])).alias("channels"),
        "header_bytes", "spr", "signals", *(["content"] if keep_content else []))


def _read_range(path: str, begin: int, size: int) -> bytes:
    """``size`` bytes of a file from ``begin`` on; nothing else is fetched."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, begin)


def _heads(batches):
    """Arrow kernel: fetch only the header bytes of every path."""
    for batch in batches:
        heads = []
        for path in batch.column("path").to_pylist():
            store, name = open_store(path)
            with store.open_input_stream(name) as f:
                head = f.read(256)
                count = head[252:256].strip()
                heads.append(head + (f.read(256 * int(count)) if count.isdigit() else b""))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("length"), pa.array(heads, pa.binary())],
            names=["path", "length", "content"])


def read_edf_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers of all recordings below a folder; samples are not read.

    Split and class come from the folders a recording lies in.
    """
    return describe_paths(_read_heads(spark, root)).drop("stem", "ext", "modality")


def _read_heads(spark: SparkSession, root: str) -> DataFrame:
    listing = list_files(spark, root).where(F.lower("path").endswith(".edf")).select("path", "length")
    return parse_headers(listing.mapInArrow(_heads, "path string, length bigint, content binary"))


_FRAMES = ("file_id string, chunk bigint, signals array<struct<channel: string, sfreq: double, "
           "n_samples: bigint, start: bigint, own: bigint, samples: array<float>>>")
_SIGNAL = pa.struct([("channel", pa.string()), ("sfreq", pa.float64()),
                     ("n_samples", pa.int64()), ("start", pa.int64()), ("own", pa.int64()),
                     ("samples", pa.list_(pa.float32()))])


def _frame(row: dict, data: np.ndarray, chunk: int, first: int, tmax: float | None):
    """One frame of the records ``data`` from record ``first`` on, the own ones and the halo; None without own samples."""
    spr = [int(n) for n in row["spr"]]
    at = np.concatenate([[0], np.cumsum(spr)])
    signals = []
    for s in row["signals"]:
        k = s["index"]
        total = int(row["n_records"]) * spr[k]
        if tmax is not None:
            total = min(total, int(np.floor(tmax * s["sfreq"])) + 1)
        here = first * spr[k]
        x = data[:, at[k]:at[k + 1]].reshape(-1)[:max(total - here, 0)]
        if len(x):
            signals.append({
                "channel": s["channel"], "sfreq": s["sfreq"], "n_samples": total, "start": here,
                "own": min(int(row["take"]) * spr[k], len(x)),
                "samples": (x * s["gain"] + s["offset"]).astype(np.float32)})
    if not signals:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array([row["file_id"]]), pa.array([chunk], pa.int64()), pa.array([signals], pa.list_(_SIGNAL))],
        names=["file_id", "chunk", "signals"])


def record_ranges(headers: DataFrame, tmax: float | None = None, chunk_sec: float | None = None,
                  halo_sec: float = 0.0) -> DataFrame:
    """The records to fetch of each readable recording: ``chunk, first, take, fetch`` beside its header.

    One range per recording, or per ``chunk_sec`` seconds; records behind ``tmax`` are left out.
    A range owns ``take`` records and fetches the halo behind them too, as far as there is one.
    """
    wanted = F.col("n_records")
    if tmax is not None:
        samples = lambda s: F.floor(s["sfreq"] * F.lit(float(tmax))) + 1
        wanted = F.least(wanted, F.array_max(F.transform(
            "signals", lambda s: F.ceil(F.try_divide(samples(s), s["spr"])))))
    step = F.col("_wanted") if chunk_sec is None else F.greatest(
        F.floor(F.lit(float(chunk_sec)) / F.col("record_sec")), F.lit(1))
    rows = headers.where(F.size("signals") > 0).withColumn("_wanted", wanted).where("_wanted > 0")
    rows = rows.withColumn("_step", step.cast("bigint"))
    return rows.select(
        "file_id", "path", "header_bytes", "n_records", "record_sec", "spr", "signals", "_wanted", "_step",
        F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("_wanted") - 1, F.col("_step"))).alias("chunk", "first"),
    ).withColumn("take", F.least("_step", F.col("_wanted") - F.col("first"))).withColumn("fetch", F.least(
        F.col("take") + F.ceil(F.lit(float(halo_sec)) / F.col("record_sec")), F.col("_wanted") - F.col("first"))).drop("_wanted", "_step")


def _fetch(tmax: float | None):
    """Arrow kernel: read the bytes of each range and decode them to one frame."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = int(sum(row["spr"]))
                raw = _read_range(row["path"], int(row["header_bytes"]) + 2 * width * row["first"],
                                  2 * width * row["fetch"])
                data = np.frombuffer(raw, "<i2").reshape(-1, width)
                frame = _frame(row, data, row["chunk"], row["first"], tmax)
                if frame is not None:
                    yield frame
    return run


def read_edf_frames(spark: SparkSession, root: str, tmax: float | None = None,
                    chunk_sec: float | None = None, halo_sec: float = 0.0) -> DataFrame:
    """Frames of all recordings below a folder, fetched by byte range.

    A crop reads only its records. With ``chunk_sec`` the ranges of a recording are dealt to
    tasks of their own and a task holds one chunk at a time, however long a recording is;
    with ``halo_sec`` a chunk carries that much of the next ones, for windows that begin in it.
    """
    ranges = record_ranges(_read_heads(spark, root), tmax, chunk_sec, halo_sec)
    if chunk_sec is not None:
        # by number: rows of headers are small, and adaptive execution would put them together again
        ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "chunk")
    return ranges.mapInArrow(_fetch(tmax), _FRAMES)


def read_edf_signals(spark: SparkSession, root: str, tmax: float | None = None,
                     chunk_sec: float | None = None) -> DataFrame:
    return frames_to_signals(read_edf_frames(spark, root, tmax, chunk_sec)).drop("own")


def channel_inventory(headers: DataFrame, vocab=EXPECTED_22) -> DataFrame:
    """Missing and extra channels of every recording, as counts and text."""
    known, have = vocabulary(vocab), F.col("channels")
    n_missing, missing = set_difference(known, have)
    n_extra, extra = set_difference(have, known)
    return headers.withColumns({
        "n_channels": F.size(have).cast("bigint"),
        "missing_expected": n_missing, "extra_channels": n_extra,
        "missing_list": missing, "extra_list": extra})


def corruption_breakdown(headers: DataFrame) -> DataFrame:
    return headers.where("status <> 'Valid'").groupBy("status").agg(F.count("*").alias("n"))


def inventory_by_split(headers: DataFrame) -> DataFrame:
    return headers.groupBy("split").agg(F.count("*").alias("n"))


def inventory_by_rate(headers: DataFrame) -> DataFrame:
    return headers.groupBy("sfreq").agg(F.count("*").alias("n"))


def worst_channels(inventory: DataFrame, k: int = 10) -> DataFrame:
    return inventory.orderBy(F.col("missing_expected").desc(), "file_id").limit(k)
