"""Spectra and quality measures over distributed samples.

Two shapes of the sample table:

``signals``  one row per channel and chunk:
             ``file_id, chunk, channel, sfreq, n_samples, start, samples``
             (``n_samples`` is the length of the whole channel, ``start`` the
             index of the first sample of the chunk)
``frames``   one row per chunk with all channels:
             ``file_id, chunk, signals array<struct<channel, sfreq, n_samples,
             start, samples>>``, which is how the EDF reader emits them

Both are exchanged by ``frames_to_signals`` (no shuffle) and
``signals_to_frames``. Spectra stay arrays of one row per channel, so bands are
array slices and need no shuffle either.

Either shape may have a halo: ``samples`` run on past the chunk, of which ``own``
samples are its own. A window belongs to the chunk that owns its first sample, so
with a halo of a window's length every window is whole in one row and samples are
never shuffled. ``without_halo`` gives the plain chunks back.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.channels import POSTERIOR
from .events import count_if

# Frequency bands in Hz, both edges included.
BANDS = {"Delta": (0.5, 4.0), "Theta": (4.0, 8.0), "Alpha": (8.0, 13.0),
         "Beta": (13.0, 30.0), "Gamma": (30.0, 45.0)}


def frames_to_signals(frames: DataFrame) -> DataFrame:
    halo = ["s.own"] if "own" in frames.schema["signals"].dataType.elementType.names else []
    return frames.select("file_id", "chunk", F.explode("signals").alias("s")).select(
        "file_id", "chunk", "s.channel", "s.sfreq", "s.n_samples", "s.start", "s.samples", *halo)


def without_halo(signals: DataFrame) -> DataFrame:
    """Only the samples that a chunk owns."""
    return signals.withColumn("samples", F.slice("samples", F.lit(1), F.col("own").cast("int"))).drop("own")


def signals_to_frames(signals: DataFrame) -> DataFrame:
    """Bring the channels of a chunk together; a header bounds their number."""
    entry = F.struct("channel", "sfreq", "n_samples", "start", "samples")
    return signals.groupBy("file_id", "chunk").agg(
        F.array_sort(F.collect_list(entry)).alias("signals"))


def pick_channels(signals: DataFrame, vocab, exact: bool = False) -> DataFrame:
    """Channels of a vocabulary, matched in upper case or exactly as written."""
    name = F.col("channel") if exact else F.upper("channel")
    return signals.where(name.isin(*vocab))


def crop_signal(signals: DataFrame, tmax: float) -> DataFrame:
    """First ``tmax`` seconds, the sample at ``tmax`` included."""
    keep = F.least(F.col("n_samples"), F.floor(F.col("sfreq") * tmax) + 1)
    return (
        signals.withColumn("n_samples", keep.cast("bigint"))
        .where(F.col("start") < F.col("n_samples"))
        .withColumn("samples", F.slice("samples", F.lit(1), F.least(
            F.size("samples"), F.col("n_samples") - F.col("start")).cast("int")))
    )


def _window_columns(signals: DataFrame, length: Column, overlap: float) -> DataFrame:
    """Window length, shortened for short recordings, and hop in samples."""
    n = F.least(length.cast("bigint"), F.col("n_samples"))
    return signals.withColumn("nperseg", n).withColumn(
        "hop", F.col("nperseg") - F.floor(F.col("nperseg") * overlap))


def segment_signal(signals: DataFrame, length: Column, overlap: float = 0.5) -> DataFrame:
    """Complete overlapping windows, also where they cross chunk borders.

    With a halo every window is cut from the chunk that owns its first sample, without a
    shuffle; a halo shorter than a window is an error. Else every chunk is cut into the pieces it gives to the windows it touches, and
    the pieces of a window meet by ``(file, channel, window)``: small groups,
    however long a recording is. Rows: ``segment`` and its ``samples``.
    """
    w = _window_columns(signals, length, overlap)
    begin, end = F.col("start"), F.col("start") + F.size("samples")
    last = F.floor((F.col("n_samples") - F.col("nperseg")) / F.col("hop"))
    if "own" in signals.columns:
        first = F.ceil(begin / F.col("hop"))
        upto = F.least(last, F.floor((begin + F.col("own") - 1) / F.col("hop")))
        cut = F.slice("samples", (F.col("segment") * F.col("hop") - begin + 1).cast("int"), F.col("nperseg").cast("int"))
        return w.withColumn("segment", F.explode(F.when(upto >= first, F.sequence(first, upto)))).select(
            "file_id", "channel", "sfreq", "nperseg", "hop", "segment",
            F.when(F.size(cut) == F.col("nperseg"), cut).otherwise(F.raise_error(F.lit(SHORT_HALO))).alias("samples"))
    first = F.greatest(F.floor((begin - F.col("nperseg")) / F.col("hop")) + 1, F.lit(0))
    upto = F.least(last, F.floor((end - 1) / F.col("hop")))
    touched = F.when(upto >= first, F.sequence(first, upto))
    pieces = w.withColumn("segment", F.explode(touched)).withColumn(
        "_at", F.col("segment") * F.col("hop"))
    lo, hi = F.greatest("_at", begin), F.least(F.col("_at") + F.col("nperseg"), end)
    piece = F.slice("samples", (lo - begin + 1).cast("int"), (hi - lo).cast("int"))
    whole = pieces.groupBy("file_id", "channel", "sfreq", "nperseg", "hop", "segment").agg(
        F.array_sort(F.collect_list(F.struct((lo - F.col("_at")).alias("at"),
                                             piece.alias("x")))).alias("_p"))
    return (
        whole.withColumn("samples", F.flatten(F.transform("_p", lambda p: p["x"])))
        .where(F.size("samples") == F.col("nperseg")).drop("_p")
    )


SHORT_HALO = "the halo is shorter than a window"

_PSD = ("file_id string, channel string, sfreq double, nperseg bigint, "
        "n_segments bigint, power array<double>")


def _window(name: str, n: int) -> np.ndarray:
    if name == "hann":  # periodic
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    if name == "hamming":  # periodic
        return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    raise ValueError(f"unknown window: {name}")


def owned_windows(x: np.ndarray, start: int, own: int, total: int, n: int, hop: int) -> np.ndarray:
    """(k, n): the windows of a channel of ``total`` samples whose first sample is among the ``own`` from ``start`` on."""
    begin = -start % hop
    count = max(0, min(own - 1 - begin, total - n - start - begin) // hop + 1)
    if n < 1 or not count:
        return np.zeros((0, max(n, 1)))
    if begin + (count - 1) * hop + n > len(x):
        raise ValueError(SHORT_HALO)
    return np.lib.stride_tricks.sliding_window_view(x, n)[begin::hop][:count]


def densities(seg: np.ndarray, fs: float, window: str) -> np.ndarray:
    """(k, n // 2 + 1): one-sided density of every window, its mean taken off."""
    n = seg.shape[1]
    taper = _window(window, n)
    spec = np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * taper, axis=1)
    power = (spec.real ** 2 + spec.imag ** 2) / (fs * (taper ** 2).sum())
    power[:, 1:(-1 if n % 2 == 0 else None)] *= 2
    return power


def _periodograms(window: str):
    """Arrow kernel: mean one-sided density of the windows that each row owns."""
    def run(batches):
        for batch in batches:
            column = batch.column("samples")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            rates = batch.column("sfreq").to_numpy(zero_copy_only=False)
            names = ("start", "own", "n_samples", "nperseg", "hop")
            places = zip(*(batch.column(c).to_pylist() for c in names))
            powers, counts, begin = [], [], 0
            for end, fs, place in zip(ends, rates, places):
                x, begin = flat[begin:end].astype(np.float64), end
                seg = owned_windows(x, *place)
                powers.append(densities(seg, fs, window).mean(axis=0) if len(seg) else None)
                counts.append(len(seg))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("channel"), batch.column("sfreq"),
                 batch.column("nperseg"), pa.array(counts, pa.int64()),
                 pa.array(powers, pa.list_(pa.float64()))],
                names=["file_id", "channel", "sfreq", "nperseg", "n_segments", "power"])
    return run


def welch_psd(signals: DataFrame, length: Column, overlap: float = 0.5,
              window: str = "hann", chunked: bool = False) -> DataFrame:
    """Averaged periodograms: ``power`` holds the density of bins 0..nperseg/2.

    Rows that hold a whole channel are transformed where they are. With ``chunked`` the
    spectra of a channel's rows are averaged by a combined aggregation: with a halo each
    row gives the windows it owns, so only spectra are shuffled; without one the windows
    are put together first.
    """
    halo = "own" in signals.columns
    if chunked and not halo:
        rows = segment_signal(signals, length, overlap).withColumn("n_samples", F.col("nperseg"))
    else:
        rows = _window_columns(signals, length, overlap)
    whole = F.size("samples").cast("bigint")
    one = rows.select(
        F.col("file_id").cast("string"), "channel", "sfreq", "nperseg", "hop", "samples", "n_samples" if halo else whole.alias("n_samples"),
        "start" if halo else F.lit(0).cast("bigint").alias("start"), "own" if halo else whole.alias("own"),
    ).mapInArrow(_periodograms(window), _PSD)
    one = one.where("n_segments > 0")
    if not chunked:
        return one
    keys = ["file_id", "channel", "sfreq", "nperseg"]
    bins = one.select(*keys, "n_segments", F.posexplode("power").alias("bin", "p"))
    mean = bins.groupBy(*keys, "bin").agg(
        (F.sum(F.col("p") * F.col("n_segments")) / F.sum("n_segments")).alias("p"),
        F.sum("n_segments").alias("n_segments"))
    # at most nperseg / 2 + 1 bins per channel
    return mean.groupBy(*keys).agg(
        F.max("n_segments").alias("n_segments"),
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))),
                    lambda s: s["p"]).alias("power"))


def psd_long(psd: DataFrame) -> DataFrame:
    """``(file_id, channel, bin, freq, power)`` rows of the spectra."""
    return psd.select("file_id", "channel", "sfreq", "nperseg",
                      F.posexplode("power").alias("bin", "power")).select(
        "file_id", "channel", "bin",
        (F.col("bin") * F.col("sfreq") / F.col("nperseg")).alias("freq"), "power")


# ---- bands --------------------------------------------------------------

def _edges(lo: float, hi: float) -> tuple[Column, Column]:
    """First and last bin inside ``[lo, hi]`` Hz."""
    scale = F.col("nperseg") / F.col("sfreq")
    return (F.ceil(F.lit(lo) * scale).cast("int"),
            F.least(F.floor(F.lit(hi) * scale), F.size("power") - 1).cast("int"))


def _bins(lo: float, hi: float) -> Column:
    first, last = _edges(lo, hi)
    return F.slice("power", first + 1, F.greatest(last - first + 1, F.lit(0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def band_sum(lo: float, hi: float) -> Column:
    """Sum of the density over the bins of a band."""
    return _sum(_bins(lo, hi))


def band_trapz(lo: float, hi: float) -> Column:
    """Trapezoid integral of the density over the bins of a band."""
    p = _bins(lo, hi)
    ends = (F.get(p, F.lit(0)) + F.get(p, F.size(p) - 1)) / 2
    area = (_sum(p) - ends) * F.col("sfreq") / F.col("nperseg")
    return F.when(F.size(p) > 1, area).otherwise(0.0)


def peak_frequency(lo: float = 8.0, hi: float = 13.0) -> Column:
    """Frequency of the largest bin of a band; the first of equal ones."""
    p = _bins(lo, hi)
    first, _ = _edges(lo, hi)
    at = first + F.array_position(p, F.array_max(p)) - 1
    return F.when(F.size(p) > 0, at * F.col("sfreq") / F.col("nperseg"))


def band_power_sum(psd: DataFrame, bands=BANDS, total=(0.5, 50.0)) -> DataFrame:
    return psd.select("file_id", "channel", band_sum(*total).alias("total"),
                      *[band_sum(*edge).alias(b) for b, edge in bands.items()])


def band_power_trapz(psd: DataFrame, bands=BANDS, total=(0.5, 45.0)) -> DataFrame:
    return psd.select("file_id", "channel", band_trapz(*total).alias("total"),
                      *[band_trapz(*edge).alias(b) for b, edge in bands.items()])


def relative_band_power(powers: DataFrame, bands, eps: float = 0.0) -> DataFrame:
    return powers.select("file_id", "channel", *[
        F.try_divide(F.col(b), F.col("total") + eps).alias(b) for b in bands])


def snr_bands_db(eps: float = 1e-12) -> Column:
    """Total over gamma band in dB, from trapezoid integrals."""
    total, noise = band_trapz(0.5, 45.0), band_trapz(30.0, 45.0)
    return 10 * F.log10((total + eps) / (noise + eps))


def snr_proxy_db(psd: DataFrame, eps: float = 1e-9, signal=(1.0, 40.0),
                 noise=(40.0, 80.0)) -> DataFrame:
    """Median over the channels of the 1-40 to 40-80 Hz ratio in dB."""
    ratio = 10 * F.log10(band_sum(*signal) / (band_sum(*noise) + eps))
    # a header bounds the number of channels in a recording
    return psd.select("file_id", ratio.alias("_db")).groupBy("file_id").agg(
        F.median("_db").alias("snr"))


def alpha_peak(psd: DataFrame, channels=None) -> DataFrame:
    """Peak of the channel-mean density in 8-13 Hz, optionally of some channels."""
    rows = pick_channels(psd, channels, exact=True) if channels else psd
    first, _ = _edges(8.0, 13.0)
    bins = rows.select(
        "file_id", "sfreq", "nperseg", first.alias("_first"),
        F.posexplode(_bins(8.0, 13.0)).alias("_i", "_p"))
    freq = (F.col("_first") + F.col("_i")) * F.col("sfreq") / F.col("nperseg")
    mean = bins.groupBy("file_id", freq.alias("freq")).agg(F.avg("_p").alias("_m"))
    return mean.groupBy("file_id").agg(
        F.max_by("freq", F.struct("_m", -F.col("freq"))).alias("alpha_peak"))


def posterior_alpha_peak(signals: DataFrame, chunked: bool = False) -> DataFrame:
    """Alpha peak over posterior channels: 256-point windows, no overlap."""
    psd = welch_psd(pick_channels(signals, POSTERIOR, exact=True), F.lit(256),
                    overlap=0.0, window="hamming", chunked=chunked)
    return alpha_peak(psd)


def signal_features(psd: DataFrame, bands=BANDS, eps: float = 1e-9) -> DataFrame:
    """Mean and maximum relative band power over channels and the alpha peak."""
    rel = relative_band_power(band_power_sum(psd, bands), bands, eps)
    stats = rel.groupBy("file_id").agg(*[
        f(b).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("max", F.max))])
    peak = alpha_peak(psd).withColumnRenamed("alpha_peak", "Alpha_Peak_Hz")
    return stats.join(peak, "file_id", "left")


def channel_quality(psd: DataFrame) -> DataFrame:
    """Relative bands by integral, SNR and alpha peak of each channel."""
    total = band_trapz(0.5, 45.0)
    rel = [F.try_divide(band_trapz(*edge), total).alias(f"{b.lower()}_rel")
           for b, edge in BANDS.items()]
    peak = F.when(band_trapz(*BANDS["Alpha"]) > 0, peak_frequency())
    return psd.select("file_id", "channel", *rel, snr_bands_db().alias("snr_db"),
                      peak.alias("alpha_peak_hz"))


# ---- amplitudes and correlation ----------------------------------------

def channel_deviation(signals: DataFrame) -> DataFrame:
    """Population deviation of every channel; merged over chunks and tasks."""
    total = lambda f: F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))
    n = F.size("samples").cast("double")
    chunk = signals.where(F.size("samples") > 0).select("file_id", "channel", "samples", (total(lambda x: x) / n).alias("_mean"))
    chunk = chunk.select("file_id", "channel", n.alias("_n"), "_mean", total(
        lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_dev"))
    weight = lambda c: F.sum(F.col("_n") * c)
    return chunk.groupBy("file_id", "channel").agg(F.sqrt(F.greatest(F.lit(0.0), (
        F.sum("_dev") + weight(F.col("_mean") * F.col("_mean")) - weight(F.col("_mean")) * weight(F.col("_mean")) / F.sum("_n"))
        / F.sum("_n"))).alias("std"))


def flat_channels(signals: DataFrame, limit: float = 1.0) -> DataFrame:
    """Channels per recording whose deviation is below ``limit`` (in sample units)."""
    return channel_deviation(signals).groupBy("file_id").agg(
        count_if(F.col("std") < limit).alias("n_flat_channels"),
        F.count("*").alias("n_channels"))


_PAIRS = ("file_id string, a string, b string, n bigint, ma double, mb double, "
          "caa double, cbb double, cab double")


def unlike_pairs(rows: list[np.ndarray]):
    """Pairs of channels with unlike numbers of samples in a frame: rates differ, so they have no common moments."""
    return [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(rows[i]) != len(rows[j])]


def _pair_moments(batches):
    """Arrow kernel: moments of every channel pair of a frame."""
    for batch in batches:
        out = {k: [] for k in ("file_id", "a", "b", "n", "ma", "mb", "caa", "cbb", "cab")}
        ids = batch.column("file_id").to_pylist()
        frames = batch.column("signals")
        entries = frames.flatten()
        names = entries.field("channel").to_pylist()
        arrays = entries.field("samples")
        begin = 0
        for file_id, size in zip(ids, frames.value_lengths().to_pylist()):
            label = names[begin:begin + size]
            rows = [np.asarray(arrays[i].values, dtype=np.float64)
                    for i in range(begin, begin + size)]
            begin += size
            for a, b in unlike_pairs(rows):
                out["file_id"].append(file_id)
                out["a"].append(label[a])
                out["b"].append(label[b])
                for name in ("n", "ma", "mb", "caa", "cbb", "cab"):
                    out[name].append(0)
            for length in sorted({len(r) for r in rows}):
                pick = [i for i, r in enumerate(rows) if len(r) == length]
                if length == 0 or len(pick) < 2:
                    continue
                x = np.stack([rows[i] for i in pick])
                mean = x.mean(axis=1)
                x = x - mean[:, None]
                gram = x @ x.T
                i, j = np.triu_indices(len(pick), 1)
                out["file_id"] += [file_id] * len(i)
                out["a"] += [label[pick[k]] for k in i]
                out["b"] += [label[pick[k]] for k in j]
                out["n"] += [length] * len(i)
                for name, values in (("ma", mean[i]), ("mb", mean[j]), ("caa", gram[i, i]),
                                     ("cbb", gram[j, j]), ("cab", gram[i, j])):
                    out[name] += values.tolist()
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("file_id", pa.string()), ("a", pa.string()), ("b", pa.string()),
             ("n", pa.int64())]
            + [(k, pa.float64()) for k in ("ma", "mb", "caa", "cbb", "cab")]))


def pair_correlation(frames: DataFrame) -> DataFrame:
    """Pearson r of every channel pair of a recording; null where the rates of the two differ.

    Frames hold all channels of a chunk, so moments are taken where the samples
    are and only a few numbers per pair are shuffled and merged.
    """
    moments = frames.select(
        F.col("file_id").cast("string"),
        F.transform("signals", lambda s: F.struct(s["channel"].alias("channel"),
                                                  s["samples"].alias("samples"))).alias("signals"),
    ).mapInArrow(_pair_moments, _PAIRS)
    n = F.sum("n")

    def comoment(c, x, y):
        cross = F.sum(F.col("n") * F.col(x) * F.col(y))
        return (F.sum(c) + cross
                - F.try_divide(F.sum(F.col("n") * F.col(x)) * F.sum(F.col("n") * F.col(y)), n))

    sums = moments.groupBy("file_id", "a", "b").agg(
        comoment("caa", "ma", "ma").alias("caa"), comoment("cbb", "mb", "mb").alias("cbb"),
        comoment("cab", "ma", "mb").alias("cab"))
    return sums.withColumn("r", F.try_divide(F.col("cab"), F.sqrt(F.col("caa") * F.col("cbb"))))


def interchannel_corr(frames: DataFrame, skip_undefined: bool = True) -> DataFrame:
    """Mean absolute r over channel pairs.

    A constant channel has no r, nor have channels of unlike rates: such pairs are
    skipped, or make the whole recording null.
    """
    pairs = pair_correlation(frames)
    mean = F.avg(F.abs("r"))
    if not skip_undefined:
        mean = F.when(count_if(F.col("r").isNull()) == 0, mean)
    return pairs.groupBy("file_id").agg(mean.alias("mean_corr"))


def file_quality(channels: DataFrame, corr: DataFrame, headers: DataFrame) -> DataFrame:
    """Per recording: rate, minutes, mean and minimum SNR, mean correlation."""
    snr = channels.groupBy("file_id").agg(F.avg("snr_db").alias("mean_snr_db"),
                                          F.min("snr_db").alias("min_snr_db"))
    return (_recording_head(headers).join(snr, "file_id")
            .join(corr.withColumnRenamed("mean_corr", "mean_inter_channel_corr"),
                  "file_id", "left"))


def _recording_head(headers: DataFrame) -> DataFrame:
    return headers.select("file_id", "split", "label", "sfreq",
                          (F.col("dur_ms") / 60000).alias("duration_min"))


# ---- one pass over the samples -------------------------------------------

class Spectrum(NamedTuple):
    """What one pass keeps of a channel's spectrum: sums and integrals over bands and the bins of one band.

    All of it is linear in the periodograms, so it adds up over windows and chunks.
    """
    name: str
    seconds: float | None = None
    points: int | None = None
    overlap: float = 0.5
    window: str = "hann"
    sums: tuple = ()
    areas: tuple = ()
    bins: tuple | None = None
    channels: tuple | None = None

    def length(self, fs: float, total: int) -> int:
        return min(int(self.points or self.seconds * fs), total)


def _kept(power: np.ndarray, spec: Spectrum, fs: float, n: int) -> tuple[np.ndarray, int]:
    """(sums, areas and bins of a spectrum, number of the first bin)."""
    def inside(lo, hi):
        first, last = int(np.ceil(lo * n / fs)), min(int(np.floor(hi * n / fs)), len(power) - 1)
        return first, power[first:max(last + 1, first)]

    bands = [inside(*edge)[1] for edge in spec.areas]
    areas = [(p.sum() - (p[0] + p[-1]) / 2) * fs / n if len(p) > 1 else 0.0 for p in bands]
    first, bins = inside(*spec.bins) if spec.bins else (0, power[:0])
    return np.r_[[inside(*edge)[1].sum() for edge in spec.sums], areas, bins], first


_STATES = ("file_id string, kind string, a string, b string, step double, first int, n bigint, v array<double>")
#: Kind of the rows with the moments of a channel pair.
PAIR = "pair"


def _states(spectra: list[Spectrum]):
    """Arrow kernel: everything that is kept of a frame, channel by channel and pair by pair."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            entries = batch.column("signals").flatten()
            fields = [entries.field(c).to_pylist() for c in ("channel", "sfreq", "n_samples", "start", "own")]
            arrays, begin = entries.field("samples"), 0
            for file_id, size in zip(batch.column("file_id").to_pylist(), batch.column("signals").value_lengths().to_pylist()):
                whole = [np.asarray(arrays[i].values, dtype=np.float64) for i in range(begin, begin + size)]
                names, rates, totals, starts, owns = ([f[i] for i in range(begin, begin + size)] for f in fields)
                begin += size
                for name, fs, total, start, own, x in zip(names, rates, totals, starts, owns, whole):
                    for spec in spectra:
                        if spec.channels is not None and name not in spec.channels:
                            continue
                        n = spec.length(fs, total)
                        seg = owned_windows(x, start, own, total, n, n - int(n * spec.overlap))
                        if len(seg):
                            v, first = _kept(densities(seg, fs, spec.window).sum(axis=0), spec, fs, n)
                            out.append((file_id, spec.name, name, None, fs / n, first, len(seg), v.tolist()))
                rows = [x[:own] for x, own in zip(whole, owns)]
                for i, j in unlike_pairs(rows):
                    out.append((file_id, PAIR, names[i], names[j], 0.0, 0, 0, [0.0] * 8))
                for length in sorted({len(r) for r in rows} - {0}):
                    pick = [i for i, r in enumerate(rows) if len(r) == length]
                    x = np.stack([rows[i] for i in pick])
                    mean = x.mean(axis=1)
                    x = x - mean[:, None]
                    gram = x @ x.T
                    for i in range(len(pick)):
                        for j in range(i + 1, len(pick)):
                            p, q = mean[i], mean[j]
                            out.append((file_id, PAIR, names[pick[i]], names[pick[j]], 0.0, 0, length, [
                                length * p, length * q, length * p * p, length * q * q, length * p * q,
                                gram[i, i], gram[j, j], gram[i, j]]))
            kinds = (pa.string(),) * 4 + (pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=["file_id", "kind", "a", "b", "step", "first", "n", "v"])
    return run


def signal_states(frames: DataFrame, spectra: list[Spectrum]) -> DataFrame:
    """Merged states of each channel and channel pair: ``file_id, kind, a, b, step, first, n, v``.

    One pass over frames with a halo of the longest window; what is shuffled are some twenty
    numbers per channel, pair and frame, added up before the shuffle. ``v`` of a spectrum are
    its means over ``n`` windows, in the order sums, areas, bins (``first`` is the number of
    the first bin, ``step`` their distance in Hz); ``v`` of a pair are sums over ``n`` samples.
    """
    keys = ["file_id", "kind", "a", "b", "step", "first"]
    one = frames.select(F.col("file_id").cast("string"), "signals").mapInArrow(_states(spectra), _STATES)
    added = one.select(*keys, "n", F.posexplode("v").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("n").alias("n"), F.sum("_v").alias("_v"))
    value = F.when(F.col("kind") == PAIR, F.col("_v")).otherwise(F.col("_v") / F.col("n"))
    # a state has a bounded number of values
    return added.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("_k", value.alias("x")))), lambda s: s["x"]).alias("v"))


def _v(i: int) -> Column:
    return F.get("v", F.lit(i))


def _state_r() -> Column:
    """Pearson r of a pair's moments; null where one channel is constant or the rates differ."""
    ca, cb, cab = _v(5) + _v(2) - _v(0) * _v(0) / F.col("n"), _v(6) + _v(3) - _v(1) * _v(1) / F.col("n"), _v(7) + _v(4) - _v(0) * _v(1) / F.col("n")
    return F.when(F.col("n") > 0, F.try_divide(cab, F.sqrt(ca * cb)))


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def _mean_r(skip_undefined: bool) -> Column:
    """Mean absolute r over the pairs of a recording, in an aggregation of its states with a column ``r``."""
    mean = F.avg(F.abs("r"))
    return mean if skip_undefined else F.when(F.count_if((F.col("kind") == PAIR) & F.col("r").isNull()) == 0, mean)


#: The spectra behind the measures of a recording.
FOUR_BANDS = {b: e for b, e in BANDS.items() if b != "Gamma"}
RECORDING = [
    Spectrum("slow", seconds=10, sums=((1.0, 40.0), (40.0, 80.0))),
    Spectrum("fast", seconds=2, sums=((0.5, 30.0), *FOUR_BANDS.values())),
    Spectrum("posterior", points=256, overlap=0.0, window="hamming", bins=(8.0, 13.0), channels=tuple(POSTERIOR))]


def _common_peak(states: Column) -> Column:
    """Frequency with the largest mean density over ``states`` (step, first, v: bins); the lowest of equal ones."""
    points = F.flatten(F.transform(states, lambda s: F.transform(
        s["v"], lambda p, i: F.struct(((s["first"] + i) * s["step"]).alias("f"), p.alias("p")))))

    def mean(f):
        own = F.filter(points, lambda x: x["f"] == f)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x["p"]) / F.size(own)

    best = F.array_max(F.transform(F.array_distinct(F.transform(points, lambda x: x["f"])), lambda f: F.struct(mean(f).alias("m"), (-f).alias("f"))))
    return -best["f"]


def recording_signal_stats(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Per recording: the columns of ``labels`` (group, subset), SNR proxy, correlation, alpha peak and four bands.

    ``frames`` have a halo of ten seconds or more; their samples are read once (``signal_states``).
    """
    states = signal_states(frames, RECORDING).withColumn("r", _of(PAIR, _state_r()))
    total = _v(0) + F.lit(1e-9)
    shares = [F.avg(_of("fast", _v(1 + i) / total)).alias(b) for i, b in enumerate(FOUR_BANDS)]
    found = states.groupBy("file_id").agg(
        F.median(_of("slow", 10 * F.log10(_v(0) / (_v(1) + 1e-9)))).alias("snr"), _mean_r(False).alias("correlation"),
        # a header bounds the number of channels in a recording
        F.collect_list(_of("posterior", F.struct("step", "first", "v"))).alias("_bins"), *shares)
    return labels.join(found.withColumn("alpha_peak", _common_peak(F.col("_bins"))), "file_id").select(
        *labels.columns, "snr", "correlation", "alpha_peak", *FOUR_BANDS)


def quality_spectrum(points: int | None = None, seconds: float | None = None) -> Spectrum:
    """The spectrum behind ``channel_measures``: total and bands by integral, and the bins of the alpha band."""
    return Spectrum("channel", seconds=seconds, points=points, areas=((0.5, 45.0), *BANDS.values()), bins=BANDS["Alpha"])


def _channel_columns() -> dict[str, Column]:
    names = list(BANDS)
    bins = F.slice("v", 2 + len(names), F.greatest(F.size("v") - 1 - len(names), F.lit(0)))
    at = F.col("first") + F.array_position(bins, F.array_max(bins)) - 1
    shares = {f"{b.lower()}_rel": F.try_divide(_v(1 + i), _v(0)) for i, b in enumerate(names)}
    return shares | {
        "snr_db": 10 * F.log10((_v(0) + 1e-12) / (_v(1 + names.index("Gamma")) + 1e-12)),
        "alpha_peak_hz": F.when((_v(1 + names.index("Alpha")) > 0) & (F.size(bins) > 0), at * F.col("step"))}


def channel_measures(states: DataFrame) -> DataFrame:
    """``channel_quality`` from the states of ``quality_spectrum``."""
    return states.where("kind = 'channel'").select(
        "file_id", F.col("a").alias("channel"), *(c.alias(name) for name, c in _channel_columns().items()))


def file_measures(states: DataFrame, headers: DataFrame) -> DataFrame:
    """``file_quality`` from the states of ``quality_spectrum``: one aggregation of them."""
    rows = states.withColumns({"r": _of(PAIR, _state_r()), "_snr": _of("channel", _channel_columns()["snr_db"])})
    found = rows.groupBy("file_id").agg(F.avg("_snr").alias("mean_snr_db"), F.min("_snr").alias("min_snr_db"),
                                        _mean_r(True).alias("mean_inter_channel_corr"))
    return _recording_head(headers).join(found, "file_id")


def alpha_window(metrics: DataFrame, column: str = "alpha_peak") -> DataFrame:
    return metrics.where(F.col(column).between(7, 14))


def channel_class_join(channels: DataFrame, files: DataFrame) -> DataFrame:
    return channels.join(files.select("file_id", "label"), "file_id")
