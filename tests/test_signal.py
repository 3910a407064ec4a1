"""Signal operators against plain NumPy and known waves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import signal as sg

SCHEMA = ("file_id string, chunk bigint, channel string, sfreq double, n_samples bigint, "
          "start bigint, samples array<float>")


def table(spark, waves, sfreq, chunk):
    """``waves``: {(file, channel): array}; chunks of ``chunk`` samples."""
    rows = []
    for (file, channel), x in waves.items():
        for k, at in enumerate(range(0, len(x), chunk)):
            rows.append((file, k, channel, float(sfreq), len(x), at,
                         [float(v) for v in x[at:at + chunk]]))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def welch(x, fs, n, overlap=0.5):
    n = min(n, len(x))
    hop = n - int(n * overlap)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spectra = []
    for at in range(0, len(x) - n + 1, hop):
        s = x[at:at + n] - x[at:at + n].mean()
        p = np.abs(np.fft.rfft(s * w)) ** 2 / (fs * (w ** 2).sum())
        p[1:-1 if n % 2 == 0 else None] *= 2
        spectra.append(p)
    return np.mean(spectra, axis=0)


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(0)
    t = np.arange(1000) / 100.0
    out = {}
    for c, f in (("O1", 10.0), ("O2", 10.0), ("Fz", 3.0), ("XX", 22.0)):
        x = 20 * np.sin(2 * np.pi * f * t) + rng.normal(0, 2, len(t)) + 5
        out[("a", c)] = x.astype(np.float32).astype(float)
    out[("b", "O1")] = rng.normal(0, 1, 70).astype(np.float32).astype(float)
    return out


@pytest.mark.parametrize("chunk", [1000, 64, 7])
def test_welch(spark, waves, chunk):
    signals = table(spark, waves, 100, chunk)
    got = sg.welch_psd(signals, F.lit(200), chunked=chunk != 1000).collect()
    assert len(got) == len(waves)
    for r in got:
        want = welch(waves[(r.file_id, r.channel)], 100.0, 200)
        np.testing.assert_allclose(r.power, want, rtol=1e-9)


def test_peaks_and_parseval(spark, waves):
    signals = table(spark, waves, 100, 1000)
    psd = sg.welch_psd(signals, F.col("sfreq") * 2)
    peaks = {r.channel: r.f for r in psd.where("file_id = 'a'").select(
        "channel", sg.peak_frequency(0.5, 50).alias("f")).collect()}
    assert peaks == {"O1": 10.0, "O2": 10.0, "Fz": 3.0, "XX": 22.0}
    assert sg.alpha_peak(psd, ["O1", "O2"]).where("file_id = 'a'").first().alpha_peak == 10.0
    power = psd.where("channel = 'O1' AND file_id = 'a'").select(
        (sg.band_sum(0, 50) * F.col("sfreq") / F.col("nperseg")).alias("p")).first().p
    assert power == pytest.approx(np.var(waves[("a", "O1")]), rel=0.02)


def test_bands(spark, waves):
    psd = sg.welch_psd(table(spark, waves, 100, 1000), F.lit(200))
    got = {(r.file_id, r.channel): r for r in sg.band_power_trapz(psd).collect()}
    sums = {(r.file_id, r.channel): r for r in sg.band_power_sum(psd).collect()}
    for key, x in waves.items():
        p = welch(x, 100.0, 200)
        f = np.arange(len(p)) * 100.0 / min(200, len(x))
        for band, (lo, hi) in sg.BANDS.items():
            m = (f >= lo) & (f <= hi)
            area = (p[m][1:] + p[m][:-1]).sum() / 2 * (f[1] - f[0])
            assert got[key][band] == pytest.approx(area, abs=1e-9)
            assert sums[key][band] == pytest.approx(p[m].sum(), abs=1e-9)


@pytest.mark.parametrize("chunk", [1000, 130])
def test_correlation(spark, waves, chunk):
    a = {k: v for k, v in waves.items() if k[0] == "a"}
    frames = sg.signals_to_frames(table(spark, a, 100, chunk))
    got = sg.interchannel_corr(frames).first().mean_corr
    r = np.corrcoef(np.stack(list(a.values())))
    assert got == pytest.approx(np.abs(r[np.triu_indices(4, 1)]).mean())


def test_constant_channel(spark, waves):
    a = {k: v for k, v in waves.items() if k[0] == "a"}
    a[("a", "flat")] = np.full(1000, 3.0)
    signals = table(spark, a, 100, 250)
    frames = sg.signals_to_frames(signals)
    assert sg.interchannel_corr(frames).first().mean_corr is not None
    assert sg.interchannel_corr(frames, skip_undefined=False).first().mean_corr is None
    flat = sg.flat_channels(signals, 1.0).first()
    assert (flat.n_flat_channels, flat.n_channels) == (1, 5)


def test_crop_keeps_the_end_sample(spark, waves):
    cropped = sg.crop_signal(table(spark, waves, 100, 64), 2.0).where("file_id = 'a'")
    n = cropped.where("channel = 'O1'").select(F.sum(F.size("samples"))).first()[0]
    assert n == 201
    assert sg.pick_channels(cropped, ("O1", "FZ")).select("channel").distinct().count() == 2


# ---- halo and one pass ---------------------------------------------------

HALO = SCHEMA.replace("samples array", "own bigint, samples array")


def halo_table(spark, waves, sfreq, chunk, halo):
    rows = []
    for (file, channel), x in waves.items():
        for k, at in enumerate(range(0, len(x), chunk)):
            rows.append((file, k, channel, float(sfreq), len(x), at, min(chunk, len(x) - at),
                         [float(v) for v in x[at:at + chunk + halo]]))
    return spark.createDataFrame(rows, HALO)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    """Output columns of every exchange of the plan that is run."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [part.split("\n")[1] for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "Input" in part]


@pytest.mark.parametrize("chunk,halo,length", [(1000, 0, 200), (64, 200, 200), (7, 199, 200), (250, 100, 100), (33, 1000, 5000)])
def test_windows_with_halo(spark, waves, chunk, halo, length):
    """Windows and spectra of the whole signal, without an exchange of samples."""
    signals = halo_table(spark, waves, 100, chunk, halo)
    segments = sg.segment_signal(signals, F.lit(length))
    plain = sg.segment_signal(table(spark, waves, 100, chunk), F.lit(length))
    assert "Exchange" not in plan_of(segments)
    key = lambda r: (r.file_id, r.channel, r.segment, tuple(r.samples))
    assert sorted(map(key, segments.collect())) == sorted(map(key, plain.collect()))
    psd = sg.welch_psd(signals, F.lit(length), chunked=True)
    assert exchanged(psd) and not any("samples" in line for line in exchanged(psd))
    got = {(r.file_id, r.channel): r for r in psd.collect()}
    assert set(got) == set(waves)
    for key, r in got.items():
        np.testing.assert_allclose(r.power, welch(waves[key], 100.0, length), rtol=1e-9)


def test_short_halo_is_an_error(spark, waves):
    signals = halo_table(spark, waves, 100, 64, 50)
    for df in (sg.segment_signal(signals, F.lit(200)), sg.welch_psd(signals, F.lit(200), chunked=True)):
        with pytest.raises(Exception, match="halo"):
            df.collect()


def halo_frames(signals):
    entry = F.struct("channel", "sfreq", "n_samples", "start", "own", "samples")
    return signals.groupBy("file_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("signals"))


@pytest.mark.parametrize("chunk", [1000, 130, 64])
def test_one_pass_measures(spark, waves, chunk):
    """Measures of one pass equal those of the operators one by one."""
    a = {k: v for k, v in waves.items() if k[0] == "a"}
    a |= {("c", c): v[:70] for (_, c), v in a.items()}
    signals = halo_table(spark, a, 100, chunk, 1000)
    plain = table(spark, a, 100, 1000)
    labels = spark.createDataFrame([("a", "Normal", "train"), ("c", "Normal", "eval")], "file_id string, group string, subset string")
    whole = sg.recording_signal_stats(halo_frames(signals), labels)
    assert plan_of(whole).count("MapInArrow") == 1
    got = {r.file_id: r for r in whole.collect()}
    assert set(got) == {"a", "c"} and got["c"].subset == "eval"
    slow, fast = (sg.welch_psd(plain, F.col("sfreq") * s) for s in (10, 2))
    snr = {r.file_id: r.snr for r in sg.snr_proxy_db(slow).collect()}
    peak = {r.file_id: r.alpha_peak for r in sg.posterior_alpha_peak(plain).collect()}
    corr = {r.file_id: r.mean_corr for r in sg.interchannel_corr(sg.signals_to_frames(plain), False).collect()}
    rel = sg.relative_band_power(sg.band_power_sum(fast, sg.FOUR_BANDS, (0.5, 30.0)), sg.FOUR_BANDS, 1e-9)
    rel = {r.file_id: r for r in rel.groupBy("file_id").agg(*[F.avg(b).alias(b) for b in sg.FOUR_BANDS]).collect()}
    for file, r in got.items():
        assert r.snr == pytest.approx(snr[file]) and r.correlation == pytest.approx(corr[file])
        assert r.alpha_peak == pytest.approx(peak[file])
        assert all(r[b] == pytest.approx(rel[file][b]) for b in sg.FOUR_BANDS)
    states = sg.signal_states(halo_frames(signals), [sg.quality_spectrum(seconds=2)])
    want = {(r.file_id, r.channel): r for r in sg.channel_quality(fast).collect()}
    for r in sg.channel_measures(states).collect():
        for c in ("delta_rel", "gamma_rel", "snr_db", "alpha_peak_hz"):
            assert r[c] == pytest.approx(want[r.file_id, r.channel][c]), c


def test_unlike_rates(spark, waves):
    """A pair of channels of unlike rates has no r: it is skipped, or makes the recording null."""
    x = waves[("a", "O1")]
    rows = [("a", 0, c, fs, len(v), 0, len(v), [float(i) for i in v]) for c, fs, v in (
        ("O1", 100.0, x), ("O2", 100.0, waves[("a", "O2")]), ("Fz", 50.0, x[::2]))]
    frames = halo_frames(spark.createDataFrame(rows, HALO))
    r = abs(np.corrcoef(x, waves[("a", "O2")])[0, 1])
    pairs = {(p.a, p.b): p.r for p in sg.pair_correlation(frames).collect()}
    assert len(pairs) == 3 and sum(v is None for v in pairs.values()) == 2
    assert sg.interchannel_corr(frames).first().mean_corr == pytest.approx(r)
    assert sg.interchannel_corr(frames, skip_undefined=False).first().mean_corr is None
    labels = spark.createDataFrame([("a", "x")], "file_id string, group string")
    assert sg.recording_signal_stats(frames, labels).first().correlation is None
    heads = spark.createDataFrame([("a", "train", "n", 100.0, 60000)], "file_id string, split string, label string, sfreq double, dur_ms long")
    states = sg.signal_states(frames, [sg.quality_spectrum(seconds=2)])
    assert sg.file_measures(states, heads).first().mean_inter_channel_corr == pytest.approx(r)
    assert sg.without_halo(sg.frames_to_signals(frames)).where("channel = 'Fz'").first().n_samples == len(x[::2])
