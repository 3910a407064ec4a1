"""Queries of the signal operators and the baseline model.

The host recordings have 19 channels in up to four chunks of 64 samples, so
windows of 32 samples with half overlap cross chunk borders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels as ch
from ..operators import model as md, signal as sg, split as sp, statistics as st
from ..sources import edf
from . import oracle_sql as o, pipelines
from .io_queries import edf_folder
from .registry import query, rounded

LENGTH = 32
DIGITS = 8


def spectra(h):
    return sg.welch_psd(h.signals(), F.lit(LENGTH), chunked=True)


def frames(h):
    return sg.signals_to_frames(h.signals())


def read_frames(h, halo_sec, extra=()):
    """Frames of one record each that are read from EDF files, with a halo; only the scalp channels."""
    return pipelines.scalp_frames(h.spark, edf_folder(h, False, extra), chunk_sec=0.1, halo_sec=halo_sec)


def _inside(lo, hi):
    return f"freq >= {lo} AND freq <= {hi}"


_PSD = f"{o.SIGNAL}, {o.psd(LENGTH)}"
_PSD_EDF = f"{o.SIGNAL_EDF}, {o.psd(LENGTH)}"


def _sum(lo, hi):
    return f"coalesce(sum(power) FILTER ({_inside(lo, hi)}), 0)"


def _trapz(lo, hi):
    """Both bins of a trapezoid lie in the band."""
    return (f"coalesce(sum((power + prev) / 2 * (freq - pfreq)) FILTER ({_inside(lo, hi)} "
            f"AND pfreq >= {lo}), 0)")


_LAGGED = f"""{_PSD}, lagged AS (SELECT *, lag(power) OVER w AS prev, lag(freq) OVER w AS pfreq FROM psd
    WINDOW w AS (PARTITION BY file_id, channel ORDER BY bin))"""
_BANDS = list(sg.BANDS.items())
_SUMS = f"""{_PSD}, sums AS (SELECT file_id, channel, {_sum(0.5, 50)} AS total,
    {', '.join(f'{_sum(*e)} AS "{b}"' for b, e in _BANDS)} FROM psd GROUP BY file_id, channel)"""
_AREAS = f"""{_LAGGED}, areas AS (SELECT file_id, channel, {_trapz(0.5, 45)} AS total,
    {', '.join(f'{_trapz(*e)} AS "{b}"' for b, e in _BANDS)},
    arg_max(freq, power) FILTER ({_inside(8, 13)}) AS peak FROM lagged GROUP BY file_id, channel)"""


def _rounded(names, digits=DIGITS):
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


# ---- samples ------------------------------------------------------------


@query("crop_signal", f"""WITH {o.SIGNAL} SELECT file_id, channel, count(*) AS n, min(i)::bigint AS first,
    max(i)::bigint AS last, round(sum(x), 5) AS total FROM pts WHERE i <= floor(sfreq * 0.9)
    GROUP BY file_id, channel""")
def _(h):
    cropped = sg.crop_signal(h.signals(), 0.9)
    size = F.size("samples")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return cropped.select("file_id", "channel", "start", size.alias("k"), total.alias("t")).groupBy(
        "file_id", "channel").agg(
        F.sum("k").alias("n"), F.min("start").alias("first"),
        F.max(F.col("start") + F.col("k") - 1).alias("last"), F.round(F.sum("t"), 5).alias("total"))


@query("pick_channels", f"""WITH {o.SIGNAL} SELECT file_id, chunk, channel, 'upper' AS kind FROM h_signal
    WHERE upper(channel) IN {o.in_list(ch.SCALP_19)} UNION ALL
    SELECT file_id, chunk, channel, 'exact' FROM h_signal WHERE channel IN {o.in_list(ch.SCALP_19)}""")
def _(h):
    s = h.signals()
    parts = [sg.pick_channels(s, ch.SCALP_19, exact).select("file_id", "chunk", "channel",
                                                            F.lit(k).alias("kind"))
             for k, exact in (("upper", False), ("exact", True))]
    return parts[0].unionByName(parts[1])


@query("segment_signal", f"""WITH {_PSD_EDF} SELECT file_id, channel, k AS segment, count(*) AS n,
    round(sum(x), 5) AS total, round(sum(x * j), 4) AS moment FROM seg
    GROUP BY file_id, channel, k""")
def _(h):
    s = sg.segment_signal(sg.frames_to_signals(read_frames(h, 0.32)), F.lit(LENGTH))
    x = F.posexplode("samples").alias("j", "x")
    rows = s.select("file_id", "channel", "segment", x)
    return rows.groupBy("file_id", "channel", "segment").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 5).alias("total"),
        F.round(F.sum(F.col("x").cast("double") * F.col("j")), 4).alias("moment"))


@query("welch_psd", f"""WITH {_PSD_EDF} SELECT file_id, channel, bin, round(freq, 6) AS freq,
    round(power, 6) AS power FROM psd""")
def _(h):
    psd = sg.welch_psd(sg.frames_to_signals(read_frames(h, 0.32)), F.lit(LENGTH), chunked=True)
    long = sg.psd_long(psd).withColumn("bin", F.col("bin").cast("bigint"))
    return rounded(rounded(long, "freq"), "power", digits=6)


@query("welch_psd_shuffled", f"""WITH {_PSD} SELECT file_id, channel, bin, round(freq, 6) AS freq,
    round(power, {DIGITS}) AS power FROM psd""")
def _(h):
    long = sg.psd_long(spectra(h)).withColumn("bin", F.col("bin").cast("bigint"))
    return rounded(rounded(long, "freq"), "power", digits=DIGITS)


@query("welch_psd_whole", f"""WITH {_PSD} SELECT file_id, channel, bin, round(power, {DIGITS}) AS power
    FROM psd""")
def _(h):
    long = sg.psd_long(sg.welch_psd(h.whole_signals(), F.lit(LENGTH)))
    return rounded(long.withColumn("bin", F.col("bin").cast("bigint")), "power",
                   digits=DIGITS).drop("freq")


# ---- bands --------------------------------------------------------------

_NAMES = ["total", *sg.BANDS]


@query("band_power_sum", f"WITH {_SUMS} SELECT file_id, channel, {_rounded(_NAMES)} FROM sums")
def _(h):
    return rounded(sg.band_power_sum(spectra(h)), *_NAMES, digits=DIGITS)


@query("band_power_trapz", f"WITH {_AREAS} SELECT file_id, channel, {_rounded(_NAMES)} FROM areas")
def _(h):
    return rounded(sg.band_power_trapz(spectra(h)), *_NAMES, digits=DIGITS)


_REL = ", ".join(f'"{b}" / (total + 1e-9) AS "{b}"' for b in sg.BANDS)


@query("relative_band_power", f"""WITH {_SUMS}, r AS (SELECT file_id, channel, {_REL} FROM sums)
    SELECT file_id, channel, {_rounded(sg.BANDS, 6)} FROM r""")
def _(h):
    return rounded(sg.relative_band_power(sg.band_power_sum(spectra(h)), sg.BANDS, 1e-9), *sg.BANDS)


@query("snr_bands_db", f"""WITH {_AREAS} SELECT file_id, channel,
    round(10 * log10((total + 1e-12) / ("Gamma" + 1e-12)), 6) AS snr_db FROM areas""")
def _(h):
    return spectra(h).select("file_id", "channel", F.round(sg.snr_bands_db(), 6).alias("snr_db"))


_PROXY = f"""proxy AS (SELECT file_id, median(db) AS snr FROM (SELECT file_id, channel,
    10 * log10({_sum(1, 40)} / ({_sum(40, 80)} + 1e-9)) AS db FROM psd
    GROUP BY file_id, channel) c GROUP BY file_id)"""


@query("snr_proxy_db", f"WITH {_PSD}, {_PROXY} SELECT file_id, round(snr, 6) AS snr FROM proxy")
def _(h):
    return rounded(sg.snr_proxy_db(spectra(h)), "snr")


def _peak(where="true"):
    return f"""peaks AS (SELECT file_id, arg_max(freq, (m, -freq)) AS alpha_peak FROM (SELECT file_id, freq,
      avg(power) AS m FROM psd WHERE {_inside(8, 13)} AND {where} GROUP BY file_id, freq) c
      GROUP BY file_id)"""


@query("alpha_peak", f"WITH {_PSD}, {_peak()} SELECT file_id, round(alpha_peak, 6) AS alpha_peak FROM peaks")
def _(h):
    return rounded(sg.alpha_peak(spectra(h)), "alpha_peak")


_POSTERIOR = f"{o.SIGNAL}, {o.psd(256, 0.0, 'hamming')}"
_POST_PEAK = _peak(f"channel IN {o.in_list(ch.POSTERIOR)}")


@query("posterior_alpha_peak", f"""WITH {_POSTERIOR}, {_POST_PEAK} SELECT file_id,
    round(alpha_peak, 6) AS alpha_peak FROM peaks""")
def _(h):
    return rounded(sg.posterior_alpha_peak(h.signals(), chunked=True), "alpha_peak")


@query("alpha_window", f"""WITH {_PSD}, {_peak()} SELECT file_id, round(alpha_peak, 6) AS alpha_peak FROM peaks
    WHERE alpha_peak BETWEEN 7 AND 14""")
def _(h):
    return rounded(sg.alpha_window(sg.alpha_peak(spectra(h))), "alpha_peak")


# ---- amplitudes and correlation ----------------------------------------


@query("flat_channels", f"""WITH {o.SIGNAL}, d AS (SELECT file_id, channel, stddev_pop(x) AS sd FROM pts
    GROUP BY file_id, channel) SELECT file_id, count(*) FILTER (sd < 0.125) AS n_flat_channels,
    count(*) AS n_channels FROM d GROUP BY file_id""")
def _(h):
    return sg.flat_channels(h.signals(), 0.125)


@query("uneven_rates", f"""WITH {o.SIGNAL}, slow AS (SELECT DISTINCT file_id FROM h_signal WHERE split_part(file_id, '_', 2)::bigint % 3 = 1),
    pairs AS (SELECT a.file_id, CASE WHEN s.file_id IS NULL OR 'O1' NOT IN (a.channel, b.channel) THEN corr(a.x, b.x) END AS r
      FROM pts a JOIN pts b ON a.file_id = b.file_id AND a.i = b.i AND a.channel < b.channel LEFT JOIN slow s ON s.file_id = a.file_id
      GROUP BY a.file_id, a.channel, b.channel, s.file_id)
    SELECT file_id, round(avg(abs(r)), 6) AS skipped, CASE WHEN count(*) = count(r) THEN round(avg(abs(r)), 6) END AS whole
    FROM pairs GROUP BY file_id""")
def _(h):
    """One channel of every third recording has half the rate of the others."""
    slow = (F.col("channel") == "O1") & (F.regexp_extract("file_id", r"(\d+)$", 1).cast("bigint") % 3 == 1)
    every_second = F.filter("samples", lambda x, i: i % 2 == 0)
    half = lambda c: F.when(slow, F.floor(F.col(c) / 2)).otherwise(F.col(c)).cast("bigint")
    rows = h.signals().withColumns({
        "samples": F.when(slow, every_second).otherwise(F.col("samples")), "n_samples": half("n_samples"), "start": half("start"),
        "sfreq": F.when(slow, F.col("sfreq") / 2).otherwise(F.col("sfreq"))})
    f = sg.signals_to_frames(rows)
    both = sg.interchannel_corr(f).withColumnRenamed("mean_corr", "skipped").join(
        sg.interchannel_corr(f, skip_undefined=False).withColumnRenamed("mean_corr", "whole"), "file_id")
    return rounded(both, "skipped", "whole")


_CORR = f"""pairs AS (SELECT a.file_id, a.channel AS ca, b.channel AS cb, corr(a.x, b.x) AS r
    FROM pts a JOIN pts b ON a.file_id = b.file_id AND a.i = b.i AND a.channel < b.channel
    GROUP BY ALL), rr AS (SELECT file_id, avg(abs(r)) AS mean_corr FROM pairs GROUP BY file_id)"""


@query("pair_correlation", f"""WITH {o.SIGNAL}, {_CORR} SELECT file_id, ca AS a, cb AS b, round(r, 6) AS r
    FROM pairs""")
def _(h):
    p = sg.pair_correlation(frames(h))
    return p.select("file_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                    F.round("r", 6).alias("r"))


@query("interchannel_corr", f"""WITH {o.SIGNAL}, {_CORR} SELECT file_id, round(mean_corr, 6) AS mean_corr
    FROM rr""")
def _(h):
    return rounded(sg.interchannel_corr(frames(h)), "mean_corr")


# ---- recordings ---------------------------------------------------------

_FEATURES = [f"{b}_{s}" for b in sg.BANDS for s in ("mean", "max")]
_FEAT = f"""{_SUMS}, {_peak()}, r AS (SELECT file_id, channel, {_REL} FROM sums), feat AS (SELECT file_id,
    {', '.join(f'avg("{b}") AS "{b}_mean", max("{b}") AS "{b}_max"' for b in sg.BANDS)}
    FROM r GROUP BY file_id)"""


@query("signal_features", f"""WITH {_FEAT} SELECT f.file_id, {_rounded(_FEATURES, 6)},
    round(p.alpha_peak, 6) AS "Alpha_Peak_Hz" FROM feat f LEFT JOIN peaks p ON p.file_id = f.file_id""")
def _(h):
    return rounded(sg.signal_features(spectra(h)), *_FEATURES, "Alpha_Peak_Hz")


_RELS = [f"{b.lower()}_rel" for b in sg.BANDS]
_CHAN_TAIL = f"""chan AS (SELECT file_id, channel,
    {', '.join(f'"{b}" / nullif(total, 0) AS {b.lower()}_rel' for b in sg.BANDS)},
    10 * log10((total + 1e-12) / ("Gamma" + 1e-12)) AS snr_db,
    CASE WHEN "Alpha" > 0 THEN peak END AS alpha_peak_hz FROM areas)"""
_CHAN = f"{_AREAS}, {_CHAN_TAIL}"
_CHAN_EDF = f"{_AREAS.replace(_PSD, _PSD_EDF)}, {_CHAN_TAIL}"


@query("channel_quality", f"""WITH {_CHAN} SELECT file_id, channel,
    {_rounded([*_RELS, 'snr_db', 'alpha_peak_hz'], 6)} FROM chan""")
def _(h):
    return rounded(sg.channel_quality(spectra(h)), *_RELS, "snr_db", "alpha_peak_hz")


def states(h):
    """All that one pass over the recordings keeps."""
    return sg.signal_states(read_frames(h, 0.32, ("ECG", "A1")), [sg.quality_spectrum(points=LENGTH)])


@query("channel_measures", f"""WITH {_CHAN_EDF} SELECT file_id, channel,
    {_rounded([*_RELS, 'snr_db', 'alpha_peak_hz'], 5)} FROM chan""")
def _(h):
    return rounded(sg.channel_measures(states(h)), *_RELS, "snr_db", "alpha_peak_hz", digits=5)


def recordings(h):
    """Split, class and length of the host recordings."""
    n = F.regexp_extract("file_id", r"(\d+)$", 1).cast("bigint")
    return h.signals().groupBy("file_id", "sfreq").agg(
        F.max("n_samples").alias("n_samples")).select(
        "file_id", "sfreq", F.when(n % 3 == 0, "eval").otherwise("train").alias("split"),
        F.when(n % 2 == 0, "abnormal").otherwise("normal").alias("label"),
        ((F.col("n_samples") - 1) * 1000 / F.col("sfreq")).alias("dur_ms"))


_RECORDINGS = """recs AS (SELECT file_id, sfreq, max(n_samples) AS n_samples,
    CASE WHEN split_part(file_id, '_', 2)::bigint % 3 = 0 THEN 'eval' ELSE 'train' END AS split,
    CASE WHEN split_part(file_id, '_', 2)::bigint % 2 = 0 THEN 'abnormal' ELSE 'normal' END AS label
    FROM h_signal GROUP BY ALL)"""


@query("file_quality", f"""WITH {_CHAN_EDF}, {_CORR}, {_RECORDINGS} SELECT r.file_id, r.split, r.label, r.sfreq,
    round((r.n_samples - 1) / r.sfreq / 60, 6) AS duration_min, round(avg(c.snr_db), 6) AS mean_snr_db,
    round(min(c.snr_db), 6) AS min_snr_db, round(max(rr.mean_corr), 6) AS mean_inter_channel_corr
    FROM recs r JOIN chan c ON c.file_id = r.file_id LEFT JOIN rr ON rr.file_id = r.file_id
    GROUP BY r.file_id, r.split, r.label, r.sfreq, r.n_samples""")
def _(h):
    # lengths count whole records
    n = F.floor(F.col("_rows") / 19) * 64
    lengths = h.signals().groupBy("file_id").agg(F.count("*").alias("_rows"))
    heads = recordings(h).drop("dur_ms").join(lengths, "file_id").withColumn("dur_ms", (n - 1) * 1000 / F.col("sfreq"))
    q = sg.file_measures(states(h), heads.drop("_rows"))
    return rounded(q, "duration_min", "mean_snr_db", "min_snr_db", "mean_inter_channel_corr")


@query("channel_class_join", f"""WITH {_CHAN}, {_RECORDINGS} SELECT c.file_id, c.channel,
    round(c.snr_db, 6) AS snr_db, r.label FROM chan c JOIN recs r ON r.file_id = c.file_id""")
def _(h):
    j = sg.channel_class_join(sg.channel_quality(spectra(h)), recordings(h))
    return rounded(j.select("file_id", "channel", "snr_db", "label"), "snr_db")


@query("channel_mean_snr", f"""WITH {_CHAN} SELECT channel, round(avg(snr_db), 6) AS mean, count(*) AS n
    FROM chan GROUP BY channel""")
def _(h):
    return rounded(st.channel_means(sg.channel_quality(spectra(h)), "snr_db"), "mean")



_FOUR = [b for b in sg.BANDS if b != "Gamma"]
_STATS = f"""{o.SIGNAL_EDF}, {o.psd('sfreq * 10')}, {o.psd('sfreq * 2', tag='_2')},
    {o.psd(256, 0.0, 'hamming', tag='_256')}, {_POST_PEAK.replace('FROM psd', 'FROM psd_256')}, {_PROXY}, {_CORR}, four AS (SELECT file_id,
      {', '.join(f'avg("{b}" / (total + 1e-9)) AS "{b}"' for b in _FOUR)} FROM (
        SELECT file_id, channel, {_sum(0.5, 30)} AS total,
        {', '.join(f'{_sum(*sg.BANDS[b])} AS "{b}"' for b in _FOUR)} FROM psd_2
        GROUP BY file_id, channel) c GROUP BY file_id),
    who AS (SELECT DISTINCT file_id, CASE WHEN split_part(file_id, '_', 2)::bigint % 2 = 0
      THEN 'Abnormal' ELSE 'Normal' END AS "group", CASE WHEN split_part(file_id, '_', 2)::bigint % 3 = 0
      THEN 'eval' ELSE 'train' END AS subset FROM h_signal)"""


@query("recording_signal_stats", f"""WITH {_STATS} SELECT w.file_id, w."group", w.subset, round(p.snr, 4) AS snr,
    round(k.alpha_peak, 6) AS alpha_peak, round(rr.mean_corr, 6) AS correlation, {', '.join(f'round(f."{b}", 6) AS "{b}"' for b in _FOUR)}
    FROM who w JOIN proxy p ON p.file_id = w.file_id LEFT JOIN rr ON rr.file_id = w.file_id
    JOIN four f ON f.file_id = w.file_id LEFT JOIN peaks k ON k.file_id = w.file_id""")
def _(h):
    """The job over a folder of recordings, which have channels beside the scalp."""
    s = pipelines.assess_signals(h.spark, edf_folder(h, False, ("ECG", "A1")), chunk_sec=0.1)
    return rounded(s, "correlation", "alpha_peak", *_FOUR).withColumn("snr", F.round("snr", 4))


@query("metric_median_iqr", f"""WITH {_CHAN}, m AS (SELECT 'snr_db' AS metric, snr_db AS v FROM chan
      UNION ALL SELECT 'delta_rel', delta_rel FROM chan UNION ALL
      SELECT 'alpha_peak_hz', alpha_peak_hz FROM chan)
    SELECT metric, count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q1,
    round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
    round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM m WHERE v IS NOT NULL
    GROUP BY metric""")
def _(h):
    m = st.metric_median_iqr(sg.channel_quality(spectra(h)),
                             {"snr_db": 0.01, "delta_rel": 0.01, "alpha_peak_hz": 0.01})
    return rounded(m, "q1", "median", "q3", "iqr")


_LONG = f"""{_CHAN}, {_RECORDINGS}, long AS (SELECT r.label AS "group", c.* FROM (
      {' UNION ALL '.join(f"SELECT file_id, channel, '{b}' AS band, {b} AS value FROM chan" for b in _RELS[:4])}
    ) c JOIN recs r ON r.file_id = c.file_id)"""


def banded(h):
    j = sg.channel_class_join(sg.channel_quality(spectra(h)), recordings(h))
    return j.withColumnRenamed("label", "group")


@query("band_long", f"WITH {_LONG} SELECT file_id, channel, \"group\", band, round(value, 6) AS value FROM long")
def _(h):
    return rounded(st.band_long(banded(h), ["file_id", "channel", "group"], _RELS[:4]), "value")


@query("group_band_medians", f"""WITH {_LONG} SELECT "group", band, count(value) AS n,
    round(median(value), 6) AS median FROM long WHERE value IS NOT NULL GROUP BY "group", band""")
def _(h):
    return rounded(st.group_medians(banded(h), "group", _RELS[:4], 0.01), "median")


@query("band_box_stats", f"""WITH {_LONG}, b AS (SELECT "group" AS g, band AS bd, count(value) AS n,
      quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS c
      FROM long WHERE value IS NOT NULL GROUP BY "group", band)
    SELECT g AS "group", bd AS band, n, round(a, 6) AS q1, round(m, 6) AS median, round(c, 6) AS q3,
    round(min(value) FILTER (value >= a - 1.5 * (c - a)), 6) AS whisker_low,
    round(max(value) FILTER (value <= c + 1.5 * (c - a)), 6) AS whisker_high
    FROM long JOIN b ON g = "group" AND bd = band GROUP BY g, bd, n, a, m, c""")
def _(h):
    long = st.band_long(banded(h), ["file_id", "channel", "group"], _RELS[:4])
    return rounded(st.box_stats(long, ["group", "band"], "value", 0.01), *st.QUARTILES,
                   "whisker_low", "whisker_high")


# ---- model --------------------------------------------------------------

COLUMNS = ["mean", "std", "min", "max"]


def features(h):
    """One row per vector: simple amplitudes, a class and gaps to be filled."""
    v = h.table("embeddings").select("vec_id", "label", F.explode("embedding").alias("x"))
    f = v.groupBy("vec_id", "label").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").cast("double").alias("min"), F.max("x").cast("double").alias("max"))
    return f.select(
        F.col("vec_id").cast("string").alias("file_id"), (F.col("label") % 2).alias("label"),
        "mean", F.when(F.col("vec_id") % 50 != 0, F.col("std")).alias("std"), "min", "max")


_FEATSQL = """v AS (SELECT vec_id, label, unnest(embedding)::double AS x FROM embeddings),
    f AS (SELECT vec_id, label, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM v
      GROUP BY vec_id, label), m AS (SELECT cast(vec_id AS varchar) AS file_id, label % 2 AS y, mean,
      CASE WHEN vec_id % 50 <> 0 THEN std ELSE 0 END AS std, min, max FROM f)"""


@query("feature_matrix", f"""WITH {_FEATSQL} SELECT file_id, y, round(mean, 6) AS mean, round(std, 6) AS std,
    round(min, 6) AS min, round(max, 6) AS max FROM m""")
def _(h):
    from pyspark.ml.functions import vector_to_array
    m = md.feature_matrix(features(h), COLUMNS, "label")
    a = vector_to_array("raw")
    return m.select("file_id", "y", *[F.round(a[i], 6).alias(c) for i, c in enumerate(COLUMNS)])


def _parts(h):
    m = md.feature_matrix(features(h), COLUMNS, "label")
    parted = sp.random_split(m, "file_id")
    return [parted.where(F.col("part") == p) for p in ("train", "test")]


_SCALED = f"""{_FEATSQL}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || file_id),
      file_id) AS k, count(*) OVER () AS n FROM m),
    p AS (SELECT *, k <= ceil(0.3::double * n) AS test FROM r),
    s AS (SELECT avg(mean) AS a1, stddev_pop(mean) AS d1, avg(std) AS a2, stddev_pop(std) AS d2,
      avg(min) AS a3, stddev_pop(min) AS d3, avg(max) AS a4, stddev_pop(max) AS d4 FROM p WHERE NOT test),
    z AS (SELECT file_id, y, test, (mean - a1) / d1 AS mean, (std - a2) / d2 AS std,
      (min - a3) / d3 AS min, (max - a4) / d4 AS max FROM p, s)"""


@query("standardize", f"""WITH {_SCALED} SELECT file_id, round(mean, 5) AS mean, round(std, 5) AS std,
    round(min, 5) AS min, round(max, 5) AS max FROM z WHERE test""")
def _(h):
    from pyspark.ml.functions import vector_to_array
    _, test = md.standardize(*_parts(h))
    a = vector_to_array("features")
    return test.select("file_id", *[F.round(a[i], 5).alias(c) for i, c in enumerate(COLUMNS)])


def _fitted(h):
    train, test = md.standardize(*_parts(h))
    return md.baseline_classifier(train), test


# the same loss by gradient steps, until they no longer move it
_SUM = "w + " + " + ".join(f"w_{c} * {c}" for c in COLUMNS)
_MISS = f"(1 / (1 + exp(-({_SUM}))) - y)"
_FIT = f"""{_SCALED}, steps(i, w, {', '.join(f'w_{c}' for c in COLUMNS)}) AS (
      SELECT 0, 0::double{', 0::double' * len(COLUMNS)} UNION ALL
      SELECT i + 1, w - 1.5 * avg({_MISS}),
        {', '.join(f'w_{c} - 1.5 * (avg({_MISS} * {c}) + w_{c} / count(*))' for c in COLUMNS)}
      FROM steps, z WHERE i < 200 AND NOT test GROUP BY i, w, {', '.join(f'w_{c}' for c in COLUMNS)}),
    fit AS (SELECT * FROM steps WHERE i = 200)"""


@query("baseline_classifier", f"""WITH RECURSIVE {_FIT}, scored AS (SELECT file_id, y::int AS y,
      1 / (1 + exp(-({_SUM}))) AS score FROM z, fit WHERE test)
    SELECT file_id, y, CASE WHEN score > 0.5 THEN 1 ELSE 0 END::int AS pred, round(score, 3) AS score FROM scored""")
def _(h):
    model, test = _fitted(h)
    return md.predict(model, test).withColumn("score", F.round("score", 3))


@query("coefficient_table", f"""WITH RECURSIVE {_FIT}
    {' UNION ALL '.join(f"SELECT '{c}' AS feature, round(w_{c}, 4) AS coefficient FROM fit" for c in COLUMNS)}""")
def _(h):
    model, _ = _fitted(h)
    return md.coefficient_table(h.spark, model, COLUMNS).withColumn("coefficient", F.round("coefficient", 4))
