"""Literal cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import channels as ch, taxonomy, text
from cohortflow.functions.clock import clock_ms, parse_clock, seconds_since_start
from cohortflow.operators import labels


def apply(spark, cases, f):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").select(
        "x").collect()]


def test_clean_stem(spark):
    cases = ['"E:\\a\\MH_2023_1.EDF"', "a.tar.gz", ".hid", " 'x/y/Z.csv' ", "a/b/", "E:q.edf",
             "plain", "a.", None]
    want = ["mh_2023_1", "a.tar", ".hid", "z", "b", "q", "plain", "a.", None]
    assert apply(spark, cases, text.clean_stem) == want


def test_classes_and_splits(spark):
    assert apply(spark, ["Abnormal EEG", "NORMAL", "x", None], text.normalize_class) == [
        "Abnormal", "Normal", "", ""]
    assert apply(spark, ["Testing", " TRAIN ", "other", "eval"], text.normalize_split) == [
        "evaluation", "train", "other", "evaluation"]


def test_source_year(spark):
    got = apply(spark, ["FFH_2024_7", "mh_2019_1", "zz_1", "mh_19_1"], text.parse_source_year)
    assert [tuple(r) for r in got] == [("ffh", "2024"), ("mh", "2019"), ("unknown", "unknown"),
                                       ("unknown", "unknown")]


@pytest.mark.parametrize("years, months, want", [
    ("3", "6", 3.5), ("", "6", 0.5), ("", "", None), ("x", "y", None), (" 3 ", "n/a", 3.0),
    ("nan", "6", 0.5), ("7", "1", 7.08)])
def test_make_age(spark, years, months, want):
    df = spark.createDataFrame([(years, months)], "y string, m string")
    assert df.select(text.make_age(F.col("y"), F.col("m"))).first()[0] == want


@pytest.mark.parametrize("dialect, cases", [
    ("strict", {"01:00:00:106": 3600.106, "1:2:3": 3723.0, "00:00:00.5": 0.5, "00:00": None,
                "99:99:99": 362439.0, " 0:0:1 ": 1.0, "bad": None, "1 2:03:04": None}),
    ("loose", {"00:00:00.5": 0.005, "00:00:01:250": 1.25, "00:00:02": 2.0, "7": None}),
    ("sentinel", {"00:00:01.25": 1.25, "7": 7.0, "bad": -1.0, "00:00:00:5": 0.005, "1:2": -1.0}),
    ("ranged", {"00:00:01:5": 1.5, "00:00:01": None, "25:00:00:000": None, "23:59:59:999": 86399.999}),
    ("dotted", {"00:00:00.5": 0.005, "00:00:03": 3.0, "00:00": None}),
])
def test_clock_dialects(spark, dialect, cases):
    got = apply(spark, list(cases), lambda c: parse_clock(c, dialect))
    assert got == pytest.approx(list(cases.values()))


def test_null_clocks(spark):
    got = apply(spark, [None], lambda c: clock_ms(c, "strict"))
    assert got == [None]
    assert apply(spark, [None], lambda c: clock_ms(c, "sentinel")) == [-1000.0]


def test_rollover(spark):
    df = spark.createDataFrame([("23:59:59:000", "00:00:01:000")], "s string, t string")
    assert df.select(seconds_since_start(F.col("s"), F.col("t"))).first()[0] == 2.0


def test_comment_keys(spark):
    key = lambda rule: (lambda c: labels.comment_key(c, rule))
    assert apply(spark, ["  Spike  and WAVE ", "\"'x'\"", None], key("full")) == [
        "spike and wave", "x", ""]
    assert apply(spark, ["delta slow waves\\", "low voltage (no waveform)", "a_b/c", None],
                 key("audit")) == ["delta slow waves", "low voltage no waveform", "a b c", "nan"]
    assert apply(spark, ["generalized 3.5 hertz spike", "burst-suppression", "a: b\tc", None],
                 key("clinical")) == ["generalized 35 hertz spike", "burstsuppression", "a bc", "nan"]


def test_labels(spark):
    rows = spark.createDataFrame([(c,) for c in (
        "delta slow waves\\", "low voltage (no waveform)", "generalized 3.5 hertz spike", None)],
        "comment string")
    audit = {r.comment: r.label for r in labels.map_label(rows).collect()}
    assert audit["delta slow waves\\"] == "Delta Slow Wave"
    assert audit["low voltage (no waveform)"] == "Unknown"
    clinical = {r.comment: r.label for r in labels.clinical_label(rows).collect()}
    assert clinical["generalized 3.5 hertz spike"] == "Spike and Wave"
    assert clinical[None] == "Normal"


def test_own_vocabulary(spark):
    table = spark.createDataFrame([("Odd  Wave", "Theta Wave"), ("odd wave", "Theta Wave")],
                                  "variant string, canonical string")
    lookup = labels.label_lookup(spark, "full", table)
    rows = spark.createDataFrame([("'ODD wave'",), ("x",)], "comment string")
    got = labels.map_label(rows, vocabulary="full", lookup=lookup).collect()
    assert {r.comment: r.label for r in got} == {"'ODD wave'": "Theta Wave", "x": "Unknown"}
    with pytest.raises(ValueError):
        labels.label_lookup(spark, "full")


def test_every_variant_has_one_label():
    for table in (taxonomy.AUDIT, taxonomy.CLINICAL):
        keys = [k for ks in table.values() for k in ks]
        assert len(keys) == len(set(keys))
    assert len(taxonomy.EVENT_LABELS) == 10 and len(taxonomy.CLINICAL_ORDER) == 12


def test_channels(spark):
    assert apply(spark, ["FP1, fp2 F3", "", None], ch.parse_channels) == [
        ["FP1", "FP2", "F3"], [], []]
    assert apply(spark, ["['O1','O2']", "(P3;P4|PZ)"], lambda c: ch.parse_channels(c, "wrapped")) \
        == [["O1", "O2"], ["P3", "P4", "PZ"]]
    assert apply(spark, ["['O1', 'O2']"], lambda c: ch.parse_channels(c, "unquoted")) == [
        ["O1", "O2"]]
    repeats = apply(spark, ["X9 O1 X9"], lambda c: ch.not_in(
        ch.parse_channels(c), ch.vocabulary(ch.EXPECTED_22)))
    assert repeats == [["X9", "X9"]]


def test_age_groups(spark):
    got = apply(spark, ["0", "10", "10.5", "120", "121", None],
                lambda c: text.age_group(c.cast("double")))
    assert got == [None, "0–10", "11–20", "70+", None, None]
