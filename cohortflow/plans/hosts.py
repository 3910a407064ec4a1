"""Views that give the driver's tables the shapes the operators work on.

The SQL texts run unchanged in Spark and in the checking engine; ``{name}``
stands for an input table. They use aggregations and joins only, so a hot user
or customer is combined map-side or split by adaptive execution.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.channels import SCALP_19_MIXED
from ..session import configure

COMMENTS = (
    "Delta waves", "  delta  slow waves ", "Theta_Waves", "SPIKE AND WAVE", "sharp waves",
    "polyspikes", "low  voltage", "beta waves", "No Comment", "generalized 3.5 hertz odd text",
    "burst-suppression", "GPEDs", "delta/theta", "triphasic waves'", "Spike & Polyspike wave",
    "muscle", "isoelectric trace", '"spike wave"', "delta slow waves\\", "Low Voltage",
    "Delta and Theta Wave", "Sharp Wave", "periodic lateral discharges", "spike then delta run",
    "alpha:rhythm", "mild slowing noted", "No Electrical Activity", "eye artifact run",
    "Spike and Wave", " Artifacts", "Burst Suppression", "Triphasic Wave", "theta and delta run",
    "sharp transients", "slow wave seen", "loud polyspike burst", "nan",
)
CHANNEL_TEXTS = ("FP1, FP2 F3", "Fp1 fp2", "O1 O2 XX9", "", "['C3','C4']", "P3;P4|PZ", "A1 ECG")


def _text(s: str) -> str:
    """A literal both engines read alike, whatever quotes it holds."""
    if not any(c in s for c in "\\'"):
        return f"'{s}'"
    parts = [f"chr({ord(c)})" if c in "\\'" else f"'{c}'" for c in s]
    return "concat(" + ", ".join(parts) + ")"


def _pick(expr: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _clock(ms: str) -> str:
    def part(expr, width):
        return f"lpad(cast({expr} AS string), {width}, '0')"
    whole = lambda unit: f"cast(floor({ms}/{unit}) AS bigint)"
    return ("concat(" + part(whole(3600000), 2) + ",':'," + part(f"{whole(60000)}%60", 2)
            + ",':'," + part(f"{whole(1000)}%60", 2) + ",':'," + part(f"{ms}%1000", 3) + ")")


_FILE_ID = ("concat('mh_', cast(2019 + user_id % 6 AS string), '_', "
            "lpad(cast(user_id AS string), 7, '0'))")

EVENTS_SQL = f"""
SELECT {_FILE_ID} AS file_id, user_id, event_id, event_id AS row_no,
  CASE WHEN event_id = first_id AND user_id % 10 <> 9 THEN {_clock('fs_ms')} END AS file_start,
  CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE {_clock('s_ms')} END AS start_time,
  CASE WHEN event_id % 89 = 0 THEN {_clock('s_ms')} ELSE {_clock('e_ms')} END AS end_time,
  {_pick(f'event_id % {len(CHANNEL_TEXTS)}', CHANNEL_TEXTS)} AS channel_names,
  CASE WHEN event_id % 53 = 0 THEN NULL
       ELSE {_pick(f'event_id % {len(COMMENTS)}', COMMENTS)} END AS comment
FROM (SELECT *, (fs_ms + rel_ms) % 86400000 AS s_ms,
             (fs_ms + rel_ms + len_ms) % 86400000 AS e_ms
      FROM (SELECT e.event_id, e.user_id, f.first_id,
                   (e.user_id * 1234567) % 86400000 AS fs_ms,
                   (e.event_id * 86413) % 1200000 AS rel_ms,
                   cast(round(e.value * 100) AS bigint) % 15000 AS len_ms
            FROM {{events}} e JOIN (SELECT user_id, min(event_id) AS first_id
                                  FROM {{events}} GROUP BY user_id) f
            ON e.user_id = f.user_id) t) u
"""

HEADERS_SQL = f"""
SELECT DISTINCT concat({_FILE_ID}, CASE WHEN user_id % 13 = 12 THEN '-lost' ELSE '' END) AS file_id,
  CASE WHEN user_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
  CASE WHEN user_id % 3 = 0 THEN 'abnormal' ELSE 'normal' END AS label,
  CASE WHEN user_id % 17 = 0 THEN 256.0E0 ELSE 200.0E0 END AS sfreq,
  900000 + (user_id % 5) * 100000 AS dur_ms,
  CASE WHEN user_id % 11 = 0 THEN 'FP1 FP2 F3 O1'
       WHEN user_id % 7 = 0 THEN 'FP1 FP2 F7 F3 FZ F4 F8 T3 C3 CZ C4 T4 T5 P3 PZ P4 T6 O1 O2'
       ELSE 'FP1 FP2 F3 F4 O1 O2 A1 C3 C4' END AS channel_text
FROM {{events}}
"""

_STEM = """CASE {k} % 3
  WHEN 0 THEN concat('mh_', cast(2018 + {k} % 7 AS string), '_', lpad(cast({k} AS string), 7, '0'))
  WHEN 1 THEN concat('ffh_', cast(2018 + {k} % 7 AS string), '_', lpad(cast({k} AS string), 7, '0'))
  ELSE concat('other_', cast({k} AS string)) END"""

# every tenth customer repeats the name of the one before: duplicate stems
_KEY = "CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END"

MANIFEST_SQL = f"""
SELECT CASE k % 3 WHEN 0 THEN concat(' "E:/eeg/', upper({_STEM.format(k='k')}), '.EDF" ')
                  WHEN 1 THEN concat({_STEM.format(k='k')}, '.edf')
                  ELSE {_STEM.format(k='k')} END AS file_name,
  c_custkey AS row_no,
  CASE c_custkey % 5 WHEN 0 THEN ' ABNORMAL ' WHEN 1 THEN 'abnormal eeg' WHEN 4 THEN ''
                     ELSE 'Normal' END AS raw_label,
  CASE c_custkey % 7 WHEN 0 THEN 'Testing' WHEN 1 THEN ' EVAL' WHEN 2 THEN 'hold' ELSE 'train'
    END AS raw_split,
  CASE WHEN c_custkey % 23 = 0 THEN '' ELSE cast(c_custkey % 125 AS string) END AS age_years,
  CASE WHEN c_custkey % 4 = 0 THEN 'n/a' WHEN c_custkey % 29 = 0 THEN ''
       ELSE cast(c_custkey % 12 AS string) END AS age_months,
  CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'Male' WHEN 3 THEN NULL
                     WHEN 4 THEN 'f' ELSE 'x' END AS gender,
  c_acctbal
FROM (SELECT *, {_KEY} AS k FROM {{customer}}) c
"""

FILES_SQL = f"""
SELECT DISTINCT concat('/release/', CASE WHEN split_no IN (0, 1) THEN 'evaluation' ELSE 'train' END,
  '/', CASE WHEN class_no IN (0, 1) THEN 'abnormal' ELSE 'normal' END,
  '/', CASE kind WHEN 0 THEN 'edf' WHEN 1 THEN 'reports' ELSE 'annotations' END,
  '/', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('b', cast(o_orderkey AS string), '/') END,
  {_STEM.format(k='o_custkey')},
  CASE kind WHEN 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '.EDF' ELSE '.edf' END
            WHEN 1 THEN CASE WHEN o_orderkey % 4 = 0 THEN '.docx' ELSE '.txt' END
            ELSE '.csv' END) AS path
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS kind,
             (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 5 AS class_no,
             (o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) % 7 AS split_no
      FROM {{orders}}) o
"""

SCORES_SQL = """
SELECT l.doc_id, l.quality AS y, (d.n_chars % 101) / 100.0E0 AS score,
       CASE WHEN d.n_chars % 101 >= 50 THEN 1 ELSE 0 END AS pred, d.n_chars % 5 AS input_len
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

PEOPLE_SQL = """
SELECT concat('mh_', cast(2019 + c_custkey % 6 AS string), '_',
              lpad(cast(c_custkey AS string), 7, '0')) AS file_id,
  c_custkey AS row_no,
  CASE WHEN c_custkey % 31 = 0 THEN NULL
       ELSE ((c_custkey * 7) % 2500) / 20.0E0 END AS age,
  CASE c_custkey % 6 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'male' WHEN 3 THEN NULL
                     WHEN 4 THEN 'female' ELSE 'x' END AS gender,
  CASE WHEN c_custkey % 4 = 0 THEN 'abnormal' ELSE 'normal' END AS label,
  CASE WHEN c_custkey % 19 = 0 THEN 'n/a'
       ELSE cast(round(abs(c_acctbal)) AS bigint) || '.5' END AS minutes
FROM {customer}
"""

CLOCKS_SQL = f"""
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN start_time
  WHEN 1 THEN concat(substr(start_time, 1, 8), '.', substr(start_time, 10, 3))
  WHEN 2 THEN substr(start_time, 1, 8)
  WHEN 3 THEN substr(start_time, 1, 10)
  WHEN 4 THEN concat(' ', substr(start_time, 1, 8), '.5 ')
  WHEN 5 THEN cast(event_id % 90 AS string)
  WHEN 6 THEN '99:99:99:7'
  ELSE substr(start_time, 1, 5) END AS clock
FROM ({EVENTS_SQL}) e
"""

_CHANNEL = _pick("vec_id % 19", SCALP_19_MIXED)

# 76 vectors make a recording of 19 channels in 4 chunks of 64 samples
SIGNAL_SQL = f"""
SELECT c.file_id, c.chunk, c.channel, c.sfreq, n.n_samples, c.chunk * 64 AS start, c.samples
FROM (SELECT concat('rec_', cast(cast(floor(vec_id / 76) AS bigint) AS string)) AS file_id,
             cast(floor(vec_id / 19) AS bigint) % 4 AS chunk, {_CHANNEL} AS channel,
             CASE WHEN cast(floor(vec_id / 76) AS bigint) % 7 = 1 THEN 200.0E0
                  ELSE 100.0E0 END AS sfreq,
             embedding AS samples
      FROM {{embeddings}}) c
JOIN (SELECT concat('rec_', cast(cast(floor(vec_id / 76) AS bigint) AS string)) AS file_id,
             {_CHANNEL} AS channel, count(*) * 64 AS n_samples
      FROM {{embeddings}} GROUP BY 1, 2) n
ON c.file_id = n.file_id AND c.channel = n.channel
"""


class Hosts:
    """Host views over one data folder; every call builds a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self.table(n) for n in names})

    def events(self) -> DataFrame:
        return self._sql(EVENTS_SQL, "events")

    def headers(self) -> DataFrame:
        return self._sql(HEADERS_SQL, "events").withColumn(
            "channels", F.split("channel_text", " ")).withColumn(
            "dur_ms", F.col("dur_ms").cast("bigint"))

    def manifest(self) -> DataFrame:
        return self._sql(MANIFEST_SQL, "customer")

    def files(self) -> DataFrame:
        return self._sql(FILES_SQL, "orders")

    def scores(self) -> DataFrame:
        return self._sql(SCORES_SQL, "labels", "documents")

    def people(self) -> DataFrame:
        return self._sql(PEOPLE_SQL, "customer")

    def clocks(self) -> DataFrame:
        return self._sql(CLOCKS_SQL, "events")

    def signals(self) -> DataFrame:
        return self._sql(SIGNAL_SQL, "embeddings")

    def whole_signals(self) -> DataFrame:
        """One row per channel: a recording here has four chunks at most."""
        s = self.signals()
        joined = F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("chunk", "samples"))), lambda c: c["samples"]))
        return s.groupBy("file_id", "channel", "sfreq", "n_samples").agg(
            joined.alias("samples")).withColumn("start", F.lit(0).cast("bigint")).withColumn(
            "chunk", F.lit(0).cast("bigint"))
