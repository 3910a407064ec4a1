"""SQL building blocks of the checks, written apart from the operators.

These texts are for a plain SQL engine and share only fixed values and the host
views with the Spark side.
"""

from __future__ import annotations

import re

from ..functions import taxonomy
from . import hosts


def host(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    cell = lambda v: quoted(v) if isinstance(v, str) else ("NULL" if v is None else str(v))
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def in_list(names) -> str:
    return "(" + ", ".join(quoted(n) for n in names) + ")"


def lookup(table) -> str:
    return values([(k, label) for label, keys in table.items() for k in keys])


def order_dim(names) -> str:
    return values([(n, i) for i, n in enumerate(names)])


# ---- clocks -------------------------------------------------------------

def t1(x: str) -> str:
    x = f"trim({x})"
    full = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(?:[:.](\d{1,3}))?$"
    g = lambda i: f"regexp_extract({x}, '{full}', {i})"
    return (f"CASE WHEN regexp_matches({x}, '{full}') THEN {g(1)}::bigint * 3600000 "
            f"+ {g(2)}::bigint * 60000 + {g(3)}::bigint * 1000 "
            f"+ rpad({g(4)}, 3, '0')::bigint END")


def _ints(x: str, sep: str) -> str:
    d = r"\d+"
    esc = "\\." if sep == "." else sep
    p = lambda i: f"split_part({x}, '{sep}', {i})::bigint"
    hms = f"{p(1)} * 3600000 + {p(2)} * 60000 + {p(3)} * 1000"
    return (f"CASE WHEN regexp_full_match({x}, '{esc.join([d] * 4)}') THEN {hms} + {p(4)} "
            f"WHEN regexp_full_match({x}, '{esc.join([d] * 3)}') THEN {hms} END")


def t2(x: str) -> str:
    return _ints(f"replace(trim({x}), '.', ':')", ":")


def t5(x: str) -> str:
    return _ints(f"trim(replace({x}, ':', '.'))", ".")


def t3(x: str) -> str:
    x = f"trim({x})"
    d = lambda i: f"try_cast(split_part({x}, ':', {i}) AS double)"
    n = f"len(string_split({x}, ':'))"
    four = r"\d+:\d+:\d+:\d+"
    return (f"coalesce(CASE WHEN regexp_full_match({x}, '{four}') THEN {d(1)} * 3600000 "
            f"+ {d(2)} * 60000 + {d(3)} * 1000 + {d(4)} WHEN {n} = 3 THEN {d(1)} * 3600000 "
            f"+ {d(2)} * 60000 + {d(3)} * 1000 WHEN {n} = 1 THEN try_cast({x} AS double) * 1000 "
            f"END, -1000)")


def t4(x: str) -> str:
    p = lambda i: f"split_part({x}, ':', {i})::bigint"
    shape = r"\d{1,2}:\d{1,2}:\d{1,2}:\d{1,6}"
    return (f"CASE WHEN regexp_full_match({x}, '{shape}') THEN CASE WHEN {p(1)} < 24 "
            f"AND {p(2)} < 60 AND {p(3)} < 60 THEN {p(1)} * 3600000 + {p(2)} * 60000 "
            f"+ {p(3)} * 1000 + rpad(split_part({x}, ':', 4), 6, '0')::bigint / 1000.0::double "
            f"END END")


# ---- comments and channels ---------------------------------------------

def key_full(x: str) -> str:
    return (f"lower(regexp_replace(trim(trim(trim(coalesce({x}, '')), '\"'), ''''), "
            r"'\s+', ' ', 'g'))")


def _blanked(x: str) -> str:
    return f"translate(lower(trim(coalesce({x}, 'nan'))), '\\''\"', '   ')"


def key_audit(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({_blanked(x)}, '[_/]+', ' ', 'g'), "
            r"'[^a-z0-9&. ]+', ' ', 'g'), '\s+', ' ', 'g'))")


def key_clinical(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(replace({_blanked(x)}, ':', ''), "
            r"'[_/]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))")


def clinical_rules(k: str) -> str:
    arms = " ".join(
        "WHEN " + " AND ".join(f"contains({k}, '{w}')" for w in words) + f" THEN '{label}'"
        for words, label in taxonomy.CLINICAL_RULES)
    return f"CASE {arms} ELSE 'Normal' END"


def channels(x: str, dialect: str = "spaced") -> str:
    x = f"coalesce({x}, '')"
    text = {
        "spaced": f"replace({x}, ',', ' ')",
        "wrapped": f"regexp_replace(trim(trim({x}), '[](){{}}'), '[,;|''\"]', ' ', 'g')",
        "unquoted": f"replace(regexp_replace({x}, '[''\"\\[\\]]', '', 'g'), ',', ' ')",
    }[dialect]
    return rf"list_filter(regexp_split_to_array(upper({text}), '\s+'), lambda c: c <> '')"


def coarse(x: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.COARSE.items())
    return f"CASE {x} {arms} ELSE {x} END"


def family(x: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.FAMILY.items())
    return f"CASE {x} {arms} ELSE 'Other' END"


def roll(clock: str, start: str) -> str:
    return f"CASE WHEN {clock} < {start} THEN {clock} + 86400000 ELSE {clock} END - {start}"


# ---- common table expressions ------------------------------------------

EVENTS = f"h_events AS ({host(hosts.EVENTS_SQL)}), h_headers AS ({host(hosts.HEADERS_SQL)})"

PREP = f"""{EVENTS},
filled AS (SELECT *, last_value(file_start IGNORE NULLS)
             OVER (PARTITION BY file_id ORDER BY row_no) AS fs FROM h_events),
timed AS (SELECT *, {t1('fs')} AS f_ms, {t1('start_time')} AS s_clock,
             {t1('end_time')} AS e_clock FROM filled),
lk(key, lab) AS ({lookup(taxonomy.AUDIT)}),
prep AS (SELECT t.*, {roll('s_clock', 'f_ms')} AS start_ms, {roll('e_clock', 'f_ms')} AS end_ms,
             {channels('channel_names')} AS chans, coalesce(lk.lab, 'Unknown') AS label
         FROM timed t LEFT JOIN lk ON lk.key = {key_audit('t.comment')})"""

TABLE = f"""{PREP},
ev AS (SELECT p.*, p.end_ms - p.start_ms AS dur_ms, h.split, h.dur_ms AS edf_ms,
         string_split(h.channel_text, ' ') AS edf_channels,
         coalesce(p.start_ms >= 0 AND p.end_ms <= h.dur_ms + 1 AND p.end_ms > p.start_ms, false)
           AS valid_time
       FROM prep p JOIN h_headers h USING (file_id)),
bad AS (SELECT *, CASE WHEN start_ms IS NULL OR end_ms IS NULL
            THEN 'parse_failed_or_missing_time'
          WHEN end_ms <= start_ms THEN 'end_before_or_equal_start'
          WHEN start_ms < 0 OR end_ms < 0 THEN 'negative_time'
          WHEN end_ms > edf_ms THEN 'end_exceeds_edf' ELSE 'other' END AS invalid_reason
        FROM ev WHERE NOT valid_time)"""

GOOD = f"{TABLE}, good AS (SELECT *, {coarse('label')} AS merged FROM ev WHERE valid_time)"

# plain clocks and the clinical label, as the family statistics use them
FAMILY = f"""{EVENTS}, lkc(key, lab) AS ({lookup(taxonomy.CLINICAL)}),
rel AS (SELECT e.*, coalesce(lkc.lab, {clinical_rules(key_clinical('e.comment'))}) AS label
        FROM h_events e LEFT JOIN lkc ON lkc.key = {key_clinical('e.comment')}),
fam AS (SELECT *, {family('label')} AS family, {t4('start_time')} AS s4, {t4('end_time')} AS e4,
          {t5('start_time')} AS s5, {t5('end_time')} AS e5 FROM rel)"""

_STEM_FROM = r"regexp_replace(regexp_extract(trim(trim(trim({x}), '\"'), ''''), '([^/\\]*)$', 1), '\.[^.]+$', '')"


def stem(x: str) -> str:
    return "lower(" + _STEM_FROM.replace(r"\"", '"').format(x=x) + ")"


MANIFEST = f"""h_manifest AS ({host(hosts.MANIFEST_SQL)}),
man AS (SELECT *, {stem('file_name')} AS stem,
   CASE WHEN contains(lower(raw_label), 'abnormal') THEN 'Abnormal'
        WHEN contains(lower(raw_label), 'normal') THEN 'Normal' ELSE '' END AS label,
   CASE WHEN lower(trim(raw_split)) IN ('train', 'training') THEN 'train'
        WHEN lower(trim(raw_split)) IN ('evaluation', 'eval', 'test', 'testing') THEN 'evaluation'
        ELSE lower(trim(raw_split)) END AS split FROM h_manifest),
man2 AS (SELECT *, CASE WHEN regexp_matches(stem, '^(ffh|mh)_[0-9]{{4}}_')
           THEN split_part(stem, '_', 1) ELSE 'unknown' END AS source,
         CASE WHEN regexp_matches(stem, '^(ffh|mh)_[0-9]{{4}}_')
           THEN split_part(stem, '_', 2) ELSE 'unknown' END AS year,
         CASE WHEN try_cast(age_years AS double) IS NULL AND try_cast(age_months AS double) IS NULL
           THEN NULL ELSE round(coalesce(try_cast(age_years AS double), 0)
             + coalesce(try_cast(age_months AS double), 0) / 12, 2) END AS age FROM man),
uniq AS (SELECT * FROM man2 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY row_no) = 1),
rel AS (SELECT * FROM man2 WHERE split IN ('train', 'evaluation') AND label IN ('Normal', 'Abnormal')
        QUALIFY row_number() OVER (PARTITION BY stem ORDER BY row_no) = 1)"""

FILES = f"""h_files AS ({host(hosts.FILES_SQL)}),
inv AS (SELECT path, {stem('path')} AS stem, split_part(path, '/', 3) AS split,
   CASE split_part(path, '/', 4) WHEN 'abnormal' THEN 'Abnormal' ELSE 'Normal' END AS label,
   CASE split_part(path, '/', 5) WHEN 'reports' THEN 'report' WHEN 'edf' THEN 'edf'
     ELSE 'annotation' END AS modality FROM h_files)"""

RELEASE = f"""{MANIFEST}, {FILES},
want AS (SELECT file_name, r.stem, r.split, r.label, m.modality FROM rel r
   JOIN (VALUES ('Normal', 'edf'), ('Normal', 'report'), ('Abnormal', 'edf'),
                ('Abnormal', 'annotation'), ('Abnormal', 'report')) m(label, modality)
   ON r.label = m.label),
folders(split, label, modality, folder) AS (VALUES
  ('train', 'Normal', 'edf', 'train/normal/edf'),
  ('train', 'Normal', 'report', 'train/normal/reports'),
  ('train', 'Abnormal', 'edf', 'train/abnormal/edf'),
  ('train', 'Abnormal', 'annotation', 'train/abnormal/annotations'),
  ('train', 'Abnormal', 'report', 'train/abnormal/reports'),
  ('evaluation', 'Normal', 'edf', 'evaluation/normal/edf'),
  ('evaluation', 'Normal', 'report', 'evaluation/normal/reports'),
  ('evaluation', 'Abnormal', 'edf', 'evaluation/abnormal/edf'),
  ('evaluation', 'Abnormal', 'annotation', 'evaluation/abnormal/annotations'),
  ('evaluation', 'Abnormal', 'report', 'evaluation/abnormal/reports'))"""

LINKED = f"""{MANIFEST}, {FILES},
linked AS (SELECT u.*,
   coalesce(CASE label WHEN 'Normal' THEN (SELECT min(path) FROM inv i WHERE i.stem = u.stem
       AND i.modality = 'edf' AND i.label = 'Normal') WHEN 'Abnormal' THEN (SELECT min(path)
       FROM inv i WHERE i.stem = u.stem AND i.modality = 'edf' AND i.label = 'Abnormal') END, '')
     AS edf_path,
   coalesce(CASE WHEN label IN ('Normal', 'Abnormal') THEN (SELECT min(path) FROM inv i
       WHERE i.stem = u.stem AND i.modality = 'annotation') END, '') AS annotation_csv_path,
   coalesce(CASE label WHEN 'Normal' THEN (SELECT min(path) FROM inv i WHERE i.stem = u.stem
       AND i.modality = 'report' AND i.label = 'Normal') WHEN 'Abnormal' THEN (SELECT min(path)
       FROM inv i WHERE i.stem = u.stem AND i.modality = 'report' AND i.label = 'Abnormal') END, '')
     AS report_path FROM uniq u),
reasoned AS (SELECT *, CASE WHEN label = '' THEN 'invalid or missing label' ELSE
   concat_ws(', ', CASE WHEN edf_path = '' THEN 'missing ' || lower(label) || ' edf' END,
     CASE WHEN report_path = '' THEN 'missing ' || lower(label) || ' report' END,
     CASE WHEN label = 'Abnormal' AND annotation_csv_path = ''
       THEN 'missing abnormal csv annotation' END) END AS missing_reason FROM linked),
valid AS (SELECT *, label || '_' || source || '_' || year AS stratum FROM reasoned
          WHERE missing_reason = '')"""

PEOPLE = f"h_people AS ({host(hosts.PEOPLE_SQL)})"
SCORES = f"h_scores AS ({host(hosts.SCORES_SQL)})"



SIGNAL = f"""h_signal AS ({host(hosts.SIGNAL_SQL)}),
pts AS (SELECT file_id, channel, sfreq, n_samples, start + pos - 1 AS i, samples[pos]::double AS x
        FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS pos FROM h_signal) s)"""


#: The same as the EDF files hold them: whole records, a tenth of a micro-volt per digit.
SIGNAL_EDF = f"""h_raw AS ({host(hosts.SIGNAL_SQL)}),
h_records AS (SELECT file_id, count(*) // 19 AS n_records FROM h_raw GROUP BY file_id),
h_signal AS (SELECT s.file_id, chunk, channel, sfreq, n_records * 64 AS n_samples, start,
        list_transform(samples, lambda x: (least(greatest(round(x::double * 1000), -32768), 32767) * 0.1)::FLOAT) AS samples
        FROM h_raw s JOIN h_records r ON r.file_id = s.file_id WHERE chunk < n_records),
pts AS (SELECT file_id, channel, sfreq, n_samples, start + pos - 1 AS i, samples[pos]::double AS x
        FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS pos FROM h_signal) s)"""


def psd(n, overlap: float = 0.5, window: str = "hann", tag: str = "") -> str:
    """Windows of ``n`` samples and their spectrum by explicit sums."""
    a, b = (0.5, 0.5) if window == "hann" else (0.54, 0.46)
    return f"""par{tag} AS (SELECT *, n - floor(n * {overlap})::bigint AS hop FROM (
        SELECT DISTINCT file_id, channel, sfreq, n_samples, least({n}, n_samples)::bigint AS n
        FROM h_signal) d),
win{tag} AS (SELECT *, unnest(range(0, ((n_samples - n) // hop + 1)::bigint)) AS k FROM par{tag}),
seg{tag} AS (SELECT w.file_id, w.channel, w.sfreq, w.n, w.k, p.i - w.k * w.hop AS j, p.x
        FROM win{tag} w JOIN pts p ON p.file_id = w.file_id AND p.channel = w.channel
          AND p.i >= w.k * w.hop AND p.i < w.k * w.hop + w.n),
cen{tag} AS (SELECT *, {a} - {b} * cos(2 * pi() * j / n) AS w,
          x - avg(x) OVER (PARTITION BY file_id, channel, k) AS y FROM seg{tag}),
dft{tag} AS (SELECT file_id, channel, sfreq, n, k, bin,
          sum(y * w * cos(2 * pi() * bin * j / n)) AS re,
          sum(y * w * sin(2 * pi() * bin * j / n)) AS im, sum(w * w) AS ww
        FROM (SELECT *, unnest(range(0, (n // 2 + 1)::bigint)) AS bin FROM cen{tag}) c
        GROUP BY ALL),
psd{tag} AS (SELECT file_id, channel, sfreq, n, bin, bin * sfreq / n AS freq,
          avg((re * re + im * im) / (sfreq * ww)
              * CASE WHEN bin = 0 OR bin * 2 = n THEN 1 ELSE 2 END) AS power
        FROM dft{tag} GROUP BY ALL)"""


def allocation(name: str, source: str) -> str:
    """Rounds of whole shares as a recursive query.

    ``source`` holds ``label, key, w, lo, hi, total``; the result ``name`` holds
    ``label, key, given``.
    """
    each = "range(1, len(ks) + 1)"
    return f"""{name}_r AS (
  SELECT label, list(key ORDER BY key) AS ks, list(w::double ORDER BY key) AS ws,
    list(hi::bigint ORDER BY key) AS his, list(lo::bigint ORDER BY key) AS got,
    (any_value(total) - sum(lo))::bigint AS rest FROM {source} GROUP BY label
  UNION ALL
  SELECT label, ks, ws, his, [got[i] + more[i] for i in {each}], rest - list_sum(more)::bigint
  FROM (SELECT *, CASE WHEN list_sum(whole) > 0 THEN whole ELSE
      [CASE WHEN list_contains(lucky, i) THEN 1 ELSE 0 END for i in {each}] END AS more
    FROM (SELECT *, [x.i for x in list_reverse_sort([{{'f': ideal[i] - floor(ideal[i]), 'w': ws[i],
          'k': ks[i], 'i': i}} for i in {each} if ideal[i] IS NOT NULL])[1:rest]] AS lucky
      FROM (SELECT *, [CASE WHEN ideal[i] IS NULL THEN 0
            ELSE least(floor(ideal[i])::bigint, his[i] - got[i]) END for i in {each}] AS whole
        FROM (SELECT *, [CASE WHEN got[i] < his[i] THEN rest * ws[i] / mass END for i in {each}]
              AS ideal
          FROM (SELECT *, list_sum([CASE WHEN got[i] < his[i] THEN ws[i] ELSE 0 END
                for i in {each}]) AS mass FROM {name}_r WHERE rest > 0) a WHERE mass > 0) b) c) d) e),
{name} AS (SELECT label, unnest(ks) AS key, unnest(got) AS given FROM {name}_r WHERE rest = 0)"""


def split_plan(rows: str, percent: dict[str, int]) -> str:
    """Selected and assigned rows of ``rows(label, stratum, stem)``."""
    tg = f"""SELECT label, count(*) * {percent['train']} // 100, count(*) * {percent['evaluation']} // 100
    FROM {rows} GROUP BY label"""
    order = "ORDER BY md5('{}_' || r.label || '_' || r.stratum || '|' || r.stem), r.stem"
    return f"""tgt(label, tr, evl) AS ({tg}),
cnt AS (SELECT label, stratum AS key, count(*) AS n FROM {rows} GROUP BY ALL),
src1 AS (SELECT c.label, c.key, n AS w, CASE WHEN tr + evl >= count(*) OVER (PARTITION BY c.label)
    THEN 1 ELSE 0 END AS lo, n AS hi, tr + evl AS total FROM cnt c JOIN tgt USING (label)),
{allocation('sel', 'src1')},
strict AS (SELECT s.label, s.key, given AS w, CASE WHEN given >= 2 THEN 1 ELSE 0 END AS lo,
    CASE WHEN given >= 2 THEN given - 1 ELSE 0 END AS hi, evl AS total
    FROM sel s JOIN tgt USING (label) WHERE given > 0),
fits AS (SELECT label, sum(lo) <= any_value(total) AND sum(hi) >= any_value(total) AS ok
    FROM strict GROUP BY label),
src2 AS (SELECT s.label, s.key, w, CASE WHEN ok THEN lo ELSE 0 END AS lo,
    CASE WHEN ok THEN hi ELSE w END AS hi, total FROM strict s JOIN fits USING (label)),
{allocation('evs', 'src2')},
chosen AS (SELECT label, stratum, stem FROM (SELECT r.*, s.given, row_number() OVER (
    PARTITION BY r.label, r.stratum {order.format('select')}) AS k FROM {rows} r
    JOIN sel s ON s.label = r.label AND s.key = r.stratum) x WHERE k <= given),
assigned AS (SELECT label, stratum, stem, CASE WHEN k <= given THEN 'evaluation' ELSE 'train' END
    AS split FROM (SELECT r.*, e.given, row_number() OVER (PARTITION BY r.label, r.stratum
    {order.format('eval')}) AS k FROM chosen r
    JOIN evs e ON e.label = r.label AND e.key = r.stratum) x)"""
