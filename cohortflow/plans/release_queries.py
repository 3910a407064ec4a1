"""Queries of linking, release checks, split design and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as evl, integrity, linkage as ln, split as sp
from ..shared import shared_path
from ..sources import tables
from . import oracle_sql as o
from .pipelines import build_split, derive_manifest
from .registry import query, rounded

COUNTS = {("train", "Normal"): 40, ("evaluation", "Normal"): 12,
          ("train", "Abnormal"): 30, ("evaluation", "Abnormal"): 10}
#: Percents of each class in the split that is designed.
PERCENT = {"train": 55, "evaluation": 20}
FILE_COUNTS = {(s, c, m): 25 for s in ln.SPLITS for c in ln.REQUIRED for m in ln.REQUIRED[c]}


def inventory(h):
    return tables.describe_paths(h.files())


def manifest(h):
    return derive_manifest(h.manifest())


def release(h):
    return ln.release_manifest(manifest(h))


def linked(h):
    return ln.link_files(ln.dedup_first(manifest(h), "stem", "row_no"), inventory(h))


def valid(h):
    return sp.strata(linked(h).where("missing_reason = ''"))


# ---- inventories and manifest rows -------------------------------------


@query("scan_files", f"""WITH {o.FILES} SELECT path, stem, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext,
    modality, split, label FROM inv""")
def _(h):
    return inventory(h).select("path", "stem", "ext", "modality", "split", "label")


_FLAT = "regexp_replace(regexp_replace(path, '/edf/(b[0-9]+/)?', '/'), '/evaluation/', '/eval/')"


@query("scan_recordings", f"""WITH {o.FILES}, p AS (SELECT {_FLAT} AS path FROM inv)
    SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS file_id,
    CASE split_part(path, '/', 3) WHEN 'train' THEN 'train' ELSE 'test' END AS split,
    split_part(path, '/', 4) AS label FROM p WHERE path LIKE '%.edf'""")
def _(h):
    return tables.scan_recordings(h.files().select(F.expr(_FLAT).alias("path"))).select(
        "path", "file_id", "split", "label")


@query("inventory_counts", f"""WITH {o.FILES} SELECT modality, label, count(DISTINCT stem) AS n_stems,
    count(*) AS n_files FROM inv GROUP BY ALL""")
def _(h):
    return ln.inventory_counts(inventory(h))


@query("dedup_first", f"WITH {o.MANIFEST} SELECT stem, row_no, label, split, file_name FROM uniq")
def _(h):
    return ln.dedup_first(manifest(h), "stem", "row_no").select(
        "stem", "row_no", "label", "split", "file_name")


@query("duplicate_rows", f"""WITH {o.MANIFEST} SELECT stem, row_no, label FROM man2
    QUALIFY count(*) OVER (PARTITION BY stem) > 1""")
def _(h):
    return ln.duplicate_rows(manifest(h)).select("stem", "row_no", "label")


@query("dedup_before_filter", f"""WITH {o.MANIFEST} SELECT stem, row_no, split, label FROM uniq
    WHERE split IN ('train', 'evaluation') AND label IN ('Normal', 'Abnormal')""")
def _(h):
    return ln.release_manifest(manifest(h), "before_filter").select(
        "stem", "row_no", "split", "label")


@query("duplicate_files", f"""WITH {o.FILES}, d AS (SELECT *, count(*) OVER w AS duplicate_count,
      min(path) OVER w AS first_path FROM inv WINDOW w AS (PARTITION BY split, label, modality, stem))
    SELECT stem, split, label, modality, path, first_path, duplicate_count FROM d
    WHERE duplicate_count > 1""")
def _(h):
    return ln.duplicate_files(inventory(h)).select(
        "stem", "split", "label", "modality", "path", "first_path", "duplicate_count")


@query("duplicate_pairs", f"""WITH {o.FILES}, d AS (SELECT *, min(path) OVER (PARTITION BY label,
      modality, stem) AS first_path FROM inv)
    SELECT label, modality, stem, first_path, path AS duplicate_path FROM d WHERE path <> first_path""")
def _(h):
    return ln.duplicate_pairs(inventory(h))


# ---- linking ------------------------------------------------------------


@query("link_files", f"""WITH {o.LINKED} SELECT stem, label, edf_path, annotation_csv_path, report_path,
    missing_reason FROM reasoned""")
def _(h):
    return linked(h).select("stem", "label", "edf_path", "annotation_csv_path", "report_path",
                            "missing_reason")


@query("expected_items", f"WITH {o.RELEASE} SELECT file_name, stem, split, label, modality FROM want")
def _(h):
    return ln.expected_items(release(h))


@query("match_release", f"""WITH {o.RELEASE} SELECT w.file_name, w.stem, w.split, w.label, w.modality,
    i.path AS matched_path FROM want w JOIN inv i ON i.stem = w.stem AND i.split = w.split
    AND i.label = w.label AND i.modality = w.modality""")
def _(h):
    return ln.match_release(ln.expected_items(release(h)), inventory(h)).select(
        "file_name", "stem", "split", "label", "modality", "matched_path")


@query("missing_release", f"""WITH {o.RELEASE} SELECT w.file_name, w.stem, w.split, w.label, w.modality,
    f.folder AS expected_folder FROM want w JOIN folders f USING (split, label, modality)
    WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.stem = w.stem AND i.split = w.split
      AND i.label = w.label AND i.modality = w.modality)""")
def _(h):
    return ln.missing_release(ln.expected_items(release(h)), inventory(h)).select(
        "file_name", "stem", "split", "label", "modality", "expected_folder")


@query("extra_release", f"""WITH {o.RELEASE} SELECT i.stem, i.split, i.label, i.modality, i.path, f.folder
    FROM inv i JOIN folders f USING (split, label, modality)
    WHERE NOT EXISTS (SELECT 1 FROM want w WHERE i.stem = w.stem AND i.split = w.split
      AND i.label = w.label AND i.modality = w.modality)""")
def _(h):
    return ln.extra_release(inventory(h), ln.expected_items(release(h))).select(
        "stem", "split", "label", "modality", "path", "folder")


_ITEMS = "SELECT split, label, modality, stem FROM"


@query("stem_intersect", f"WITH {o.RELEASE} {_ITEMS} want INTERSECT {_ITEMS} inv")
def _(h):
    return ln.stem_intersect(ln.expected_items(release(h)), inventory(h))


@query("stem_except", f"WITH {o.RELEASE} {_ITEMS} want EXCEPT {_ITEMS} inv")
def _(h):
    return ln.stem_except(ln.expected_items(release(h)), inventory(h))


_PLAN = f"""{o.RELEASE}, src AS (SELECT w.*, f.folder, CASE WHEN w.modality = 'annotation'
      THEN (SELECT min(path) FROM inv i WHERE i.stem = w.stem AND i.modality = 'annotation')
      ELSE (SELECT min(path) FROM inv i WHERE i.stem = w.stem AND i.modality = w.modality
            AND i.label = w.label) END AS path FROM want w JOIN folders f USING (split, label, modality)),
  plan AS (SELECT file_name, stem, split, label, modality, folder, coalesce(path, '') AS source_path,
      CASE WHEN path IS NULL THEN '' ELSE folder || '/' || regexp_extract(path, '[^/]*$') END
        AS destination_path,
      CASE WHEN path IS NULL THEN 'missing'
           WHEN regexp_extract(path, '[^/]*$') LIKE '%.EDF' THEN 'already_exists'
           ELSE 'copied' END AS status FROM src)"""


def plan(h):
    # recordings with an upper-case suffix count as already in place
    there = inventory(h).where("path LIKE '%.EDF'").select(F.explode(F.array(*[
        F.concat(F.lit(f"{s}/{c}/edf/"), F.regexp_extract("path", "([^/]*)$", 1))
        for s in ln.SPLITS for c in ("normal", "abnormal")])).alias("path"))
    return ln.copy_plan(release(h), inventory(h), there)


@query("copy_plan", f"WITH {_PLAN} SELECT * FROM plan")
def _(h):
    return plan(h)


@query("copy_missing", f"""WITH {_PLAN} SELECT file_name, stem, split, label, modality, folder FROM plan
    WHERE status = 'missing'""")
def _(h):
    return plan(h).where("status = 'missing'").select(
        "file_name", "stem", "split", "label", "modality", "folder")


@query("copy_summary", f"""WITH {_PLAN} SELECT split, label, modality, status, count(*) AS n FROM plan
    GROUP BY ALL""")
def _(h):
    return ln.copy_summary(plan(h))


@query("folder_difference", f"""WITH {o.FILES}, n AS (SELECT split, regexp_extract(path, '[^/]*$') AS name
      FROM inv WHERE modality = 'annotation')
    SELECT DISTINCT name FROM n WHERE split = 'train'
      AND name NOT IN (SELECT name FROM n WHERE split = 'evaluation')""")
def _(h):
    names = inventory(h).where("modality = 'annotation'").select(
        "split", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return ln.folder_difference(names.where("split = 'evaluation'"), names.where("split = 'train'"))


# ---- counts and verdicts -----------------------------------------------


@query("split_summary", f"WITH {o.MANIFEST} SELECT split, label, count(*) AS n FROM rel GROUP BY ALL")
def _(h):
    return ln.split_summary(release(h))


@query("split_coverage", f"""WITH {o.MANIFEST} SELECT label, source, year,
    count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'evaluation') AS evaluation
    FROM rel GROUP BY ALL""")
def _(h):
    return ln.split_coverage(release(h))


_TARGETS = o.values([(s, c, n) for (s, c), n in COUNTS.items()])
_CHECK = f"""tg(split, label, expected_count) AS ({_TARGETS}), rc AS (SELECT tg.split, tg.label,
   tg.expected_count::bigint AS expected_count, count(rel.stem) AS actual_count,
   CASE WHEN count(rel.stem) = tg.expected_count THEN 'OK' ELSE 'CHECK' END AS status
   FROM tg LEFT JOIN rel ON rel.split = tg.split AND rel.label = tg.label
   GROUP BY tg.split, tg.label, tg.expected_count)"""


@query("recording_count_check", f"WITH {o.MANIFEST}, {_CHECK} SELECT * FROM rc")
def _(h):
    return ln.recording_count_check(release(h), COUNTS)


@query("folder_count_check", f"""WITH {o.RELEASE}, here AS (SELECT i.split, i.label, i.modality,
      count(*) AS n FROM inv i JOIN folders f USING (split, label, modality)
      WHERE regexp_replace(path, '/[^/]*$', '') = '/release/' || f.folder GROUP BY ALL)
    SELECT f.split, f.label, f.modality, f.folder, 25::bigint AS expected_count,
    coalesce(n, 0) AS actual_count, CASE WHEN coalesce(n, 0) = 25 THEN 'OK' ELSE 'CHECK' END AS status
    FROM folders f LEFT JOIN here USING (split, label, modality)""")
def _(h):
    return ln.folder_count_check(inventory(h), "/release", FILE_COUNTS)


_SUMMARY = f"""{o.RELEASE}, sums AS (SELECT f.split, f.label, f.modality, f.folder,
   25::bigint AS expected_count,
   (SELECT count(*) FROM inv i WHERE i.split = f.split AND i.label = f.label
      AND i.modality = f.modality) AS actual_file_count,
   (SELECT count(*) FROM (SELECT stem FROM want w WHERE w.split = f.split AND w.label = f.label
      AND w.modality = f.modality INTERSECT SELECT stem FROM inv i WHERE i.split = f.split
      AND i.label = f.label AND i.modality = f.modality) x) AS matched_stems,
   (SELECT count(*) FROM (SELECT stem FROM want w WHERE w.split = f.split AND w.label = f.label
      AND w.modality = f.modality EXCEPT SELECT stem FROM inv i WHERE i.split = f.split
      AND i.label = f.label AND i.modality = f.modality) x) AS missing_stems,
   (SELECT count(*) FROM (SELECT stem FROM inv i WHERE i.split = f.split AND i.label = f.label
      AND i.modality = f.modality EXCEPT SELECT stem FROM want w WHERE w.split = f.split
      AND w.label = f.label AND w.modality = f.modality) x) AS extra_stems FROM folders f),
  rs AS (SELECT *, CASE WHEN actual_file_count = expected_count AND missing_stems = 0
      AND extra_stems = 0 THEN 'OK' ELSE 'CHECK' END AS status FROM sums)"""


@query("release_summary", f"WITH {_SUMMARY} SELECT * FROM rs")
def _(h):
    return ln.release_summary(ln.expected_items(release(h)), inventory(h), FILE_COUNTS)


@query("release_verdict", f"""WITH {_SUMMARY}, {_CHECK}, t AS (SELECT sum(missing_stems)::bigint AS missing,
      sum(extra_stems)::bigint AS extra, bool_and(status = 'OK') AS folders_ok FROM rs),
    d AS (SELECT count(*) AS duplicates FROM (SELECT 1 FROM inv GROUP BY split, label, modality, stem
      HAVING count(*) > 1) x), c AS (SELECT bool_and(status = 'OK') AS counts_ok FROM rc)
    SELECT *, CASE WHEN missing = 0 AND extra = 0 AND duplicates = 0 AND folders_ok AND counts_ok
      THEN 'SUCCESS' ELSE 'CHECK REQUIRED' END AS verdict FROM t, c, d""")
def _(h):
    files, rows = inventory(h), release(h)
    return ln.release_verdict(
        ln.release_summary(ln.expected_items(rows), files, FILE_COUNTS),
        ln.recording_count_check(rows, COUNTS), ln.duplicate_files(files))


@query("integrity_table", f"""WITH {o.EVENTS}, {o.FILES}, 
    r AS (SELECT h.*, h.dur_ms % 300000 <> 0 AS readable, EXISTS (SELECT 1 FROM inv i WHERE i.stem = h.file_id
        AND i.modality = 'report' AND lower(i.label) = h.label
        AND i.split = CASE h.split WHEN 'eval' THEN 'evaluation' ELSE h.split END) AS rep,
      EXISTS (SELECT 1 FROM inv i WHERE i.stem = h.file_id AND i.modality = 'annotation') AS csv,
      len(list_intersect(string_split(channel_text, ' '),
        [{', '.join(o.quoted(c) for c in ln.SCALP_19)}])) = 19 AS full_set
      FROM h_headers h),
    t AS (SELECT count(*) AS a, count(*) FILTER (label = 'abnormal') AS b,
      count(*) FILTER (readable) AS c1, count(*) FILTER (readable AND full_set) AS c2,
      count(*) FILTER (readable AND sfreq = 200) AS c3,
      count(*) FILTER (readable AND dur_ms > 0) AS c4, count(*) FILTER (rep) AS c5,
      count(*) FILTER (label = 'abnormal' AND csv) AS c6 FROM r),
    x("check", n, total) AS (SELECT 'readable', c1, a FROM t UNION ALL SELECT 'channel_set', c2, a FROM t
      UNION ALL SELECT 'sampling_rate', c3, a FROM t UNION ALL SELECT 'has_samples', c4, a FROM t
      UNION ALL SELECT 'report', c5, a FROM t UNION ALL SELECT 'annotation', c6, b FROM t)
    SELECT "check", n, total, round(100 * n / total, 6) AS pct FROM x""")
def _(h):
    heads = h.headers().withColumn("readable", F.col("dur_ms") % 300000 != 0).withColumn(
        "n_samples", F.col("dur_ms"))
    return rounded(ln.integrity_table(heads, inventory(h)), "pct")


# ---- split design -------------------------------------------------------


@query("strata", f"""WITH {o.LINKED} SELECT label, stratum, count(*) AS n FROM valid GROUP BY ALL""")
def _(h):
    return sp.stratum_counts(valid(h))


_TAKE = "SELECT stratum, label, least(n, 3) AS take FROM (SELECT stratum, label, count(*) AS n FROM {} GROUP BY ALL) c"


@query("stratum_rank_sample", f"""WITH {o.LINKED}, tk AS ({_TAKE.format('valid')}),
    r AS (SELECT v.stem, v.label, v.stratum, row_number() OVER (PARTITION BY v.label, v.stratum
      ORDER BY md5('select_' || v.label || '_' || v.stratum || '|' || v.stem), v.stem) AS k FROM valid v)
    SELECT r.stem, r.label, r.stratum FROM r JOIN tk USING (label, stratum) WHERE k <= take""")
def _(h):
    rows = valid(h)
    take = sp.stratum_counts(rows).withColumn("take", F.least("n", F.lit(3)))
    return sp.stratum_rank_sample(rows, take, "take").select("stem", "label", "stratum")


def _all_rows(h):
    return sp.strata(ln.dedup_first(ln.valid_manifest_rows(manifest(h)), "stem", "row_no"))


def _plan(h):
    rows = _all_rows(h)
    return rows, sp.plan_split(sp.stratum_counts(rows), _shares(rows))


def _shares(rows):
    return sp.share_targets(sp.stratum_counts(rows), PERCENT)


_ROWS = f"""{o.MANIFEST}, rws AS (SELECT *, label || '_' || source || '_' || year AS stratum FROM rel)"""
_HALF = """src AS (SELECT label, stratum AS key, count(*) AS w, 1 AS lo, count(*) AS hi,
    sum(count(*)) OVER (PARTITION BY label) // 2 AS total FROM rws GROUP BY label, stratum)"""


@query("bounded_allocate", f"""WITH RECURSIVE {_ROWS}, {_HALF}, {o.allocation('al', 'src')}
    SELECT label, key, given AS allocated FROM al""")
def _(h):
    """Half of every class, at least one recording per stratum."""
    counts = sp.stratum_counts(_all_rows(h))
    per_class = counts.groupBy("label").agg(F.floor(F.sum("n") / 2).alias("total"))
    groups = counts.join(per_class, "label").select(
        "label", F.col("stratum").alias("key"), F.col("n").alias("weight"),
        F.lit(1).cast("bigint").alias("lower"), F.col("n").alias("upper"), "total")
    return sp.bounded_allocate(groups)


@query("select_records", f"""WITH RECURSIVE {_ROWS}, {o.split_plan('rws', PERCENT)}
    SELECT stem, label, stratum FROM chosen""")
def _(h):
    rows, plan = _plan(h)
    return sp.select_records(rows, plan).select("stem", "label", "stratum")


@query("assign_split", f"""WITH RECURSIVE {_ROWS}, {o.split_plan('rws', PERCENT)}
    SELECT stem, label, stratum, split FROM assigned""")
def _(h):
    rows, plan = _plan(h)
    return sp.assign_split(sp.select_records(rows, plan), plan).select(
        "stem", "label", "stratum", "split")


@query("split_targets", f"""WITH RECURSIVE {_ROWS}, {o.split_plan('rws', PERCENT)},
    tg(split, label, target) AS (SELECT 'train', label, tr FROM tgt UNION ALL SELECT 'evaluation', label, evl FROM tgt)
    SELECT tg.split, tg.label, tg.target::bigint AS target,
    count(a.stem) AS n FROM tg LEFT JOIN assigned a ON a.split = tg.split AND a.label = tg.label GROUP BY ALL""")
def _(h):
    rows, plan = _plan(h)
    return sp.check_targets(sp.assign_split(sp.select_records(rows, plan), plan), _shares(rows))


@query("unused_records", f"""WITH {o.LINKED}, r AS (SELECT *, row_number() OVER (PARTITION BY label,
      stratum ORDER BY md5('select_' || label || '_' || stratum || '|' || stem), stem) AS k FROM valid)
    SELECT stem, label, stratum FROM r WHERE k > 3""")
def _(h):
    rows = valid(h)
    take = sp.stratum_counts(rows).withColumn("take", F.least("n", F.lit(3)))
    chosen = sp.stratum_rank_sample(rows, take, "take")
    return ln.unused_records(rows, chosen).select("stem", "label", "stratum")


@query("sort_manifest", f"""WITH {o.MANIFEST} SELECT split, label, source, year, file_name FROM rel
    ORDER BY ALL""")
def _(h):
    return sp.sort_manifest(release(h)).select("split", "label", "source", "year", "file_name")


@query("random_split_70_30", """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY
      md5('42|' || cast(vec_id AS varchar)), vec_id) AS k, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id, CASE WHEN k <= ceil(0.3::double * n) THEN 'test' ELSE 'train' END AS part FROM r""")
def _(h):
    return sp.random_split(h.table("embeddings").select("vec_id"), "vec_id")


# ---- evaluation ---------------------------------------------------------

_CELLS = f"""{o.SCORES}, c AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn,
   count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn,
   count(*) FILTER (y = 1 AND pred = 1) AS tp FROM h_scores)"""


@query("confusion_matrix", f"""WITH {_CELLS} SELECT 0::bigint AS y, tn AS pred_0, fp AS pred_1 FROM c
    UNION ALL SELECT 1, fn, tp FROM c""")
def _(h):
    return evl.confusion_matrix(h.scores())


@query("classification_report", f"""WITH {_CELLS}, m AS (
      SELECT 'Normal' AS "row", tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM c
      UNION ALL SELECT 'Abnormal', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
    f AS (SELECT *, 2 * p * r / (p + r) AS f FROM m), a AS (SELECT *, tn + fp + fn + tp AS t FROM c),
    u AS (SELECT "row", p, r, f, s FROM f
      UNION ALL SELECT 'accuracy', (tn + tp) / t, (tn + tp) / t, (tn + tp) / t, t FROM a
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s)::bigint FROM f
      UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s),
        sum(s)::bigint FROM f)
    SELECT "row", round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support
    FROM u""")
def _(h):
    return rounded(evl.classification_report(h.scores()), "precision", "recall", "f1")


@query("accuracy_by_input_length", f"""WITH {o.SCORES} SELECT input_len,
    round(avg(CASE WHEN y = pred THEN 1.0::double ELSE 0 END), 6) AS accuracy,
    round(2 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)), 6)
      AS f1 FROM h_scores GROUP BY input_len""")
def _(h):
    return rounded(evl.accuracy_by_input_length(h.scores()), "accuracy", "f1")


_ROC = f"""{o.SCORES}, g AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
     FROM h_scores GROUP BY score),
   cum AS (SELECT *, (sum(pos) OVER (ORDER BY score DESC))::bigint AS tp,
     (sum(neg) OVER (ORDER BY score DESC))::bigint AS fp FROM g),
   tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g)"""


@query("score_cumulation", f"WITH {_ROC} SELECT score, pos, neg, tp, fp FROM cum")
def _(h):
    return evl.score_cumulation(h.scores())


@query("roc_curve", f"WITH {_ROC} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cum, tot")
def _(h):
    return rounded(evl.roc_curve(h.scores()), "fpr", "tpr")


@query("roc_auc", f"""WITH {_ROC}, pt AS (SELECT fp / n AS x, tp / p AS y FROM cum, tot
      UNION ALL SELECT 0, 0), st AS (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pt
      WINDOW w AS (ORDER BY x, y))
    SELECT round(sum((x - px) * (y + py) / 2), 6) AS auc FROM st""")
def _(h):
    return rounded(evl.roc_auc(h.scores()), "auc")


# ---- checksums ----------------------------------------------------------

_DOCS = """SELECT concat('release/', source, '/', CASE WHEN doc_id % 10 = 3 THEN 'missing_' ELSE '' END,
   cast(doc_id AS string), '.txt') AS path, text, doc_id FROM {documents}"""


def _contents(h):
    return h.spark.sql(_DOCS, documents=h.table("documents")).withColumn(
        "content", F.encode("text", "UTF-8"))


@query("sha256_manifest", f"""WITH d AS ({o.host(_DOCS)}) SELECT sha256(text) AS digest, path FROM d
    WHERE doc_id % 10 <> 3""")
def _(h):
    return integrity.checksum_folder(h.spark, _folder(h, _contents(h)))


def _folder(h, files):
    """Files that tasks write below a new shared folder."""
    root = shared_path(h.spark, "files")
    tables.write_files(files, root)
    return root


@query("sort_paths", f"""WITH d AS ({o.host(_DOCS)}) SELECT path FROM d WHERE doc_id % 10 <> 3
    ORDER BY path""")
def _(h):
    return integrity.release_file_filter(_contents(h)).select("path").orderBy("path")


@query("verify_checksums", f"""WITH d AS ({o.host(_DOCS)}) SELECT path, sha256(text) AS digest,
    CASE WHEN doc_id % 11 = 2 THEN 'MISSING' WHEN doc_id % 7 = 1 THEN 'MISMATCH' ELSE 'OK' END AS status
    FROM d WHERE doc_id % 10 <> 3""")
def _(h):
    docs = _contents(h)
    changed = docs.withColumn("path", F.when(
        F.col("doc_id") % 11 == 2, F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))).withColumn("content", F.when(
        F.col("doc_id") % 7 == 1, F.concat("content", F.encode(F.lit("!"), "UTF-8"))
    ).otherwise(F.col("content")))
    return integrity.verify_folder(h.spark, _folder(h, changed), integrity.sha256_manifest(docs))
