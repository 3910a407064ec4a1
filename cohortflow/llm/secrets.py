"""Secrets in texts, told apart by who owns them in the whole corpus; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: The base kinds, their patterns, the group that is measured and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Mixed-case strings with digits of at least this length are candidates for kind "live".
LIVE_LENGTH = 24
LIVE_PATTERN = r"[A-Za-z0-9_-]+"
#: A value seen with this many owners is a copied example.
EXAMPLE_OWNERS = 3


def matches(text: Column, kind: str, pattern: str, group: int, least: int, hint: str | None = None) -> Column:
    """Array of (start, end, kind_no, kind, value): leftmost non-overlapping matches that are long enough.

    Spark's functions return no positions; they follow from the lengths of what lies
    between the matches, in code points. ``hint`` is a cheap test that every counted match
    passes: texts without one are not cut up.
    """
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(F.length(x["hit"] if not group else F.regexp_extract(x["hit"], pattern, group)) >= least,
                   F.concat(acc["out"], F.array(F.struct(
                       (acc["at"] + x["gap"]).alias("start"),
                       (acc["at"] + x["gap"] + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"),
                       (x["hit"] if not group else F.regexp_extract(x["hit"], pattern, group)).alias("value")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(hint or pattern), placed).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sorted(spans: Column, kinds: list[str]) -> Column:
    """By start, then kind as listed, then end."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("no"), s["end"].alias("end"),
        s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str | None = None, example_owners: int = EXAMPLE_OWNERS,
                 live_length: int = LIVE_LENGTH) -> DataFrame:
    """One row per input row: doc_id, ``spans`` (start, end, kind, value, owners, repositories, verdict) and base spans.

    Base kinds are always kept. The method adds ``live`` spans: strings of ``live_length``
    or more characters with letters of both cases and digits, outside base spans, whose
    value belongs to fewer than ``example_owners`` owners in the whole corpus. The verdict
    of every span is ``example`` where its value is that widely copied, else ``live``. An
    owner is ``owner_col``, a repository ``repository_col`` (the row's id where not given);
    null ones count as one of their own. Null texts count as empty; a repeated row is
    reported each time.

    Texts are read once; candidates go to a table in the shared folder with a row number.
    Their values are counted by (value, owner, repository), then by (value, owner), then by
    value: each step is combined before its shuffle, so a value that everybody has copied is
    a few rows a task. The counts are joined back to candidates, a join that can be split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repository = F.col(repository_col or id_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.col(owner_col).cast("string").alias("owner"), repository.alias("repository"))
    kinds = [k for k, *_ in BASE] + ["live"]
    hints = {"assign": r"(?i)(password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
    base = F.concat(*(matches(F.col("text"), k, p, g, n, hints[k]) for k, p, g, n in BASE))
    more = F.filter(
        matches(F.col("text"), "live", LIVE_PATTERN, 0, live_length, rf"[A-Za-z0-9_-]{{{live_length}}}"),
        lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    scanned = rows.select("doc_id", "owner", "repository", _sorted(base, kinds).alias("base"), more.alias("more"))
    scanned = stored(scanned.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "base", "more"), "candidates")
    outside = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))
    spans = scanned.select("row", "owner", "repository", F.explode(F.concat(plain, outside)).alias("s")).select(
        "row", "owner", "repository", "s.*").withColumn("hash", F.sha2("value", 256))
    counts = spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(
        F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    judged = spans.join(counts, "hash").withColumn(
        "verdict", F.when(F.col("owners") >= example_owners, "example").otherwise("live")).where(
        "kind <> 'live' OR verdict = 'live'")
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", order[F.col("kind")].alias("no"), "end", "kind", "value", "owners", "repositories", "verdict"))).alias("spans"))
    return scanned.select("row", "doc_id", "base").join(per_row, "row", "left").select("doc_id", "base", F.coalesce(
        "spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``: positions are code points, ends exclusive."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k, *_ in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), verdict("live").alias("n_live"), verdict("example").alias("n_example"))
