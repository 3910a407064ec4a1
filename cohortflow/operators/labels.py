"""Free-text comments to labels, coarse classes and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import taxonomy
from ..functions.text import strip


def comment_key(col: Column, rule: str = "audit", null_text: str = "nan") -> Column:
    """Lookup key of a comment.

    ``full``      quotes stripped at the ends, blanks collapsed, lower case
    ``audit``     everything but ``[a-z0-9&. ]`` becomes a blank
    ``clinical``  other punctuation is deleted instead, so words may join
    """
    text = F.coalesce(col, F.lit("" if rule == "full" else null_text))
    if rule == "full":
        bare = F.trim(F.trim(strip(text), F.lit('"')), F.lit("'"))
        return F.lower(F.regexp_replace(bare, r"\s+", " "))
    key = F.lower(text)
    if rule == "clinical":
        # quotes, back-slashes, underscores and slashes part words, the rest joins them
        key = F.regexp_replace(F.translate(key, "\\'\"_/", "     "), r"[^a-z0-9 ]+", "")
        return F.trim(F.regexp_replace(key, " +", " "))
    if rule == "audit":
        return F.trim(F.regexp_replace(key, r"[^a-z0-9&.]+", " "))
    raise ValueError(f"unknown comment rule: {rule}")


def inline_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows as a local relation whose size the optimizer knows."""
    def literal(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if v is None else str(v)
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    table = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return table.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])


def label_lookup(spark: SparkSession, vocabulary: str = "audit",
                 table: DataFrame | None = None) -> DataFrame:
    """``(key, label)`` rows of a vocabulary.

    ``audit``, ``clinical`` and ``identity`` are shipped. ``full`` takes
    ``table(variant, canonical)``; its variants go through the full text rule.
    A variant under two labels takes the first of them by name.
    """
    if table is not None:
        rule = "audit" if vocabulary == "identity" else vocabulary
        keyed = table.select(
            comment_key(F.col("variant"), rule).alias("key"),
            F.col("canonical").alias("label"))
        # map-side combined, so repeated variants cost nothing
        return keyed.where("key <> ''").groupBy("key").agg(F.min("label").alias("label"))
    shipped = {"audit": taxonomy.AUDIT, "clinical": taxonomy.CLINICAL,
               "identity": taxonomy.IDENTITY}
    if vocabulary not in shipped:
        raise ValueError(f"vocabulary {vocabulary!r} needs a table")
    rows = [(k, label) for label, keys in shipped[vocabulary].items() for k in keys]
    return inline_table(spark, rows, "key string, label string")


def map_label(df: DataFrame, comment: str = "comment", vocabulary: str = "audit",
              lookup: DataFrame | None = None, default: str = "Unknown",
              out: str = "label") -> DataFrame:
    """Canonical label of every comment.

    The shipped tables hold under 200 rows and are broadcast; a table given by
    the caller has no known size, so the choice is left to the optimizer.
    """
    rule = "audit" if vocabulary == "identity" else vocabulary
    if lookup is None:
        lookup = F.broadcast(label_lookup(df.sparkSession, vocabulary))
    lookup = lookup.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
    return (
        df.withColumn("_key", comment_key(F.col(comment), rule))
        .join(lookup, "_key", "left")
        .withColumn(out, F.coalesce("_label", F.lit(default)))
        .drop("_key", "_label")
    )


def clinical_label(df: DataFrame, comment: str = "comment", out: str = "label") -> DataFrame:
    """Clinical label: exact vocabulary, then ordered keyword rules, then Normal."""
    lookup = label_lookup(df.sparkSession, "clinical").select(
        F.col("key").alias("_key"), F.col("label").alias("_label"))
    key = F.col("_key")
    rule = F.lit("Normal")
    for words, label in reversed(taxonomy.CLINICAL_RULES):
        holds = key.contains(words[0])
        for word in words[1:]:
            holds = holds & key.contains(word)
        rule = F.when(holds, label).otherwise(rule)
    return (
        df.withColumn("_key", comment_key(F.col(comment), "clinical"))
        .join(F.broadcast(lookup), "_key", "left")
        .withColumn(out, F.coalesce("_label", rule))
        .drop("_key", "_label")
    )


def _recode(col: Column, table: dict[str, str], default: Column) -> Column:
    expr = None
    for target in dict.fromkeys(table.values()):
        names = [k for k, v in table.items() if v == target]
        expr = (F if expr is None else expr).when(col.isin(names), target)
    return expr.otherwise(default)


def merge_label(col: Column) -> Column:
    """Coarse class of a canonical label; labels outside the merge keep their name."""
    return _recode(col, taxonomy.COARSE, col)


def label_family(col: Column) -> Column:
    return _recode(strip(col), taxonomy.FAMILY, F.lit("Other"))


def label_dim(spark: SparkSession, order) -> DataFrame:
    """``(label, ord)`` rows of a label order."""
    return inline_table(spark, [(n, i) for i, n in enumerate(order)],
                        "label string, ord int")
