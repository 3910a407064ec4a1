"""Helpers shared by the operators on training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortflow.shared import stored

#: Rows of text that a kernel looks at together are cut at about this many bytes.
BLOCK_BYTES = 1 << 20


#: Rows that go to Python at once where rows are whole texts.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Let Arrow batches hold BATCH_ROWS rows: kernels cut texts into blocks anyway, and both sides of a task hold a batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_key(text: Column) -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def identity(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Never-null columns that tell rows of one id apart by their text.

    Rows that agree in id and text are the same row repeated.
    """
    return {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
            "_null_id": F.col(id_col).isNull(), "_text_key": text_key(F.col(text_col))}


def pick(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose identity is in ``keys``, once each, with the columns of ``docs``.

    The join and the removal of repeated rows share one exchange of ``docs``.
    """
    own = list(identity())
    named = docs.withColumns(identity(id_col, text_col))
    return named.join(keys.select(*own).distinct(), own, "left_semi").dropDuplicates(own).select(*docs.columns)


def queue_offsets(df: DataFrame, queue: list[str], bucket: str, order: list[str], amount: str,
                  out: str = "start") -> DataFrame:
    """Running sum of ``amount`` before each row of its queue, in (bucket, order).

    Queues may hold any share of the rows: windows run inside (queue, bucket) only, and the
    bases of the buckets come from their totals, which are combined before the shuffle.
    """
    totals = df.groupBy(*queue, bucket).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*queue).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*queue, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*queue, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(bases, [*queue, bucket]).withColumn(
        out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_base")


def nested_offsets(df: DataFrame, queue: list[str], bucket: str, fine: list[str], order: list[str], amount: str,
                   out: str = "start") -> DataFrame:
    """Like ``queue_offsets`` in (bucket, fine, order), for buckets that may hold any share of the rows too.

    Windows over rows run inside (queue, bucket, fine) only; those over a bucket see one
    total per value of ``fine``, and those over a queue one per bucket. The columns of
    ``fine`` must not be null.
    """
    small = df.groupBy(*queue, bucket, *fine).agg(F.sum(amount).alias("_sum"))
    first = Window.unboundedPreceding
    totals = small.groupBy(*queue, bucket).agg(F.sum("_sum").alias("_sum"))
    bases = totals.select(*queue, bucket, F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*queue).orderBy(bucket).rowsBetween(first, -1)), F.lit(0)).alias("_base"))
    along = Window.partitionBy(*queue, bucket).orderBy(*fine).rowsBetween(first, -1)
    small = small.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))).join(bases, [*queue, bucket]).select(
        *queue, bucket, *fine, (F.col("_base") + F.col("_before")).alias("_base"))
    inside = Window.partitionBy(*queue, bucket, *fine).orderBy(*order).rowsBetween(first, -1)
    return df.join(small, [*queue, bucket, *fine]).withColumn(
        out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_base")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Alternates large-star and small-star contractions until the edges no longer change.
    Every step is a combined minimum per node and a join, so a node of any degree is
    pre-aggregated before the shuffle and its join can be split; nothing is collected but
    one count and one checksum a round. Each round is a table in the shared folder.
    """
    def pairs(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df):
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]

    now = stored(pairs(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(pairs(small.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def text_bytes(column):
    """Values of an Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        import numpy as np

        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int):
        import numpy as np

        while len(self.up) < n:
            with np.errstate(over="ignore"):
                size = len(self.up)
                self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))))
                self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))))
        return self


def mix(x):
    """Finalizer of a 64-bit hash (an array of numpy.uint64)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(texts, limit: int = BLOCK_BYTES):
    """Slices of a list of byte strings with about ``limit`` bytes each; a longer text is one slice."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
