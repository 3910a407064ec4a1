"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import identity, stored, text_bytes

#: The directory has at most 2**MAX_DEPTH cells, which bounds what the driver and a broadcast hold.
MAX_DEPTH = 16
#: Distinct hashes that a bucket holds before it is split.
CAPACITY = 4096

_MEMBER = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
                        T.StructField("text_key", T.LongType())])
_LOG = T.StructType([
    T.StructField("entry", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("text", T.BinaryType()),
    T.StructField("n", T.LongType()), T.StructField("best", _MEMBER), T.StructField("members", T.ArrayType(_MEMBER))])
_CLASS = T.StructType([
    T.StructField("entry", T.LongType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_row", T.LongType()),
    T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType())])


def _better(a, b):
    """Whether member ``a`` stays rather than ``b``: larger id (null last), then the row read first."""
    x, y = a["doc_id"], b["doc_id"]
    if x != y:
        return y is None or (x is not None and x > y)
    return a["row"] < b["row"]


def _entries(batches):
    """One entry per distinct normalised text of an Arrow batch, with the rows that have it."""
    import pyarrow as pa
    import xxhash
    from pyspark import TaskContext

    schema = pa.schema([
        ("entry", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("n", pa.int64()),
        ("best", pa.struct([(f, pa.int64()) for f in ("row", "doc_id", "text_key")])),
        ("members", pa.list_(pa.struct([(f, pa.int64()) for f in ("row", "doc_id", "text_key")])))])
    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        found: dict[bytes, list] = {}
        ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, text in enumerate(text_bytes(batch.column(1))):
            found.setdefault(text.lower(), []).append(
                {"row": number + i, "doc_id": ids[i], "text_key": keys[i]})
        rows = []
        for text, members in found.items():
            best = members[0]
            for m in members[1:]:
                best = m if _better(m, best) else best
            rows.append({"entry": members[0]["row"], "hash": xxhash.xxh64_intdigest(text) - (1 << 63), "text": text,
                         "n": len(members), "best": best, "members": members})
        number += batch.num_rows
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def directory(cells: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(local depth, prefix) of every bucket, by doubling.

    ``cells`` counts distinct hashes by their first bits; its length is a power of two. A
    bucket above ``capacity`` is split at its next bit; splitting one whose local depth
    is the global depth doubles the directory. Stops at the depth of ``cells``.
    """
    deepest = int(np.log2(len(cells)))
    done, frontier, depth = [], [0], 0
    while frontier:
        sums = cells.reshape(1 << depth, -1).sum(axis=1)
        full = [p for p in frontier if sums[p] > capacity and depth < deepest]
        done += [(depth, p) for p in frontier if not (sums[p] > capacity and depth < deepest)]
        frontier = [q for p in full for q in (2 * p, 2 * p + 1)]
        depth += 1
    return sorted(done, key=lambda x: x[1] << (deepest - x[0]))


def _prefix(bits: int):
    """The first ``bits`` bits of the stored hash, which is shifted to keep its unsigned order."""
    return F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")


def _owners(batches):
    """Chains of one hash, in a stream sorted by (bucket, hash): bytes decide what is equal."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
                        ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def closed(chain):
        out = []
        for text, entries, n, best in chain:
            sha = hashlib.sha256(text).hexdigest()
            out += [{"entry": e, "keep_id": best["doc_id"], "keep_row": best["row"], "group_size": n,
                     "text_sha256": sha} for e in entries]
        return out

    current, chain, rows = None, [], []
    for batch in batches:
        entries, hashes, ns, best = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        for entry, h, text, n, b in zip(entries, hashes, text_bytes(batch.column(2)), ns, best, strict=True):
            if h != current:
                rows += closed(chain)
                current, chain = h, []
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            for c in chain:
                if c[0] == text:
                    c[1].append(entry)
                    c[2] += n
                    c[3] = b if _better(b, c[3]) else c[3]
                    break
            else:
                chain.append([text, [entry], n, b])
    rows += closed(chain)
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; null counts as empty.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the
    normalised text) and the identity columns of ``common.identity``. Of a group the
    largest id stays, null ids last; of a row repeated whole, the first one read. Other
    columns of the input are not touched.

    The index lies in the shared folder: an entry is a distinct text of one read batch
    with its hash and member rows, so copies are combined before anything is shuffled.
    Distinct hashes per 16-bit prefix (65,536 numbers at most) give the directory by
    doubling. A bucket's entries meet in one owner task, sorted by hash; entries of one
    hash form a chain in which bytes are compared. Owners answer per entry, and entries
    are joined to their own members: no key of that join has more rows than a read batch.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       identity(id_col, text_col)["_text_key"].alias("text_key"))
    index = stored(rows.mapInArrow(_entries, _LOG), "hash-index")
    counted = index.select("hash").distinct().groupBy(_prefix(MAX_DEPTH).alias("cell")).count().toPandas()
    cells = np.zeros(1 << MAX_DEPTH, dtype=np.int64)
    cells[counted["cell"].to_numpy(dtype=np.int64)] = counted["count"].to_numpy(dtype=np.int64)
    buckets = directory(cells, capacity)
    depth = max(d for d, _ in buckets)
    listing = spark.createDataFrame(
        [(c, b) for b, (d, p) in enumerate(buckets) for c in range(p << (depth - d), (p + 1) << (depth - d))],
        "cell long, bucket int")
    dealt = index.select("entry", "hash", "text", "n", "best", _prefix(depth).alias("cell")).join(
        F.broadcast(listing), "cell").select("entry", "hash", "text", "n", "best", "bucket")
    classes = dealt.repartition("bucket").sortWithinPartitions("bucket", "hash").select(
        "entry", "hash", "text", "n", "best").mapInArrow(_owners, _CLASS)
    members = index.select("entry", F.explode("members").alias("m")).select("entry", "m.*")
    return members.join(classes, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null_id"),
        F.col("text_key").alias("_text_key"))
