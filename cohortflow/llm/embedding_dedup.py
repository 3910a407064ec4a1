"""Near duplicates of embeddings: hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import connected_components, stored

#: Vectors that a bucket of a table has on average.
BUCKET_ROWS = 512
#: Vectors that one task compares at once; a larger bucket is compared in pairs of blocks.
BLOCK_ROWS = 2048
#: Highest chance that a link exactly at the threshold is in no table.
MISS = 1e-3

_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def table_plan(n: int, threshold: float, miss: float = MISS, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits, tables): bits so that buckets keep their size as ``n`` grows, tables so that ``miss`` holds."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(max(math.ceil(math.log2(max(n, 1) / bucket_rows)), 2), 31)
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree ** bits)))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(vectors, tables) signs of the hyperplanes, one number a table."""
    signs = (vectors @ _planes(vectors.shape[1], bits, tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _raw(batches):
    """Valid vectors as bytes of doubles; null where a vector is null, empty, zero or not finite throughout."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for v in batch.column(1):
            x = None if not v.is_valid else v.values
            if x is None or not len(x) or x.null_count:
                out.append(None)
                continue
            x = x.to_numpy(zero_copy_only=False)
            wide = x.astype("<f8")
            out.append(wide.tobytes() if np.isfinite(wide).all() and wide.any() and np.isfinite(wide @ wide) and wide @ wide > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def _by_dim(raws: list[bytes]):
    """(positions, unit vectors) for each dimension."""
    sizes = np.fromiter((len(r) for r in raws), np.int64, len(raws))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join(raws[i] for i in at.tolist()), "<f8").reshape(len(at), -1)
        yield at, v / np.linalg.norm(v, axis=1, keepdims=True)


def _light(bits, tables, seed):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, v in _by_dim(batch.column(1).to_pylist()):
                codes = _codes(v, bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                     pa.array(codes.ravel()), pa.array(np.full(codes.size, v.shape[1], np.int32))],
                    names=["cls", "table", "code", "dim"])
    return run


_DEALT = T.StructType([
    T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("low", T.IntegerType()),
    T.StructField("high", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("cls", T.LongType()),
    T.StructField("node", T.LongType()), T.StructField("m", T.LongType()), T.StructField("vec", T.BinaryType())])


def _dealt(bits, tables, seed):
    """Vectors once per table; in a bucket of b blocks once for each pair of blocks with its own."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cls, node, m = (batch.column(i).to_numpy() for i in range(3))
            raws, splits = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for at, v in _by_dim(raws):
                codes = _codes(v, bits, tables, seed)
                cols = [[] for _ in range(5)]
                rows = []
                for i, own in zip(at.tolist(), codes.tolist(), strict=True):
                    parts = {s["table"]: s["parts"] for s in splits[i] or ()}
                    for t, code in enumerate(own):
                        n = parts.get(t, 1)
                        block = int(cls[i]) * 2654435761 % (1 << 32) * n >> 32
                        for other in range(n):
                            for c, x in zip(cols, (t, code, min(block, other), max(block, other), int(block > other))):
                                c.append(x)
                            rows.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:]),
                     pa.array(cls[rows]), pa.array(node[rows]), pa.array(m[rows]), pa.array([raws[i] for i in rows], pa.binary())],
                    names=_DEALT.names)
    return run


def _linked(bits, tables, seed, threshold):
    """Links of each bucket (or pair of blocks): counts per class and a spanning forest."""
    def solve(table, same, side, cls, node, m, raws, out):
        for at, v in _by_dim(raws):
            if same:
                left = right = np.arange(len(at))
            else:
                left, right = np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)
            codes = None
            for a in range(0, len(left), 512):
                rows = left[a:a + 512]
                i, j = np.nonzero(v[rows] @ v[right].T >= threshold)
                i, j = rows[i], right[j]
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                if codes is None:
                    codes = _codes(v, bits, tables, seed)
                # a pair counts in the first table that brings it together
                late = np.zeros(len(i), bool)
                for t in range(table):
                    late |= codes[i, t] == codes[j, t]
                i, j = at[i[~late]], at[j[~late]]
                n = np.bincount(i, m[j], len(cls)) + np.bincount(j, m[i], len(cls))
                hit = np.flatnonzero(n)
                out.append((cls[hit], np.full(len(hit), -1), n[hit].astype(np.int64)))
                parent = np.arange(len(cls))
                while len(i):
                    ri, rj = parent[i], parent[j]
                    apart = ri != rj
                    if not apart.any():
                        break
                    i, j = i[apart], j[apart]
                    np.minimum.at(parent, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
                child = np.flatnonzero(parent != np.arange(len(parent)))
                out.append((node[child], node[parent[child]], np.zeros(len(child), np.int64)))

    def run(batches):
        import pyarrow as pa

        def flush(held, last):
            keys = np.stack([np.concatenate([h[k] for h in held]) for k in range(4)], axis=1)
            side, cls, node, m = (np.concatenate([h[k] for h in held]) for k in range(4, 8))
            raws = [r for h in held for r in h[8]]
            heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            stop = len(keys) if last else heads[-1]
            out = []
            for a, b in zip(heads, np.r_[heads[1:], len(keys)]):
                if b - a > 1 and b <= stop:
                    solve(int(keys[a, 0]), keys[a, 2] == keys[a, 3], side[a:b], cls[a:b], node[a:b], m[a:b], raws[a:b], out)
            rest = [tuple(keys[stop:, k] for k in range(4)) + (side[stop:], cls[stop:], node[stop:], m[stop:], raws[stop:])]
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            return rest, pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "n"])

        held = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(8)) + (batch.column(8).to_pylist(),))
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                held, done = flush(held, False)
                yield done
        if held and len(held[0][0]):
            yield flush(held, True)[1]
    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    seed: int = 11, block_rows: int = BLOCK_ROWS, miss: float = MISS) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of ``threshold`` or more), component_id and kept, per row.

    Cosines are taken in double precision. Null, empty and zero vectors, those with null or
    non-finite components and rows with a null id link with nothing; neither do vectors of
    unlike length. Equal vectors are linked and are one class that is compared once; each
    row of a class counts as a vector, a row repeated whole included.

    A bucket of a table holds the classes with equal signs on its hyperplanes. The bits of a
    table follow from the number of classes, and the tables from the bits so that a link at
    the threshold is missed with chance ``miss`` at most (closer ones far more rarely). Buckets
    above ``block_rows`` are compared in pairs of blocks, each in a task of its own. A task
    gives sums of links per class and a spanning forest, never the pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = stored(rows.mapInArrow(_raw, "vec_id long, vec binary"), "vectors")
    valid = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    classes = stored(valid.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).select(
        F.monotonically_increasing_id().alias("cls"), "node", "m", "vec"), "vector-classes")
    bits, tables = table_plan(classes.count(), threshold, miss)
    light = classes.select("cls", "vec").mapInArrow(_light(bits, tables, seed), "cls long, table int, code long, dim int")
    large = stored(light.groupBy("table", "code", "dim").count().where(F.col("count") > block_rows), "large-buckets")
    dealt = classes.withColumn("splits", F.lit(None).cast("array<struct<table:int,parts:int>>"))
    if not large.isEmpty():
        splits = light.join(large, ["table", "code", "dim"]).groupBy("cls").agg(F.collect_list(F.struct(
            "table", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))).alias("splits"))
        dealt = classes.join(splits, "cls", "left")
    keys = ["table", "code", "low", "high"]
    found = dealt.select("cls", "node", "m", "vec", "splits").mapInArrow(_dealt(bits, tables, seed), _DEALT).repartition(
        *keys).sortWithinPartitions(*keys).mapInArrow(_linked(bits, tables, seed, threshold), _LINK)
    found = stored(found, "vector-links")
    counts = found.where("b = -1 AND n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("n = 0").select("a", "b"))
    known = classes.join(counts, "cls", "left").join(parts.withColumnRenamed("component", "part"), "node", "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("part", "node").alias("component_id"))
    lone = rows.where("vec IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.join(known, "vec").select("vec_id", "n_links", "component_id").unionByName(lone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
