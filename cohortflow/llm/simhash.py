"""Near duplicates by SimHash fingerprints and a hierarchical index in Gray order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import connected_components, identity, stored, text_bytes

#: Rows of one key that one task compares; larger keys are split by further bits.
KEY_ROWS = 8192
#: Children of a node of the index.
FANOUT = 16

_FINGERPRINT = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_null_id", T.BooleanType()),
    T.StructField("_text_key", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("fingerprint", T.LongType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words.

    Words are runs between ASCII white space, letters A-Z lower-cased. A text with fewer
    words than ``width`` is one shingle. The shingles of a long text are hashed in blocks.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1:] - 1).tolist()
    digest, n, votes = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[i:i + 65536], stops[i:i + 65536])),
                             np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(width: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.fromiter((fingerprint(t, width, seed) for t in text_bytes(batch.column(4))),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(prints.view(np.int64))],
                names=["_id", "_null_id", "_text_key", "doc_id", "fingerprint"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                 seed: int = 42) -> DataFrame:
    """doc_id, the identity columns and the 64-bit ``fingerprint`` of every row."""
    named = docs.select(*(c.alias(n) for n, c in identity(id_col, text_col).items()),
                        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_fingerprints(width, seed), _FINGERPRINT)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] values each, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def index_levels(codes: np.ndarray, keys: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the index over ``codes``, which are sorted by (key, Gray rank), leaves first.

    A node covers up to FANOUT neighbours of one key. ``mask`` has the bits on which all
    codes below agree and ``shared`` their values; the last level has one node per key.
    """
    levels = [{"mask": np.full(len(codes), ~np.uint64(0)), "shared": codes, "key": keys,
               "first": np.arange(len(codes)), "count": np.ones(len(codes), np.int64)}]
    while True:
        low = levels[-1]
        heads = np.flatnonzero(np.r_[True, low["key"][1:] != low["key"][:-1]])
        if len(heads) == len(low["key"]):
            return levels
        at = np.arange(len(low["key"])) - np.repeat(heads, np.diff(np.r_[heads, len(low["key"])]))
        first = np.flatnonzero(at % FANOUT == 0)
        same_one = np.bitwise_and.reduceat(low["shared"] & low["mask"], first)
        same_zero = np.bitwise_and.reduceat(~low["shared"] & low["mask"], first)
        levels.append({"mask": same_one | same_zero, "shared": same_one, "key": low["key"][first], "first": first,
                       "count": np.diff(np.r_[first, len(low["key"])])})


def close_pairs(codes: np.ndarray, keys: np.ndarray, distance: int, block: int = 1 << 18):
    """Yields (i, j) arrays of all positions i < j of one key within ``distance`` bits.

    Descends from pairs of top nodes. A pair of groups carries the differences found so
    far; each level adds those on bits that became shared by both, and a pair above
    ``distance`` is dropped with everything below it. Works depth first in bounded blocks.
    """
    levels = index_levels(codes, keys)
    top = np.arange(len(levels[-1]["key"]))
    todo = [(len(levels) - 1, top[i:i + block], top[i:i + block], None, None) for i in range(0, len(top), block)]
    while todo:
        depth, a, b, seen, found = todo.pop()
        node = levels[depth]
        both = node["mask"][a] & node["mask"][b]
        fresh = both if seen is None else both & ~seen
        found = (0 if found is None else found) + np.bitwise_count((node["shared"][a] ^ node["shared"][b]) & fresh)
        near = np.flatnonzero(found <= distance)
        a, b, both, found = a[near], b[near], both[near], found[near]
        if depth == 0:
            keep = a < b
            if keep.any():
                yield a[keep], b[keep]
            continue
        per = node["count"][a] * node["count"][b]
        cuts = np.searchsorted(np.cumsum(per), np.arange(block, per.sum() + block, block)) if len(per) else []
        begin = 0
        for end in np.unique(np.minimum(np.r_[np.asarray(cuts, np.int64) + 1, len(per)], len(per))):
            if end <= begin:
                continue
            s = slice(begin, end)
            begin = end
            na, nb = node["count"][a[s]], node["count"][b[s]]
            left = np.repeat(_ranges(node["first"][a[s]], na), np.repeat(nb, na))
            right = _ranges(np.repeat(node["first"][b[s]], na), np.repeat(nb, na))
            carry = np.repeat(np.arange(begin - len(na), begin), na * nb)
            once = left <= right
            todo.append((depth - 1, left[once], right[once], both[carry[once]], found[carry[once]]))


def _forest(distance: int):
    """Edges that join the same fingerprints as all close pairs of a stream sorted by key."""
    def solve(keys, ranks, nodes):
        import pyarrow as pa

        codes = ranks ^ (ranks >> np.uint64(1))
        parent = np.arange(len(codes))
        for i, j in close_pairs(codes, keys, distance):
            while True:  # hook the larger root below the smaller, then shorten the paths
                ri, rj = parent[i], parent[j]
                open_ = ri != rj
                if not open_.any():
                    break
                i, j = i[open_], j[open_]
                np.minimum.at(parent, np.maximum(ri, rj)[open_], np.minimum(ri, rj)[open_])
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[parent[child]])], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            if sum(len(h[0]) for h in held) < 4 * KEY_ROWS:
                continue
            keys, ranks, nodes = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            held = [(keys[cut:], ranks[cut:], nodes[cut:])]
            if cut:
                yield solve(keys[:cut], (ranks[:cut] ^ np.int64(-(1 << 63))).view(np.uint64), nodes[:cut])
        if held:
            keys, ranks, nodes = (np.concatenate(x) for x in zip(*held))
            yield solve(keys, (ranks ^ np.int64(-(1 << 63))).view(np.uint64), nodes)
    return run


def _keyed(distance: int, bits: int, offset: int, level: int):
    """Rows once for each of distance + 1 bit ranges: two codes within ``distance`` agree on one."""
    edges = [offset + bits * k // (distance + 1) for k in range(distance + 2)]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rank", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("left", T.IntegerType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ranks = (batch.column(1).to_numpy() ^ np.int64(-(1 << 63))).view(np.uint64)
            codes = ranks ^ (ranks >> np.uint64(1))
            before = batch.column(0).to_numpy()
            for k in range(distance + 1):
                lo, width = edges[k], edges[k + 1] - edges[k]
                # the range goes to the front, so that its codes are neighbours in Gray order
                turn = np.uint64(lo)
                turned = (codes << turn) | (codes >> (np.uint64(64) - turn)) if lo else codes
                own = (turned >> np.uint64(64 - width)).astype(np.int64) << 8 | k << 2 | level
                if level:
                    own = np.fromiter((xxhash.xxh64_intdigest(x) >> 1 for x in np.stack([before, own], 1)), np.int64,
                                      len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(gray_rank(turned).view(np.int64) ^ np.int64(-(1 << 63))),
                     batch.column(2), pa.array(np.full(len(own), 64 - width, np.int32))],
                    names=["key", "rank", "node", "left"])
    return run, schema


def near_groups(prints: DataFrame, distance: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """(fingerprint, component) of all distinct fingerprints linked to another one.

    ``prints`` has doc_id and fingerprint; a component is the smallest doc_id reachable
    over links of at most ``distance`` differing bits.
    """
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "fingerprints")
    start = nodes.select(F.lit(0).cast("long").alias("key"), F.col("fingerprint").alias("rank"), "node")
    run, schema = _keyed(distance, 64, 0, 0)
    dealt = start.mapInArrow(_to_rank, "key long, rank long, node long").mapInArrow(run, schema)
    edges = None
    for level in (1, 2):
        dealt = stored(dealt, "index-keys")
        large = dealt.groupBy("key").count().where(F.col("count") > key_rows).select("key")
        again = level == 1 and not large.isEmpty()
        here = dealt.join(large, "key", "left_anti") if again else dealt
        found = here.repartition("key").sortWithinPartitions("key", "rank").select("key", "rank", "node").mapInArrow(
            _forest(distance), _EDGE)
        edges = found if edges is None else edges.unionByName(found)
        if not again:
            break
        # codes of a key agree on its range, which now leads: split the bits behind it once more
        used = 64 // (distance + 1)
        run, schema = _keyed(distance, 64 - used, used, level)
        dealt = dealt.join(large, "key", "left_semi").select("key", "rank", "node").mapInArrow(run, schema)
    parts = connected_components(edges)
    return nodes.join(parts, "node").select("fingerprint", "component")


def _to_rank(batches):
    import pyarrow as pa

    for batch in batches:
        codes = batch.column(1).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(gray_rank(codes).view(np.int64) ^ np.int64(-(1 << 63))), batch.column(2)],
            names=["key", "rank", "node"])


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                  distance: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """Groups of rows whose fingerprints are linked at ``distance`` or fewer differing bits.

    Returns one row per input row: doc_id, fingerprint (16 hexadecimal digits),
    component_id (smallest doc_id reachable, itself included) and the identity columns of
    ``common.identity``. Null texts count as empty and have fingerprint zero like all texts
    without words; rows with a null id are fingerprinted but link nothing and have a null
    component.

    Rows of one fingerprint are one node. Codes within ``distance`` bits agree on one of
    ``distance + 1`` ranges; each node goes to the keys of its ranges, four short rows. In
    a task the codes of a key are sorted by Gray rank of the code turned so that the range
    leads, and the hierarchical index finds its close pairs, of which a spanning forest is
    kept. Keys of more than ``key_rows`` codes are split on the bits behind their range,
    by the same rule.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    known = prints.where("NOT _null_id")
    groups = near_groups(known, distance, key_rows)
    first = known.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    owner = first.join(groups, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(owner, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(~F.col("_null_id"), F.col("component_id")).alias("component_id"), "_id", "_null_id", "_text_key")
