"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Powers, blocks, identity, mix, stored, text_bytes

#: Bytes of the seeds by which equal passages find each other.
SEED = 32
#: Window starts of one document that are looked at together.
STRETCH = 1 << 20
#: Segments of one seed that a task takes up at once; more are counted by Spark and told apart by longer seeds.
SEED_ROWS = 4096
#: Bytes of segments that go into one transform, about.
TRANSFORM_BYTES = 1 << 20
#: Window starts whose common bytes form a longer seed.
CORE_STARTS = 24
#: Bands that the offsets of a seed are cut into; each has a hash of 16 bits of the bytes that its windows share.
BANDS = 4

_POS = np.uint64((1 << 24) - 1)
_POWERS = Powers(0xD6E8FEB86659FD93)


# -- seeds -------------------------------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def band_starts(length: int) -> int:
    """Window starts of a band: offsets of a seed are below ``length - SEED + 1``."""
    return -(-(length - SEED + 1) // BANDS)


def seeds(texts: list[bytes], length: int):
    """(text number, first start, starts, seed hash, segment hash, seed offset, band hashes) arrays.

    Every window of ``length`` bytes has one seed: its SEED bytes of least hash, the first of
    equals. Equal windows have equal seeds at equal offsets. Neighbouring windows of one
    seed are a segment: ``starts`` windows, ``starts + length - 1`` bytes. The windows of a
    band, ``band_starts`` neighbouring offsets of the seed, share the bytes from the last
    start to the first end; equal windows are in bands of one number and so of one hash
    (never zero; zero where a segment has no window in the band).
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    powers = _POWERS.grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[:len(raw)], out=sums[1:])
        gram = mix((sums[SEED:] - sums[:-SEED]) * powers.down[:len(raw) - SEED + 1])
    key = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    best = (_sliding_min(key, length - SEED + 1) & _POS).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), ends - begins)[:len(best)]
    start = np.flatnonzero(np.arange(len(best)) + length <= ends[doc])
    best, doc = best[start], doc[start]
    heads = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.r_[heads, len(start)])
    first, seed = start[heads], best[heads]
    with np.errstate(over="ignore"):
        body = (sums[first + count + length - 1] - sums[first]) * powers.down[first]
        body = mix(body ^ (count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        width, bands = band_starts(length), np.zeros(len(seed), np.uint64)
        for j in range(BANDS):
            some = np.flatnonzero((seed - first - count + 1 < width * (j + 1)) & (seed - first >= width * j))
            high = seed[some] - width * j
            core = mix((sums[high - width + 1 + length] - sums[high]) * powers.down[high])
            bands[some] |= (core % np.uint64(65535) + np.uint64(1)) << np.uint64(16 * j)
    doc = doc[heads]
    return doc, first - begins[doc], count, gram[seed], body, seed - first, bands


_SEEDS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("start", T.LongType()), T.StructField("count", T.IntegerType()),
    T.StructField("seed", T.LongType()), T.StructField("body", T.LongType()), T.StructField("at", T.IntegerType()),
    T.StructField("bands", T.LongType()), T.StructField("n", T.LongType()), T.StructField("others", T.BinaryType()),
    T.StructField("_id", T.LongType()), T.StructField("_null_id", T.BooleanType()), T.StructField("_text_key", T.LongType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def _seeded(length: int):
    """Segments of all texts, equal ones of a batch once with the places of the others, and a line per text."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = text_bytes(batch.column(3))
            parts = []
            short = [t if len(t) <= STRETCH else b"" for t in texts]
            for a, b in blocks(short):
                doc, *rest = seeds(short[a:b], length)
                parts.append((doc + a, *rest))
            for i, t in enumerate(texts):
                for cut in range(0, len(t), STRETCH) if len(t) > STRETCH else ():
                    doc, first, *rest = seeds([t[cut:cut + STRETCH + length - 1]], length)
                    parts.append((doc + i, first + cut, *rest))
            doc, first, count, seed, body, at, bands = (np.concatenate(x) for x in zip(*parts)) if parts else seeds([], length)
            order = np.lexsort((body, seed))
            doc, first, count, seed, body, at, bands = (x[order] for x in (doc, first, count, seed, body, at, bands))
            heads = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (body[1:] != body[:-1])]) if len(doc) else np.zeros(0, np.int64)
            n = np.diff(np.r_[heads, len(doc)])
            others = [None] * len(heads)
            for k in np.flatnonzero(n > 1).tolist():
                s = slice(heads[k] + 1, heads[k] + n[k])
                others[k] = np.stack([doc[s] + number, first[s]], axis=1).astype("<i8").tobytes()
            # in order of their texts, which lie together in the file
            line = np.argsort(doc[heads], kind="stable")
            pick = heads[line]
            own = [pa.array(x) for x in (doc[pick] + number, first[pick], count[pick].astype(np.int32), seed[pick].view(np.int64),
                                         body[pick].view(np.int64), at[pick].astype(np.int32), bands[pick].view(np.int64), n[line])]
            none = [pa.nulls(len(pick), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays(own + [pa.array([others[k] for k in line.tolist()], pa.binary())] + none, names=_SEEDS.names)
            lack = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(texts)))] + lack + [batch.column(i) for i in range(3)] +
                [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                names=_SEEDS.names)
            number += len(texts)
    return run


def _others(batches):
    """Places of the segments that were combined within a batch."""
    import pyarrow as pa

    for batch in batches:
        raws, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        places = np.frombuffer(b"".join(raws), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places[:, 0]), pa.array(places[:, 1]), pa.array(np.repeat(counts, [len(r) // 16 for r in raws]).astype(np.int32))],
            names=["row", "start", "count"])


_FATE = T.StructType([T.StructField("row", T.LongType()), T.StructField("start", T.LongType()), T.StructField("count", T.IntegerType()),
                      T.StructField("seed", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("whole", T.BooleanType()),
                      T.StructField("read", T.IntegerType()), T.StructField("hot", T.BooleanType())])


def _fates(batches):
    """What becomes of segments, in a stream sorted by (seed, body) whose seeds have SEED_ROWS rows at most.

    A body that is there twice is repeated as a ``whole``. Where bodies of a seed share the
    hash of a band, one segment of each must be ``read`` to compare the windows of that band
    (a bit each); other windows have no equal.
    """
    import pyarrow as pa

    def settle(row, start, count, seed, body, at, bands, n):
        new_seed = np.r_[True, seed[1:] != seed[:-1]]
        heads = np.flatnonzero(new_seed | np.r_[True, body[1:] != body[:-1]])
        size = np.diff(np.r_[heads, len(seed)])
        whole = np.repeat(np.add.reduceat(n, heads) > 1, size)
        of, read = (np.cumsum(new_seed) - 1)[heads], np.zeros(len(seed), np.int32)
        for j in range(BANDS):
            name = bands[heads] >> (16 * j) & 65535
            _, at_name, times = np.unique(of << 16 | name, return_inverse=True, return_counts=True)
            read[heads] |= ((times[at_name] > 1) & (name > 0)).astype(np.int32) << j
        keep = np.flatnonzero(whole | (read > 0))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (
            row, start, count, seed, at, whole, read, np.zeros(len(seed), bool))], names=_FATE.names)

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(8)])
        size += batch.num_rows
        if size < 65536:
            continue
        x = [np.concatenate(c) for c in zip(*held)]
        cut = np.searchsorted(x[3], x[3][-1])
        held, size = [[c[cut:] for c in x]], size - cut
        if cut:
            yield settle(*(c[:cut] for c in x))
    if size:
        yield settle(*(np.concatenate(c) for c in zip(*held)))


def crowded_fates(segments: DataFrame, seed_rows: int) -> DataFrame:
    """The same (_FATE) for seeds of any number of segments, which no task sees whole.

    Bodies and seeds are counted before their shuffles; the joins have one row a key on one
    side and can be split. Seeds of more than ``seed_rows`` bodies are ``hot``.
    """
    bodies = stored(segments.groupBy("seed", "body").agg(
        F.sum("n").alias("copies"), F.min(F.struct("row", "start")).alias("first")), "crowded-bodies")
    judged = bodies.join(bodies.groupBy("seed").agg(F.count("*").alias("bodies")), "seed")
    first = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start")) & (F.col("bodies") > 1)
    return segments.join(judged, ["seed", "body"]).select(
        "row", "start", "count", "seed", "at", (F.col("copies") > 1).alias("whole"),
        F.when(first, (1 << BANDS) - 1).otherwise(0).alias("read"), (F.col("bodies") > seed_rows).alias("hot")).where("whole OR read > 0")


# -- segments of the texts that need it --------------------------------------------------------

def _cuts(start: int, count: int, seed_at: int, width: int) -> list[tuple[int, int, int]]:
    """(band, first start, last start) of a segment's windows in each band of ``width`` seed offsets."""
    return [(j, max(seed_at - width * (j + 1) + 1, start), min(seed_at - width * j, start + count - 1))
            for j in range((seed_at - start - count + 1) // width, (seed_at - start) // width + 1)]


def _affected(length: int):
    """Compressed text and segments to read of each text, from (row, text, reads)."""
    def run(batches):
        import pyarrow as pa

        segment = pa.struct([("seed", pa.int64()), ("bytes", pa.binary()), ("start", pa.int64()), ("count", pa.int32()), ("whole", pa.bool_())])
        for batch in batches:
            out = []
            for packed, reads in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, own = zlib.decompress(packed), []
                for r in reads or ():
                    cuts, seed_at = [], r["start"] + r["at"]
                    if r["hot"]:
                        # windows whose seed lies at like offsets share the bytes around it: these are a longer seed
                        for j, a, b in _cuts(r["start"], r["count"], seed_at, CORE_STARTS):
                            high = seed_at - CORE_STARTS * j
                            core = text[high:high - CORE_STARTS + 1 + length]
                            name = hashlib.blake2b(core + b"%d,%d" % (r["seed"], j), digest_size=8).digest()
                            cuts.append((int.from_bytes(name, "big", signed=True), a, b))
                    else:
                        # a higher band lies before a lower one; neighbours are one segment
                        for j, a, b in reversed(_cuts(r["start"], r["count"], seed_at, band_starts(length))):
                            if not r["read"] >> j & 1:
                                continue
                            if cuts and cuts[-1][2] + 1 == a:
                                a = cuts.pop()[1]
                            cuts.append((r["seed"], a, b))
                    own += [{"seed": s, "bytes": text[a:b + length], "start": a, "count": b - a + 1, "whole": r["whole"]} for s, a, b in cuts]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(segment)), batch.column(3)],
                                             names=["row", "text", "segments", "wholes"])
    return run


# -- transform ---------------------------------------------------------------------------------

def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling of ranks; whole when no two ranks are equal."""
    n, step = len(symbols), 7
    key, wide = np.zeros(n, np.int64), np.concatenate((symbols.astype(np.int64), np.zeros(step, np.int64)))
    for j in range(step):
        key = key << 9 | wide[j:j + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        if rank[-1] == n - 1 or step >= n:
            return order
        place = np.empty(n, np.int64)
        place[order] = rank
        behind = np.zeros(n, np.int64)
        behind[:n - step] = place[step:] + 1
        key, step = place * (n + 1) + behind, 2 * step


def long_runs(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, run number of each place in it); suffixes of a run share ``length`` symbols.

    Breadth-first backward extension on the transform: intervals of all strings of one
    length are extended by a symbol to the left, and the upper end of each new interval
    is a place whose common prefix with its neighbour has just that length. Values come
    out in rising order, each place once, and the search stops at ``length``: places not
    reached share at least as much. Symbol 0 ends a segment and is never extended by; the
    runs hold for suffixes with at least ``length`` symbols before it.
    """
    n = len(symbols)
    order = suffix_order(symbols)
    last = symbols[order - 1]
    back = np.argsort(last, kind="stable")
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    bound = np.concatenate((np.cumsum(np.bincount(last, minlength=258)), [n]))
    low_of = np.concatenate(([0], bound[:-2]))
    found = np.zeros(n + 1, bool)
    found[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(low):
            break
        size = high - low + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        lo, hi = np.repeat(low, size), np.repeat(high, size)
        some = last[place] > 0
        place, lo, hi = place[some], lo[some], hi[some]
        symbol, to = last[place], forward[place]
        is_last = (to + 1 == bound[symbol]) | (back[np.minimum(to + 1, n - 1)] > hi)
        is_first = (to == low_of[symbol]) | (back[np.maximum(to - 1, 0)] < lo)
        low, high = np.sort(to[is_first]), np.sort(to[is_last])
        new = ~found[high + 1]
        low, high = low[new], high[new]
        found[high + 1] = True
    return order, np.cumsum(found[:n])


def repeated_starts(segments: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment those of its first ``counts`` window starts whose window is there twice."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    symbols = np.zeros(sizes.sum(), np.int16)
    begins = np.cumsum(sizes) - sizes
    filled = np.ones(len(symbols), bool)
    filled[begins + sizes - 1] = False
    symbols[filled] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order, run = long_runs(symbols, length)
    owner = np.repeat(np.arange(len(segments)), sizes)[order]
    owned = np.flatnonzero(order - begins[owner] < counts[owner])
    twice = np.bincount(run[owned])[run[owned]] > 1
    places = np.sort(order[owned[twice]])
    return [p - b for p, b in zip(np.split(places, np.searchsorted(places, begins[1:])), begins)]


def _compared(length: int):
    """Ranges to remove from segments read, in a stream sorted by seed; whole groups at a time."""
    def solve(rows):
        import pyarrow as pa

        starts = repeated_starts([r[1] for r in rows], np.array([r[3] for r in rows]), length)
        found = []
        for (_, _, first, _, row, whole), own in zip(rows, starts, strict=True):
            if whole or not len(own):
                continue
            cut = np.flatnonzero(np.diff(own) > 1)
            for a, b in zip(own[np.r_[0, cut + 1]].tolist(), own[np.r_[cut, len(own) - 1]].tolist()):
                found.append((row, first + a, first + b + length))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["row", "a", "b"])

    def run(batches):
        held, size, seed = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for r in zip(*columns, strict=True):
                if r[0] != seed:
                    if size >= TRANSFORM_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    seed = r[0]
                held.append(r)
                size += len(r[1])
        if held:
            yield solve(held)
    return run


def _windows(length: int):
    """(row, start, name, whole) of every window of segments; the name is 128 bits of its bytes."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for data, first, count, row, whole in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out += [(row, first + k, hashlib.blake2b(data[k:k + length], digest_size=16).digest(), whole) for k in range(count)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=["row", "start", "name", "whole"])
    return run


def crowded_ranges(reads: DataFrame, length: int) -> DataFrame:
    """Ranges to remove from segments of seeds that too many share: their windows are counted by name, whatever the number."""
    windows = stored(reads.select("bytes", "start", "count", "row", "whole").mapInArrow(
        _windows(length), "row long, start long, name binary, whole boolean"), "crowded-windows")
    twice = windows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return windows.where("NOT whole").join(twice, "name").select(
        "row", F.col("start").alias("a"), (F.col("start") + length).alias("b"))


def _removed(batches):
    """Union of the ranges of each text and what it leaves."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for packed, wholes, ranges in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            text = zlib.decompress(packed)
            kept, end, removed, spans = hashlib.sha256(), 0, 0, []
            for a, b in sorted([(r["a"], r["b"]) for r in wholes or ()] + [(r["a"], r["b"]) for r in ranges or ()]):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                kept.update(text[end:a])
                end, removed = b, removed + b - a
            kept.update(text[end:])
            out.append((removed, [{"a": a, "b": b} for a, b in spans], kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([o[0] for o in out], pa.int64()),
             pa.array([o[1] for o in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([o[2] for o in out], pa.string())],
            names=["row", "n_removed", "spans", "kept_sha256"])


def _compressed(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [
            pa.array([zlib.compress(t, 1) for t in text_bytes(batch.column(3))], pa.binary())], names=["_id", "_null_id", "_text_key", "text"])


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                 seed_rows: int = SEED_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, ``spans`` (a, b: removed runs) and kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes around it starts anywhere else in the corpus,
    the same text included; strings never cross texts. Texts are UTF-8 bytes, null counts as
    empty. A row repeated whole repeats its text and so loses what is long enough.

    A transform of the whole corpus would be one task's work, so equal windows first meet by
    their seed (``seeds``): equal windows have equal seeds, and each window has one. Segments
    equal within a batch are one row before any shuffle. Segments that are there twice are
    decided by their hashes (seed and body, 128 bits). Of the rest those bands are read whose
    common bytes another segment of the seed has too, by a hash that only rules out; their
    windows are compared in ``repeated_starts``, whole groups in blocks of about
    TRANSFORM_BYTES.

    A passage that any share of the corpus has makes a seed of as many segments. Seeds of more
    than ``seed_rows`` segments are judged by aggregations (``crowded_fates``); those of more
    than ``seed_rows`` different segments are split by longer seeds, which equal windows share
    as well, and where one of these still has more, its windows are counted one by one
    (``crowded_ranges``). So a task holds ``seed_rows`` segments of a seed at most.
    """
    own = list(identity())
    named = docs.select(*(c.alias(k) for k, c in identity(id_col, text_col).items()), F.col(text_col).alias("text"))
    index = stored(named.mapInArrow(_seeded(length), _SEEDS), "seeds")
    lines = index.where("n_bytes IS NOT NULL").select("row", *own, "n_bytes", "sha256")
    segments = index.where("seed IS NOT NULL")
    places = segments.select("row", "start", "count", "seed", "body", "at", "bands", "n")
    crowded = stored(places.groupBy("seed").agg(F.count("*").alias("_rows")).where(F.col("_rows") > seed_rows).select("seed"), "crowded-seeds")
    some = not crowded.isEmpty()
    few = places.join(crowded, "seed", "left_anti").select(places.columns) if some else places
    fates = few.repartition("seed").sortWithinPartitions("seed", "body").mapInArrow(_fates, _FATE)
    if some:
        fates = fates.unionByName(crowded_fates(places.join(crowded, "seed", "left_semi").select(places.columns), seed_rows))
    fates = stored(fates, "segment-fates")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") + length - 1).alias("b"))
    read = "struct<seed:bigint,start:bigint,count:int,at:int,whole:boolean,read:int,hot:boolean>"
    copies = segments.where("n > 1").select("others", "count").mapInArrow(_others, "row long, start long, count int")
    wholes = fates.where("whole").select("row", "start", "count").unionByName(copies)
    todo = wholes.select("row", span.alias("w"), F.lit(None).cast(read).alias("r")).unionByName(fates.where("read > 0").select(
        "row", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("w"),
        F.struct("seed", "start", "count", "at", "whole", "read", "hot").alias("r")))
    todo = todo.groupBy("row").agg(F.collect_list("w").alias("wholes"), F.collect_list("r").alias("reads"))
    texts = named.mapInArrow(_compressed, T.StructType([
        T.StructField("_id", T.LongType()), T.StructField("_null_id", T.BooleanType()), T.StructField("_text_key", T.LongType()),
        T.StructField("text", T.BinaryType())]))
    wanted = todo.join(lines.select("row", *own), "row")
    affected = stored(texts.dropDuplicates(own).join(wanted, own).select("row", "text", "reads", "wholes").mapInArrow(
        _affected(length), "row long, text binary, segments array<struct<seed:long,bytes:binary,start:long,count:int,whole:boolean>>, "
        "wholes array<struct<a:long,b:long>>"), "affected-texts")
    reads = affected.select("row", F.explode("segments").alias("s")).select("s.seed", "s.bytes", "s.start", "s.count", "row", "s.whole")
    own_columns = reads.columns
    crowded = stored(reads.groupBy("seed").agg(F.count("*").alias("_rows")).where(F.col("_rows") > seed_rows).select("seed"), "crowded-cores")
    some = not crowded.isEmpty()
    few = reads.join(crowded, "seed", "left_anti").select(own_columns) if some else reads
    ranges = few.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compared(length), "row long, a long, b long")
    if some:
        ranges = ranges.unionByName(crowded_ranges(reads.join(crowded, "seed", "left_semi").select(own_columns), length))
    ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    cut = affected.select("row", "text", "wholes").join(ranges, "row", "left").select("row", "text", "wholes", "ranges").mapInArrow(
        _removed, "row long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string")
    return lines.join(cut, "row", "left").select(
        F.when(~F.col("_null_id"), F.col("_id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *own)
