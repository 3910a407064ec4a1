"""Alignment of two tokenizers by galloping intersection of their token ends."""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, stored, text_bytes
from .packing import SPLIT, byte_table

#: Counts of id pairs up to this many are broadcast (17 bytes each); more are joined by the pair.
BROADCAST_PAIRS = 1 << 21
#: Texts beyond this many characters go to the piece model in parts.
PART = 1 << 20
#: Each level of the search has this many times as many values as the one above it.
FAN = 16


# -- search ------------------------------------------------------------------------------------

def _gallop(values: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place in ``into`` not below each value, by doubling steps from ``start`` and then halving them.

    ``start`` is a place at or before the answer, for instance that of a smaller value.
    """
    n = len(into)
    low, high = start.copy(), start.copy()  # answers are in [low, high]
    going = np.flatnonzero(high < n)
    going = going[into[high[going]] < values[going]]
    step = 1
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, n)
        going = going[high[going] < n]
        going = going[into[high[going]] < values[going]]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = into[middle] < values[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def galloping(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the values that two strictly rising arrays share; ``short`` drives the search.

    A value is sought from the place of one before it, which is near: first every
    FAN**k-th value, from the last place of the level above, down to every value.
    """
    place = np.zeros(len(short), np.int64)
    stride = 1
    while stride * FAN < len(short):
        stride *= FAN
    above = 0
    while stride:
        at = np.arange(0, len(short), stride)
        start = place[at // above * above] if above else np.zeros(len(at), np.int64)
        place[at] = _gallop(short[at], long, start)
        above, stride = stride, stride // FAN
    inside = place < len(long)
    same = np.flatnonzero(inside)
    same = same[long[place[same]] == short[same]]
    return same, place[same]


# -- tokenizers --------------------------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def byte_level(path: str):
    """(encode, bytes of each id) of a byte-level BPE file whose ids follow its merges; no string is special."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    byte_of, vocabulary = byte_table(), spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if any(vocabulary.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        raise ValueError("ids do not follow the merges")
    raw = {i: t.encode() if t in added else bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}
    ranks = {t: i for i, t in raw.items() if t.decode(errors="replace") not in added}
    own = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return own.encode_to_numpy, [raw.get(i, b"") for i in range(max(raw) + 1)]


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """(encode many, bytes of each id) of a piece model that puts a space before its text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    # no piece has a space behind another character: the model never joins what lies on both sides of a word's space
    cut = None if any("▁" in n.lstrip("▁") for n in names) else re.compile("(?<=[^ ▁]) (?=[^ ▁])")

    def parts(text: str):
        begin = 0
        while len(text) - begin > PART:
            gap = cut.search(text, begin + PART) if cut else None
            if gap is None:
                break
            yield text[begin:gap.start()]
            begin = gap.end()
        yield text[begin:]

    def encode(texts: list[str]) -> list[np.ndarray]:
        short = model.encode([t if len(t) <= PART else "" for t in texts], num_threads=1)
        return [np.array(ids, np.int64) if len(t) <= PART else np.concatenate([np.array(model.encode(p), np.int64) for p in parts(t)])
                for t, ids in zip(texts, short, strict=True)]
    return encode, raw


# -- groups and links --------------------------------------------------------------------------

class Side:
    """Tokens of one tokenizer over some texts: ids, number of each text and byte ends counted over all texts."""

    def __init__(self, ids: list[np.ndarray], table):
        self.n = np.array([len(i) for i in ids], np.int64)
        self.ids = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        joined = table.take(self.ids)
        self.bytes = joined.buffers()[2]
        self.ends = np.frombuffer(joined.buffers()[1], np.int64, len(self.ids) + 1)[1:] if len(self.ids) else np.zeros(0, np.int64)
        self.stops = np.cumsum(self.n)

    def spells(self, i: int, raw: bytes) -> bool:
        """Whether the tokens of text ``i`` joined are ``raw``."""
        a, b = self.stops[i] - self.n[i], self.stops[i]
        if a == b:
            return False
        begin, end = self.ends[a - 1] if a else 0, self.ends[b - 1]
        return end - begin == len(raw) and self.bytes[int(begin):int(end)].to_pybytes() == raw

    def of(self, chosen: np.ndarray) -> np.ndarray:
        return np.repeat(chosen, self.n)


def common_ends(a: Side, b: Side, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of both sides that end together in texts that are ``good``, whose bytes agree.

    In each text the side with fewer tokens drives.
    """
    first = [np.r_[0, s.ends] for s in (a, b)]
    sizes = np.where(good, first[0][a.stops] - first[0][a.stops - a.n], 0)
    base = np.cumsum(sizes) - sizes
    # ends counted over good texts only, so that both sides count alike
    place = [s.ends + np.repeat(base - f[s.stops - s.n], s.n) for s, f in zip((a, b), first)]
    found = []
    for short, long, chosen in ((0, 1, good & (a.n <= b.n)), (1, 0, good & (a.n > b.n))):
        own = [np.flatnonzero(s.of(chosen)) for s in (a, b)]
        x, y = galloping(place[short][own[short]], place[long][own[long]])
        pair = {short: own[short][x], long: own[long][y]}
        found.append((pair[0], pair[1]))
    left, right = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(left, kind="stable")
    return left[order], right[order]


def _group_text(a: Side, b: Side, good: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(buffer, first byte and end of each text in it): groups as ``a1,a2|b1;a3|b2,b3``.

    Differences of neighbouring common places are the sizes of the groups on both sides.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    of_a, of_b = a.of(good), b.of(good)
    rank_a, rank_b = np.cumsum(of_a) - 1, np.cumsum(of_b) - 1
    ca, cb = rank_a[left], rank_b[right]
    size_a, size_b = np.diff(ca, prepend=-1), np.diff(cb, prepend=-1)
    at_a = np.arange(size_a.sum()) + np.repeat(cb + 1 - size_b, size_a)
    at_b = np.arange(size_b.sum()) + np.repeat(ca + 1, size_b)
    ids, mark = np.empty(len(at_a) + len(at_b), np.int64), np.zeros(len(at_a) + len(at_b), np.int8)
    ids[at_a], ids[at_b] = a.ids[of_a], b.ids[of_b]
    mark[at_a[ca]], mark[at_b[cb]] = 1, 2
    marks = pa.DictionaryArray.from_arrays(pa.array(mark), pa.array([",", "|", ";"], pa.large_string())).cast(pa.large_string())
    text = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), marks, pa.scalar("", pa.large_string()))
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1) if len(text) else np.zeros(1, np.int64)
    stops = np.cumsum(np.where(good, a.n + b.n, 0))
    return text.buffers()[2], at[np.r_[0, stops[:-1]]], at[stops]


_ALIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")] +
    [T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def _aligned(path_a: str, path_b: str, digest: bool):
    def run(batches):
        import pyarrow as pa

        (encode_a, raw_a), (encode_b, raw_b) = byte_level(path_a), pieces(path_b)
        tables = [pa.array(r, pa.large_binary()) for r in (raw_a, raw_b)]
        n_ids = len(raw_b)
        for batch in batches:
            raws = text_bytes(batch.column(1))
            out = []
            for begin, end in blocks(raws):
                raw = raws[begin:end]
                texts = [r.decode() for r in raw]
                a = Side([encode_a(" " + t) if t else np.zeros(0, np.int64) for t in texts], tables[0])
                b = Side(encode_b(texts), tables[1])
                good = np.array([bool(r) and a.spells(i, b" " + r) and b.spells(i, b" " + r) for i, r in enumerate(raw)], bool)
                left, right = common_ends(a, b, good)
                buffer, starts, stops = _group_text(a, b, good, left, right)
                text = [buffer[int(s):int(e) - 1] if e > s else None for s, e in zip(starts, stops)]
                groups = ["" if t is None else hashlib.sha256(t).hexdigest() if digest else t.to_pybytes().decode() for t in text]
                doc = np.searchsorted(a.stops, left, side="right")
                span = len(raw_a) * n_ids
                pair, times = np.unique(doc * span + a.ids[left] * n_ids + b.ids[right], return_counts=True)
                ends = np.searchsorted(pair // span, np.arange(len(texts) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (pair % span, times)]
                counts = [np.where(good, a.n, 0), np.where(good, b.n, 0), np.bincount(doc, minlength=len(texts))]
                out.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *(pa.array(c) for c in counts), pa.array(groups, pa.string()), *lists],
                    names=_ALIGNED.names))
            yield from out
    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, pairs and times of every row.

    A is the byte-level BPE file ``path_a`` over space+text, B the piece model ``path_b``, which
    adds the space itself. Byte offsets where tokens of both end cut the text into groups;
    ``groups`` has their ids as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its SHA-256). The last
    tokens of a group end together: that is its link. ``pairs`` are the linked id pairs of the
    row (A id times the number of B ids, plus B id), each once, with their ``times``.

    Null and empty texts, and texts that A or B does not spell out, have no tokens: zeros, an
    empty string and empty arrays. Repeated rows give repeated rows, an empty table gives
    none, other columns are not read. One pass without a shuffle; a task holds a block of
    texts or one longer text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_aligned(path_a, path_b, digest), _ALIGNED)


def _summed(batches):
    """Pairs of a batch with the sum of their times."""
    import pyarrow as pa

    for batch in batches:
        pair, at = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
        times = batch.column(1).flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, times, len(pair)).astype(np.int64))], names=["pair", "n"])


def pair_counts(aligned: DataFrame, n_ids: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair, and whether no other pair of its B id has more."""
    counts = stored(aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % n_ids).alias("_b")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_b", F.col("pair") % n_ids).join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def link_statistics(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    digest: bool = True, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align`` with n_links, n_best and count_sum in place of pairs and times.

    n_best counts the links whose pair has the highest count of its B id over all rows, ties
    included; count_sum adds the counts of all links. Pairs are counted per batch before the
    shuffle. Their number is bounded by the two vocabularies, not by the corpus; up to
    ``broadcast_pairs`` the counts are broadcast, beyond it the pairs of each row are joined
    to them, with the same results.
    """
    spark = docs.sparkSession
    n_ids = len(pieces(path_b)[1])
    rows = stored(align(docs, path_a, path_b, id_col, text_col, digest).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows, n_ids), "pair-ranks")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("pair")
        given = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))

        def measured(batches):
            import pyarrow as pa

            pair, n, best = given.value
            for batch in batches:
                lists, times = batch.column(5), batch.column(6).flatten().to_numpy()
                at = np.searchsorted(pair, lists.flatten().to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                sums = [pa.array(_sum_by(doc, x, batch.num_rows)) for x in (times, times * best[at], times * n[at])]
                yield pa.RecordBatch.from_arrays(batch.columns[:5] + sums, names=[*names, "n_links", "n_best", "count_sum"])

        schema = T.StructType(_ALIGNED.fields[:5] + [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")])
        return rows.select(*names, "pairs", "times").mapInArrow(measured, schema)
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = links.join(counts.hint("merge"), "pair").groupBy("_row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.select("_row", *names).join(sums, "_row", "left").drop("_row").fillna(0, ["n_links", "n_best", "count_sum"])


def _sum_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by rising group numbers, exact beyond the 53 bits of a double."""
    total = np.r_[0, np.cumsum(values)]
    return np.diff(total[np.searchsorted(group, np.arange(n + 1))])
