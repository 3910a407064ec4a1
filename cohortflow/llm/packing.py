"""Packing into fixed windows whose sources keep target proportions."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import stored, text_bytes

#: Weights of sources are whole numbers up to this.
SCALE = 1 << 20
#: Queue bases up to this many rows are broadcast; more are joined by their keys.
BROADCAST_BASES = 100_000

#: Fixed value: how byte-level vocabularies of this kind split text before their merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white-space characters meet; it needs no look-ahead and is faster.
SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_ASCII_SPACE = bytes(32 if b in b"\t\n\v\f\r " else b for b in range(256))
#: First bytes of white space beyond ASCII (and of some other characters: the test may only err to this side).
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def byte_table() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str):
    """A function from a text to its ids (a numpy array), as the ``tokenizers`` file says.

    Plain byte-level BPE whose ids follow its merges is run by ``tiktoken``, which gives the
    same ids several times faster; any other file, and any text with an added token in it,
    goes through ``tokenizers``.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def by_file(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    model, first = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    plain = (model.get("type") == "BPE" and first.get("type") == "ByteLevel" and not first.get("add_prefix_space")
             and first.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
             and not model.get("unk_token") and not model.get("end_of_word_suffix")
             and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
             and all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges)))
    if not plain:
        return by_file
    import tiktoken

    byte_of, added = byte_table(), [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    full, single = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                    for n, p in (("full", SPLIT), ("single", SPLIT_SINGLE)))

    def fast(text):
        if any(t in text for t in added):
            return by_file(text)
        raw = text.encode()
        spaced = b"  " in raw.translate(_ASCII_SPACE) or any(w in raw for w in _WIDE_SPACE)
        return (full if spaced else single).encode_to_numpy(text)
    return fast


_QUEUED = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("queue", T.StringType()), T.StructField("before", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


def _tokenized(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, before = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column(1).to_pylist()
            ids, starts, sizes = [], [], []
            for queue, raw in zip(queues, text_bytes(batch.column(2)), strict=True):
                tokens = np.append(encode(raw.decode()), np.uint32(end_id)).astype("<u4")
                narrow = tokens.astype("<u2") if int(tokens.max()) < 1 << 16 else None
                ids.append(b"\2" + narrow.tobytes() if narrow is not None else b"\4" + tokens.tobytes())
                starts.append(before.get(queue, 0))
                sizes.append(len(tokens))
                before[queue] = starts[-1] + len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int64)), batch.column(1), pa.array(starts, pa.int64()),
                 batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "queue", "before", "doc_id", "n", "ids"])
    return run


class RoundRobin:
    """Deficit round-robin over token queues, in closed form.

    In every window each queue earns its weight's share of the window as credit and is
    served whole tokens; what is short of its credit, its deficit, is carried on. That
    serves token j of queue s when (2 j + 1) / weight comes up, ties by queue. So the tokens
    served before any window follow from its number alone: any task takes up the deficits
    that the windows before have left, without going through them. An exhausted queue earns
    nothing more and the others share its part; every window but the last is full.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.window = np.array(totals, np.int64), np.array(weights, np.float64), window
        ends = 2.0 * self.totals / self.weights
        self.times = np.unique(np.r_[0.0, ends])
        self.served = np.minimum(self.totals[None], self.weights[None] * self.times[:, None] / 2).sum(axis=1)
        self.total = int(self.totals.sum())

    def bounds(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue served before each window, exactly."""
        goal = np.minimum(windows.astype(np.int64) * self.window, self.total)
        queues = len(self.totals)
        time = np.interp(goal - queues / 2 - 1, self.served, self.times)
        got = np.minimum(np.maximum(np.floor((self.weights * time[:, None] + 1) / 2 - 1e-6), 0), self.totals).astype(np.int64)
        rows = np.flatnonzero(got.sum(axis=1) < goal)
        while len(rows):
            upcoming = np.where(got[rows] < self.totals, (2.0 * got[rows] + 1) / self.weights, np.inf)
            got[rows, upcoming.argmin(axis=1)] += 1
            rows = rows[got[rows].sum(axis=1) < goal[rows]]
        return got

    def around(self, queue: int, first: int, last: int) -> tuple[int, int]:
        """Window numbers that enclose the tokens first .. last - 1 of a queue."""
        at = np.interp(2.0 * np.array([first, last]) / self.weights[queue], self.times, self.served) / self.window
        slack = len(self.totals) / self.window + 2
        return max(0, int(at[0] - slack)), int(at[1] + slack) + 1

    def pieces(self, queue: int, starts: np.ndarray, sizes: np.ndarray, block: int = 4096):
        """Yields (row, start in row, length, window, offset) arrays for rows that follow each other in a queue."""
        ends = starts + sizes
        low, high = self.around(queue, int(starts[0]), int(ends[-1]))
        for w in range(low, high, block):
            bounds = self.bounds(np.arange(w, min(w + block, high) + 1))
            own = bounds[:, queue]
            a, b = max(int(starts[0]), int(own[0])), min(int(ends[-1]), int(own[-1]))
            if a >= b:
                continue
            cuts = np.unique(np.concatenate(([a, b], own[(own > a) & (own < b)], starts[(starts > a) & (starts < b)])))
            begin, length = cuts[:-1], np.diff(cuts)
            row = np.searchsorted(starts, begin, side="right") - 1
            at = np.searchsorted(own, begin, side="right") - 1
            ahead = np.diff(bounds[:, :queue].sum(axis=1))[at] if queue else 0
            yield row, begin - starts[row], length, at + w, ahead + begin - own[at]


_PIECE = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in (
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])


def runs(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``rows`` of one queue, cut wherever a row does not begin where the one before it ends.

    A batch may hold rows of several tasks: scans put files together in any order, and
    tasks of one queue that meet in a batch need not follow each other.
    """
    return np.split(rows, np.flatnonzero(starts[rows[1:]] != (starts + sizes)[rows[:-1]]) + 1)


def _packed(names: list[str], robin: RoundRobin, with_ids: bool):
    number = {n: i for i, n in enumerate(names)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            queues = np.array([number[q] for q in batch.column(0).to_pylist()], np.int64)
            starts, sizes = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            docs, ids = batch.column(2), batch.column(4)
            for queue_rows in (np.flatnonzero(queues == q) for q in np.unique(queues)):
                for rows in runs(queue_rows, starts, sizes):
                    raw = []
                    for i in rows.tolist():
                        value = ids[i].as_py()
                        raw.append(memoryview(np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4").tobytes()))
                    own = docs.take(pa.array(rows))
                    for row, start, length, window, offset in robin.pieces(int(queues[rows[0]]), starts[rows], sizes[rows]):
                        cut = [raw[r][4 * a:4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [own.take(pa.array(row)), pa.array(start), pa.array(length),
                             pa.array(np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))), pa.array(sizes[rows][row]),
                             pa.array(window), pa.array(offset),
                             pa.array([bytes(c) for c in cut], pa.binary()) if with_ids else pa.nulls(len(cut), pa.binary())],
                            names=_PIECE.names)
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0,
         weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """Pieces of all rows in sequences of ``window`` tokens, sources in target proportions.

    A row is the ids of its text (null: none) and ``end_id``. Rows are cut freely; each id
    lies in one piece. Returns doc_id, start, length, ids_crc32 (little-endian unsigned
    32-bit ids), doc_tokens, sequence_id, offset and, if asked for, the ids themselves. Only
    the last sequence may be short. ``weights`` gives the proportions of sources; without
    them each source has its share of all tokens, so that the mixture holds to the end. A
    null source is a source of its own. Repeated rows and rows with null ids are packed.

    Texts are tokenized once into a table in the shared folder, with the tokens that their
    task put into the queue before them. Bases of (task, queue) come from pre-aggregated
    totals; with them every row knows its place in its queue, and its windows and offsets
    follow from ``RoundRobin``. Tokens are never shuffled. What the driver holds are one
    total per source; the number of sources must be far below the tokens of a window.
    """
    queue = F.concat(F.lit("="), F.col(source_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(queue, F.lit("")).alias("queue"),
                       F.col(text_col).alias("text"))
    tokens = stored(rows.mapInArrow(_tokenized(tokenizer, end_id), _QUEUED), "tokens")
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.select("queue", "part", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "queue-bases")
    totals = {r.queue: r.n for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return docs.sparkSession.createDataFrame([], _PIECE) if with_ids else docs.sparkSession.createDataFrame([], _PIECE).drop("ids")
    share = {n: (weights or {}).get(n[1:], 0.0) if weights else float(totals[n]) for n in names}
    most = max(share.values()) or 1.0
    robin = RoundRobin([totals[n] for n in names], [max(1, round(SCALE * share[n] / most)) for n in names], window)
    few = bases.count() <= BROADCAST_BASES
    bases = bases.select("queue", "part", "base")
    placed = tokens.join(F.broadcast(bases) if few else bases, ["queue", "part"])
    if not few:  # rows of a task in a queue follow each other again, which keeps runs long
        placed = placed.sortWithinPartitions("queue", "part", "before")
    out = placed.select("queue", (F.col("base") + F.col("before")).alias("start"), "doc_id", "n", "ids").mapInArrow(
        _packed(names, robin, with_ids), _PIECE)
    return out if with_ids else out.drop("ids")
