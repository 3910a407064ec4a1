"""Byte-level BPE by recursive DuckDB queries, one in-memory connection per Python worker."""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

#: Matches of the pattern that are looked at together, and distinct ones whose ids a worker remembers.
MATCHES, WORDS = 1 << 19, 600_000
#: Words up to this many bytes lose one pair a step; longer ones every pair that cannot touch another.
LONG = 256
#: Words that one query takes.
QUERY_WORDS = 20_000

#: A step contracts, in each word, its leftmost pair of minimum rank: rows know their next token, so
#: the contracted row takes over the row it swallows, and the row before it learns the new token.
SHORT_SQL = """
    WITH RECURSIVE bpe(w, p, tok, q, nxt, done) AS (
      SELECT w, p, tok, lead(p) OVER o, lead(tok) OVER o, false FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
      UNION ALL
      (WITH ranked AS MATERIALIZED (
        SELECT w, p, tok, q, nxt, (rank::BIGINT << 40) | (p::BIGINT << 20) | q AS key, (w::BIGINT << 20) | p AS place
        FROM bpe LEFT JOIN merges ON pair = tok::BIGINT << 32 | nxt WHERE NOT done),
      least AS (SELECT w, min(key) AS key FROM ranked GROUP BY w),
      cut AS (SELECT l.w, ((l.key >> 20) & 1048575)::INT AS p, (l.key >> 40)::INT AS new, (l.key & 1048575)::INT AS q, d.q AS q2, d.nxt AS nxt2
        FROM least l LEFT JOIN ranked d ON d.place = ((l.w::BIGINT << 20) | (l.key & 1048575)))
      SELECT r.w, r.p, CASE WHEN r.p = c.p THEN c.new ELSE r.tok END, CASE WHEN r.p = c.p THEN c.q2 ELSE r.q END,
        CASE WHEN r.p = c.p THEN c.nxt2 WHEN r.q = c.p THEN c.new ELSE r.nxt END, c.new IS NULL
      FROM ranked r JOIN cut c ON r.w = c.w WHERE c.q IS NULL OR r.p <> c.q))
    SELECT w, tok FROM bpe WHERE done ORDER BY w, p"""

#: The same for long words, with one row a token kept in place (a swallowed one becomes -1). Of the pairs
#: of minimum rank those are contracted together whose order cannot matter: every second one of a run of
#: overlapping ones, and of a token with an extension of lower rank, which is due before the next of its
#: rank, only ones too far apart for any token to reach from one to the other.
LONG_SQL = """
    WITH RECURSIVE bpe(w, p, tok, q, nxt) USING KEY (w, p) AS (
      SELECT w, p, tok, lead(p) OVER o, lead(tok) OVER o FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
      UNION
      (WITH ranked AS MATERIALIZED (
        SELECT b.w, b.p, b.tok, b.q, b.nxt, m.rank, m.alone FROM recurring.bpe b
        LEFT JOIN merges m ON m.pair = b.tok::BIGINT << 32 | b.nxt
        WHERE b.tok >= 0 AND b.w IN (SELECT DISTINCT w FROM bpe)),
      least AS (SELECT w, min(rank) AS rank FROM ranked GROUP BY w),
      equal AS (SELECT r.*, row_number() OVER o AS n, lag(r.p) OVER o AS before,
          coalesce(lag(r.q) OVER o <> r.p, true)::INT AS head
        FROM ranked r JOIN least l ON r.w = l.w AND r.rank = l.rank WINDOW o AS (PARTITION BY r.w ORDER BY r.p)),
      runs AS (SELECT *, sum(head) OVER (PARTITION BY w ORDER BY p) AS run FROM equal),
      turns AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS turn FROM runs),
      cut AS MATERIALIZED (
        SELECT t.w, t.p, t.q, t.rank AS new, d.q AS q2, d.nxt AS nxt2
        FROM turns t JOIN ranked d ON d.w = t.w AND d.p = t.q
        WHERE turn % 2 = 1 AND (NOT t.alone OR n = 1 OR t.p - before > {reach})),
      moved AS (
        SELECT r.w, r.p, coalesce(c.new, r.tok) AS tok, c.p IS NOT NULL AS fresh,
          CASE WHEN c.p IS NULL THEN r.q ELSE c.q2 END AS q, CASE WHEN c.p IS NULL THEN r.nxt ELSE c.nxt2 END AS nxt
        FROM ranked r LEFT JOIN cut c ON c.w = r.w AND c.p = r.p
        WHERE NOT EXISTS (SELECT 1 FROM cut e WHERE e.w = r.w AND e.q = r.p))
      SELECT m.w, m.p, m.tok::INT, m.q, coalesce(c.new, m.nxt)::INT
      FROM moved m LEFT JOIN cut c ON c.w = m.w AND c.p = m.q WHERE m.fresh OR c.p IS NOT NULL
      UNION ALL SELECT w, q, -1, NULL, NULL FROM cut))
    SELECT w, tok FROM bpe WHERE tok >= 0 ORDER BY w, p"""

DECODE_SQL = """
    SELECT w, string_agg(text, '' ORDER BY p) AS text FROM tokens JOIN vocabulary ON id = tok GROUP BY w ORDER BY w"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coder:
    """Words to ids and back over tables ``merges`` and ``vocabulary`` of an in-memory database.

    Every split of a token into two tokens is a merge with the token's rank. A word that is a
    token is that token, whatever its merges would give.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb
        import pyarrow as pa

        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, lowered = [], set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
                lowered.update(x for x in (a, b) if x is not None and x > rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        # tables of (token positions of) one query at a time are registered under these names
        self._table("merges", {"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32()),
                               "alone": pa.array([r in lowered for _, r in pairs], pa.bool_())}, keep=True)
        # a character of ``text`` stands for the byte of its number
        self._table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "text": pa.array([t.decode("latin-1") for t in ranks])}, keep=True)
        self.long_sql = LONG_SQL.format(reach=2 * max(map(len, ranks), default=0))

    def _table(self, name: str, columns: dict, keep: bool = False):
        import pyarrow as pa

        given = pa.table(columns)
        self.con.register(f"{name}_given" if keep else name, given)
        if keep:
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_given")
            self.con.unregister(f"{name}_given")

    def _positions(self, sizes: np.ndarray, tokens: np.ndarray):
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._table("tokens", {"w": word, "p": place.astype(np.int32), "tok": tokens})

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; an empty word has none."""
        out = [b"" if not w or (known := self.ranks.get(w)) is None else known.to_bytes(4, "little") for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        short = [i for i in todo if len(words[i]) <= LONG]
        groups = [(SHORT_SQL, short[k:k + QUERY_WORDS]) for k in range(0, len(short), QUERY_WORDS)]
        for sql, group in groups + [(self.long_sql, [i]) for i in todo if len(words[i]) > LONG]:
            raw = np.frombuffer(b"".join(words[i] for i in group), np.uint8)
            self._positions(np.array([len(words[i]) for i in group]), self.byte[raw])
            word, ids = (c.to_numpy() for c in self.con.sql(sql).to_arrow_table().columns)
            flat, end = ids.astype("<i4").tobytes(), 0
            for i, size in zip(group, (4 * np.bincount(word, minlength=len(group))).tolist(), strict=True):
                out[i], end = flat[end:end + size], end + size
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids (as ``encode`` gives them), put together by an ordered aggregation."""
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        some = np.flatnonzero(sizes)
        if not len(some):
            return [b""] * len(ids)
        self._positions(sizes[some], np.frombuffer(b"".join(ids), "<i4"))
        texts = [t.encode("latin-1") for t in self.con.sql(DECODE_SQL).to_arrow_table()["text"].to_pylist()]
        if len(texts) < len(some):
            raise ValueError("an id is not in the vocabulary")
        if len(some) == len(ids):
            return texts
        out = [b""] * len(ids)
        for i, text in zip(some.tolist(), texts, strict=True):
            out[i] = text
        return out


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(read_ranks(path))


class Memory:
    """Ids and decoded bytes of words met lately, at most WORDS of them: those not met again are forgotten first."""

    def __init__(self, own: Coder):
        self.own, self.new, self.old = own, {}, {}

    def look_up(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.new) > WORDS // 2:
            self.new, self.old = {}, self.new
        found = [self.new.get(w) or self.old.get(w) for w in words]
        lack = [i for i, f in enumerate(found) if f is None]
        for begin in range(0, len(lack), QUERY_WORDS):
            some = lack[begin:begin + QUERY_WORDS]
            ids = self.own.encode([words[i].encode() for i in some])
            for i, pair in zip(some, zip(ids, self.own.decode(ids), strict=True), strict=True):
                found[i] = pair
        self.new.update(zip(words, found, strict=True))
        return found


@functools.lru_cache(maxsize=1)
def remembered(path: str) -> Memory:
    """The memory of this worker, which the tasks that it runs one after the other share."""
    return Memory(coder(path))


def _coded(path: str, pattern: str):
    """Ids and their decoded bytes of every text; equal matches of a block are encoded and decoded once."""
    def run(batches):
        import pyarrow as pa
        import regex

        memory, match = remembered(path), regex.compile(pattern)

        def settle(parts, rows, out):
            """Append ids and decoded bytes of the matches in ``parts`` to their rows."""
            found = pa.array(list(itertools.chain.from_iterable(parts)), pa.string()).dictionary_encode()
            stops = np.cumsum([0] + [len(p) for p in parts])
            for k, values in enumerate(zip(*memory.look_up(found.dictionary.to_pylist()))):
                whole = pa.array(values, pa.large_binary()).take(found.indices)
                data = whole.buffers()[2]
                ends = np.frombuffer(whole.buffers()[1], np.int64, len(found) + 1)[stops].tolist()
                for row, a, b in zip(rows, ends, ends[1:]):
                    out[row][k].append(data[a:b].to_pybytes())

        for batch in batches:
            out, parts, rows, size = [([], []) for _ in range(batch.num_rows)], [], [], 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = (m.group() for m in match.finditer(text)) if len(text or "") > MATCHES else match.findall(text or "")
                found = iter(found)
                while part := list(itertools.islice(found, MATCHES)):
                    parts.append(part)
                    rows.append(row)
                    size += len(part)
                    if size >= MATCHES:
                        settle(parts, rows, out)
                        parts, rows, size = [], [], 0
            settle(parts, rows, out)
            flat = [b"".join(a) for a, _ in out]
            ends = np.cumsum([0] + [len(f) // 4 for f in flat])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int64()), lists, pa.array([b"".join(b) for _, b in out], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def _decoded(path: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [np.array(i or [], "<i4").tobytes() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder(path).decode(ids), pa.binary())], names=["doc_id", "decoded"])
    return run


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded (binary: the ids turned back into bytes) of every row.

    ``path`` is a vocabulary file of ranks that every executor can open, ``pattern`` splits a
    text into words, which are encoded separately; no string is special. Null counts as empty
    and has no ids. Repeated rows give repeated rows, an empty table gives none; other columns
    of ``docs`` are not read, so their names do not matter. Null ids stay null.

    One pass without a shuffle. A task encodes the distinct words of a block by recursive
    queries, and its worker remembers up to WORDS of them (about 200 MB) for this and later
    tasks; what it holds does not grow with the input but for one text's own ids. A word beyond LONG bytes takes a step per rank that it contains,
    each over its tokens, so a text of megabytes without any break is slow, but whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coded(path, pattern), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of rows with an array of ids; a null array counts as empty."""
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(path), "doc_id long, decoded binary")


def bpe_digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
