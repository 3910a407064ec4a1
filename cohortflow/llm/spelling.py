"""Spelling variants by a variable-length gram index."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Powers, mix, stored, text_bytes

#: Lengths of grams; how long they may get in short words is ``longest_gram``.
SHORTEST, LONGEST = 2, 6
#: A gram is extended where more words than this have it; more than a share of all grams also.
FREQUENT, SHARE = 64, 1 << 15
#: Lists of up to this many words are compared pair by pair; longer ones by deleted characters.
LIST_ROWS = 256

#: Fixed value: what the contract takes as a word.
RUN = "[A-Za-zÀ-ÿ]+"
_POWERS = Powers(0x9E6C63D0876A9A47 | 1)


# -- words -------------------------------------------------------------------------------------

def _counted(every: int, shortest: int):
    """(word, n) of a batch; of each document's runs the few that slip are moved to their misspelt word."""
    def run(batches):
        import pyarrow as pa

        find, crc = re.compile(RUN).findall, zlib.crc32
        for batch in batches:
            total: Counter = Counter()
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                runs = find(raw.lower().decode())  # bytes are lower-cased in A-Z only
                total.update(runs)
                head = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for word in [r for r in set(runs) if not crc(r.encode(), head) % every]:
                    n, at = runs.count(word), crc(word.encode(), head) % len(word)
                    total[word] -= n
                    total[word[:at] + word[at + 1:]] += n
            words = [w for w, n in total.items() if n and len(w) >= shortest]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97,
                shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of all words with ``shortest`` code points and ``least`` occurrences; summed per batch before the shuffle."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(every, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- grams -------------------------------------------------------------------------------------

def longest_gram(size: int) -> int:
    """Greatest gram length where the longer word of a pair has ``size`` code points: it leaves grams beside any edit."""
    return max(SHORTEST, min(LONGEST, (size - 1) // 2))


def _pieces(batches):
    """Grams of fixed lengths of a batch and in how many places they are."""
    import pyarrow as pa

    for batch in batches:
        words = batch.column(0).to_pylist()
        total: Counter = Counter()
        for q in range(SHORTEST, LONGEST):
            total.update(w[i:i + q] for w in words for i in range(len(w) - q + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])


def gram_dictionary(words: DataFrame) -> frozenset[str]:
    """Grams of SHORTEST to LONGEST - 1 code points that are frequent, and so extended: the inner nodes of the gram tree.

    The tree is pruned below every gram that FREQUENT places or fewer have, or fewer than one
    in SHARE of all: so at most SHARE grams of each length are kept, whatever the number of
    words, which bounds what is collected and broadcast.
    """
    grams = stored(words.select("word").mapInArrow(_pieces, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.where(F.length("gram") == SHORTEST).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return frozenset(r.gram for r in grams.where(F.col("n") > max(FREQUENT, total // SHARE)).toLocalIterator())


def decompose(word: str, frequent: frozenset[str], longest: int) -> list[int]:
    """End of the gram that begins at each place: it grows while it is frequent, up to ``longest`` and the end of the word."""
    n, ends = len(word), []
    for begin in range(n - SHORTEST + 1):
        end, most = begin + SHORTEST, min(begin + longest, n)
        while end < most and word[begin:end] in frequent:
            end += 1
        ends.append(end)
    return ends


def affected(word: str, ends: list[int], frequent: frozenset[str], longest: int, grows: bool) -> int:
    """The most grams that one edit can change: the affected-gram bound of the word.

    A gram depends on its own code points only, and on the end of the word where it was cut
    off there. A deleted or replaced code point changes the grams over it; where the partner
    is longer (``grows``), an insertion changes those on both sides of its place.
    """
    n = len(word)
    change = [0] * (n + 2)
    for begin, end in enumerate(ends):
        change[begin + grows] += 1
        change[end] -= 1
    most = total = 0
    for x in change[:n + 1]:
        total += x
        most = max(most, total)
    if grows:
        most = max(most, sum(end == n and end - begin < longest and word[begin:end] in frequent for begin, end in enumerate(ends)))
    return most


_INDEX = "word string, size int, grows boolean, need int, gram long, begin int, end int"


def _grams(given):
    """Grams of each word, once for partners of its length or less and once for partners longer by one."""
    def run(batches):
        import pyarrow as pa

        frequent = given.value
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                n = len(word)
                for grows in (False, True):
                    longest = longest_gram(n + grows)
                    ends = decompose(word, frequent, longest)
                    need = affected(word, ends, frequent, longest, grows) + 1
                    for begin, end in enumerate(ends):
                        name = zlib.crc32(word[begin:end].encode()) << 24 | (end - begin) << 21 | (n + grows) & 0x1FFFFF  # any order will do
                        out.append((word, n + grows, grows, need, name, begin, end))
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=["word", "size", "grows", "need", "gram", "begin", "end"])
    return run


def gram_lists(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """(key, word, grows): the lists that each word must be sought in, and is entered in.

    Words one edit apart share all grams but those the edit affects. So the rarest ``need``
    grams of both (one more than the affected-gram bound) have one in common; only these are
    kept. The edit lies behind the shared gram or before it: so the words agree up to the
    gram's end or from its beginning on, and a gram has a list for each text before it and
    one for each text behind it, among words of one length (and those shorter by one).
    """
    given = words.sparkSession.sparkContext.broadcast(frequent)
    index = stored(words.select("word").mapInArrow(_grams(given), _INDEX), "gram-index")
    lists = index.groupBy("gram").agg(F.count("*").alias("_rows"))
    ranked = index.join(lists, "gram").groupBy("word", "size", "grows").agg(
        F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("_rows", "gram", "begin", "end"))).alias("g"))
    kept = ranked.select("word", "size", "grows", F.explode(F.slice("g", F.lit(1), F.col("need"))).alias("g"))
    upto, onward = F.substring("word", F.lit(1), F.col("g.end")), F.substring("word", F.col("g.begin") + 1, F.length("word"))
    return kept.select("word", "grows", F.explode(F.array(
        F.xxhash64("size", F.lit(0), upto), F.xxhash64("size", F.lit(1), onward))).alias("key")).distinct()


# -- pairs -------------------------------------------------------------------------------------

def _deletions(batches):
    """Hashes of the word and of the word without each code point, for words of lists too long to compare pair by pair."""
    import pyarrow as pa

    for batch in batches:
        words, grows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list = []
        for word, grown in zip(words, grows, strict=True):
            code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            powers = _POWERS.grow(len(code) + 1)
            with np.errstate(over="ignore"):
                left = np.r_[np.uint64(0), np.cumsum(code * powers.up[:len(code)])]
                if grown:
                    out.append((word, np.zeros(1, np.int32), mix(left[-1:]).view(np.int64)))
                    continue
                # behind the deleted code point everything moves by one place
                right = (left[-1] - left[1:]) * np.uint64(_POWERS.inverse)
                out.append((word, np.arange(len(code), dtype=np.int32), mix(left[:-1] + right).view(np.int64)))
        sizes = [len(h) for _, _, h in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _, _ in out]).take(pa.array(np.repeat(np.arange(len(out)), sizes))),
             pa.array(np.repeat(np.array(grows, bool), sizes)),
             pa.array(np.concatenate([p for _, p, _ in out]) if out else np.zeros(0, np.int32)),
             pa.array(np.concatenate([h for _, _, h in out]) if out else np.zeros(0, np.int64))], names=["word", "grows", "at", "rest"])


def crowded_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among the words of crowded lists, which no task sees whole.

    Words of one length differ in one place if they agree without it; a longer word has the
    shorter one among its deletions. Such groups hold an alphabet of words at most.
    """
    found = rows.select("word", "grows").distinct().mapInArrow(_deletions, "word string, grows boolean, at int, rest long")
    found = stored(found, "deletions")
    full, less = found.where("NOT grows"), found.where("grows").select(F.col("word").alias("b"), "rest")
    same = full.select(F.col("word").alias("a"), "at", "rest").join(full.select(F.col("word").alias("b"), "at", "rest"), ["at", "rest"]).where("a < b")
    other = full.select(F.col("word").alias("a"), "rest").join(less, "rest")
    return same.select("a", "b").unionByName(other.select("a", "b"))


def near_words(words: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(word, near) for all pairs of words that differ by one inserted, deleted or replaced code point, in both orders.

    ``words`` has distinct words of five code points or more. Candidates come from the
    variable-length gram index (``gram_lists``) and are verified by their edit distance. Lists
    of more than ``list_rows`` words are not compared pair by pair but by ``crowded_pairs``.
    """
    lists = stored(gram_lists(words, gram_dictionary(words)), "gram-lists")
    crowded = stored(lists.groupBy("key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > list_rows).select("key"), "crowded-lists")
    some = not crowded.isEmpty()
    few = lists.join(crowded, "key", "left_anti") if some else lists
    left = few.where("NOT grows").select("key", F.col("word").alias("a"))
    right = few.select("key", "grows", F.col("word").alias("b"))
    pairs = left.join(right, "key").where(
        (F.col("grows") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    if some:
        hot = crowded_pairs(lists.join(crowded, "key", "left_semi"))
        pairs = pairs.unionByName(hot.where(F.levenshtein("a", "b", 1) == 1))
    pairs = stored(pairs.distinct(), "near-words")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))


def group_variants(words: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n; words distinct).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is
    at least twice its own n. The count at least doubles from form to form, so the root is
    found by doubling the paths, in a round for each bit of the longest one.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words, list_rows).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    follows = -F.col("best.m") >= 2 * F.col("n")
    forms = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"),
        F.when(follows, -F.col("best.m")).alias("form_n")), "forms")
    paths = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "paths")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        paths = stored(paths.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "paths")
        if paths.where("_moved").isEmpty():
            break
        paths = paths.drop("_moved")
    return forms.join(paths.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97,
                      list_rows: int = LIST_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of a corpus (``count_words``, ``group_variants``).

    Null texts have no words; a null id counts as an empty one; repeated rows count again. An
    empty table, or one without a word often enough, gives no rows. Other columns are not read.
    """
    return group_variants(count_words(docs, id_col, text_col, every), list_rows)
