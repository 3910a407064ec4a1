"""Spelling variants, token alignment and byte-level BPE against brute force and the tokenizers' own libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortflow.llm import alignment, byte_bpe, packing, queries, spelling

RANKS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "it's we'll I'M", "<|endoftext|> <s></s><unk><0x41>", "▁ low▁line ▁",
           "ﬁ①é é 中文字 \U0001F600\x00", "no" + "w" * 3000, "word " * 30_000, "İ×÷Ünïcôdé"]


@pytest.fixture(scope="module")
def strange(spark):
    """Odd texts, a repeated row, a null id and columns whose names the operators use themselves."""
    data = [(i, t) for i, t in enumerate(STRANGE)] + [(3, STRANGE[3]), (None, "lone text")]
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumns(
        {c: F.lit("clash") for c in ("word", "n", "key", "ids", "pairs", "_row", "gram", "decoded", "groups")})


# -- byte-level BPE ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_memory_forgets(monkeypatch):
    """A full memory gives the same ids as an empty one."""
    monkeypatch.setattr(byte_bpe, "WORDS", 20)
    rnd, own = random.Random(4), byte_bpe.Memory(byte_bpe.coder(RANKS))
    for _ in range(30):
        words = list({"".join(rnd.choice(" abé") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 15))})
        coded = own.own.encode([w.encode() for w in words])
        assert own.look_up(words) == [(c, w.encode()) for c, w in zip(coded, words)]
        assert len(own.new) <= 10 + 15 and len(own.old) <= 10 + 15


def numbers(ids):
    return np.frombuffer(ids, "<i4").tolist()


def test_words_like_the_library(library):
    rnd = random.Random(3)
    words = [b"", b"a", b"a" * 999, b"ab" * 300, "的一是不了人我在".encode() * 90, bytes(range(256)), b" " * 700]
    words += [bytes(rnd.choice(b"aeinrst xyz\xc3\xa9") for _ in range(rnd.choice((3, 9, 40, 300, 700)))) for _ in range(300)]
    own = byte_bpe.coder(RANKS)
    got = own.encode(words)
    assert [numbers(g) for g in got] == [library._encode_single_piece(w) if w else [] for w in words]
    assert own.decode(got) == words


def test_ranks_that_fall_again():
    """A token whose extension has a lower rank is due at once, before the next pair of its own rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ca", b"cab", b"bcab", b"ab", b"bc", b"aa", b"aaa", b"caa"]
    rnd, own = random.Random(5), byte_bpe.Coder({t: i for i, t in enumerate(tokens)})

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((own.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [own.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for size, count in ((6, 300), (30, 60), (byte_bpe.LONG + 200, 12)):
        words = [bytes(rnd.choice(b"aabc") for _ in range(size)) for _ in range(count)]
        want = [[own.ranks[w]] if w in own.ranks else plain(w) for w in words]
        assert [numbers(g) for g in own.encode(words)] == want


@pytest.mark.parametrize("matches", [1 << 19, 50])
def test_byte_bpe(strange, library, monkeypatch, matches):
    """Whole texts, also where a text fills many blocks."""
    monkeypatch.setattr(byte_bpe, "MATCHES", matches)
    coded = byte_bpe.byte_bpe(strange, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in coded.collect()}
    assert coded.count() == strange.count()
    for doc_id, text in [*enumerate(STRANGE), (None, "lone text")]:
        assert got[doc_id].ids == library.encode_ordinary(text or "") and bytes(got[doc_id].decoded) == (text or "").encode()
    back = byte_bpe.decode(coded, RANKS)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {d: bytes(r.decoded) for d, r in got.items()}
    digest = {r.doc_id: r for r in byte_bpe.bpe_digest(coded).collect()}
    assert digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and digest[0].n_tokens == 0
    assert digest[4].ids_sha256 == hashlib.sha256(",".join(map(str, got[4].ids)).encode()).hexdigest()
    assert byte_bpe.byte_bpe(strange.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                            hashlib.sha256((r.text or "").encode()).hexdigest())


# -- alignment ---------------------------------------------------------------------------------

@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
@settings(max_examples=300, deadline=None)
def test_galloping(a, b):
    x, y = (np.array(sorted(v), np.int64) for v in (a, b))
    i, j = alignment.galloping(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)


def aligned_by_hand(docs):
    """Groups and links of (doc_id, text) rows by the tokenizers' own libraries, None where there are no tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(BYTES)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of, names = packing.byte_table(), {i: t for t, i in left.get_vocab().items()}
    out = {}
    for doc_id, text in docs:
        x, y = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        xs = [bytes(byte_of[c] for c in names[i]) for i in x]
        ys = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [right.id_to_piece(i)]]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            out[doc_id] = None
            continue
        ends = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(1, len(s) + 1))) for s in (xs, ys)]
        groups, links, at = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            to = ends[0][end], ends[1][end]
            groups.append("|".join(",".join(map(str, s[a:b])) for s, a, b in zip((x, y), at, to)))
            links.append((x[to[0] - 1], y[to[1] - 1]))
            at = to
        out[doc_id] = len(x), len(y), ";".join(groups), links
    return out


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_alignment(spark, strange, limit):
    """Both ways to bring the counts to the links, on odd and on given texts."""
    docs = strange.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        (F.col("doc_id") + 1000).alias("doc_id"), "text"))
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want, count, best = aligned_by_hand(data), collections.Counter(), collections.Counter()
    for doc_id, _ in data:
        count.update(want[doc_id][3] if want[doc_id] else ())
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    got = alignment.link_statistics(docs.withColumns({c: F.lit(1) for c in ("pair", "_row", "times")}), BYTES, PIECES,
                                    digest=False, broadcast_pairs=limit).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((d is None, d) for d, _ in data)
    assert sum(v is None for v in want.values()) >= 3  # null, empty and others that the piece model does not spell out
    for r in got:
        n_a, n_b, groups, links = want[r.doc_id] or (0, 0, "", [])
        assert (r.n_a, r.n_b, r.groups, r.n_groups, r.n_links) == (n_a, n_b, groups, len(links), len(links))
        assert r.n_best == sum(count[x] == best[x[1]] for x in links) and r.count_sum == sum(count[x] for x in links)
    assert alignment.link_statistics(docs.limit(0), BYTES, PIECES, broadcast_pairs=limit).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """Parts of a long text have the pieces of the whole."""
    encode, _ = alignment.pieces(PIECES)
    text = "a word  and two spaces ▁ low line ▁x end. " * 200 + "中文 字 " * 100
    whole = encode([text])[0].tolist()
    for part in (1, 7, 100):
        monkeypatch.setattr(alignment, "PART", part)
        assert encode([text])[0].tolist() == whole


# -- spelling variants -------------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(words):
    found = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        top = min(close, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 2 * n else None
        found[w] = form, n, len(close), words.get(form)
    rows = []
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=repr)


def dense_words(rnd, letters, sizes, number):
    return {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))): rnd.choice((3, 4, 5, 9, 20, 70)) for _ in range(number)}


@pytest.mark.parametrize("letters,sizes,frequent,limit", [
    ("ab", (5, 6, 7, 8), 2, 256), ("ab", (5, 6, 7, 8, 9), 2, 3), ("abcdé", (5, 6, 7), 64, 256), ("abÿ", (8, 9, 10, 11, 12, 13), 1, 5),
    ("abcdefgh", (5, 6), 4, 1)])
def test_variants(spark, monkeypatch, letters, sizes, frequent, limit):
    """All pairs, with grams extended early or late and lists judged either way."""
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    words = dense_words(random.Random(len(letters) + limit), letters, sizes, 500)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = spelling.group_variants(df, limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == variants_by_hand(words)


def test_affected_bound():
    """No edit changes more grams than the bound says, and some grams always remain."""
    rnd = random.Random(9)
    frequent = frozenset("".join(rnd.choice("ab") for _ in range(rnd.choice((2, 3, 4)))) for _ in range(12))
    for _ in range(400):
        word = "".join(rnd.choice("ab") for _ in range(rnd.choice(range(5, 15))))
        for grows in (False, True):
            longest = spelling.longest_gram(len(word) + grows)
            ends = spelling.decompose(word, frequent, longest)
            bound = spelling.affected(word, ends, frequent, longest, grows)
            assert len(ends) > bound
            at = rnd.randrange(len(word) + grows)
            other = word[:at] + rnd.choice("abc") + word[at + (not grows):]
            theirs = spelling.decompose(other, frequent, longest)
            kept = sum((b, e) in set(enumerate(theirs)) and word[b:e] == other[b:e] and e <= at for b, e in enumerate(ends))
            shift = len(other) - len(word)
            kept += sum((b + shift, e + shift) in set(enumerate(theirs)) and b >= at + (not grows) for b, e in enumerate(ends))
            assert len(ends) - kept <= bound


def words_by_hand(docs, every=97):
    total = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_spelling_of_documents(spark, strange):
    docs = strange.select("doc_id", "text", "gram", "key", "n", "word").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", *(F.lit("x").alias(c) for c in ("gram", "key", "n", "word"))))
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for every in (97, 5):
        words = {r.word: r.n for r in spelling.count_words(docs, every=every).collect()}
        assert words == words_by_hand(data, every)
    common = dict(sorted(words_by_hand(data, 5).items(), key=lambda x: (-x[1], x[0]))[:700])
    got = spelling.group_variants(spark.createDataFrame(list(common.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=repr) == variants_by_hand(common)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where("text IS NULL")).count() == 0
