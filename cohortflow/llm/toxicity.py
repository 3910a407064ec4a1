"""Toxicity by class-conditional Kneser-Ney models over words with a shared backoff."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Powers, blocks, mix, small_batches, stored, text_bytes

#: Words with a ratio up to this many are broadcast; more are joined to each document's words by their keys.
BROADCAST_WORDS = 1 << 20
#: Share of each class's probability that goes to the shared backoff.
BACKOFF = 0.5
#: Documents taken off a word's count in the toxic class; scaled by class size in the other.
DISCOUNT = 1.0
#: Training rows that the final calibration is fitted on, about, at most.
CALIBRATION_ROWS = 20_000

_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_POWERS = Powers(0x9E3779B97F4A7C15 | 1)


def word_cells(texts: list[bytes]):
    """(text number, 64-bit hash) of every word of the texts: runs of ASCII letters and digits, A-Z lower-cased, or bytes beyond ASCII."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = _WORD_BYTE[raw].astype(np.int8)
    edges = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers = _POWERS.grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[:len(raw)])))
        codes = (sums[ends] - sums[starts]) * powers.down[starts]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.searchsorted(firsts, starts, side="right") - 1, mix(codes).view(np.int64)


def _squeezed(batches):
    """(doc_id, text) with the text compressed: of the rows joined to labels most are not labelled."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([zlib.compress(t, 1) for t in text_bytes(batch.column(1))], pa.binary())], names=["doc_id", "text"])


def _counted(batches, labelled: bool):
    """Documents of each class that have a word, summed over each block of texts."""
    import pyarrow as pa

    for batch in batches:
        texts = [zlib.decompress(t) for t in batch.column(0).to_pylist()] if labelled else text_bytes(batch.column(0))
        kinds = batch.column(1).to_numpy() if labelled else np.full(len(texts), -1)
        for a, b in blocks(texts):
            doc, word = word_cells(texts[a:b])
            words, at = np.unique(word, return_inverse=True)
            if not len(words):
                continue
            once = np.unique(doc * len(words) + at)
            kind, at = kinds[a:b][once // len(words)], once % len(words)
            counts = [pa.array(np.bincount(at[kind == k], minlength=len(words))) for k in (-1, 0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(words), *counts], names=["word", "n", "c0", "c1"])


def document_counts(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """(word, n, c0, c1): documents with the word in ``texts`` and in both classes of ``labelled``.

    ``texts`` has (text), ``labelled`` has (compressed text, class). Every distinct word has
    a row of its own, so the table grows with the vocabulary. Sums are combined before the
    shuffle; nothing is collected.
    """
    schema = "word long, n long, c0 long, c1 long"
    parts = texts.mapInArrow(lambda b: _counted(b, False), schema).unionByName(
        labelled.mapInArrow(lambda b: _counted(b, True), schema))
    return stored(parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "c0", "c1"))), "word-counts")


class Models:
    """Kneser-Ney models of the ordinary (0) and the toxic class (1) over a table of ``document_counts``.

    The contexts of a word are the documents it occurs in. A class's model discounts the
    number of its documents with the word and gives a fixed share of its mass to the backoff,
    which is shared: contexts in the whole corpus, labelled or not. Discounts take the same
    share of documents in both classes, so a word that is rare in the smaller class falls
    back to the same probability in both and says nothing. Only totals are held here.
    """

    def __init__(self, words: DataFrame):
        total = words.agg(F.count("*").alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "c0", "c1"))).first()
        size = np.maximum(np.array([total.c0, total.c1]), 1)
        self.discount = DISCOUNT * size / size[1]
        over = [F.greatest(F.col(f"c{c}") - F.lit(float(self.discount[c])), F.lit(0.0)) for c in (0, 1)]
        mass = words.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in over)).first()
        self.mass = np.maximum(np.array(mass, float), 1.0)
        self.shared = total.n + 0.5 * total.words

    def ratio(self, n: np.ndarray, counts: tuple[np.ndarray, np.ndarray], own: int | None = None) -> np.ndarray:
        """Log-likelihood ratio of words, toxic to ordinary; ``own`` is the class whose counts hold the text itself."""
        backoff = BACKOFF * (n + 0.5) / self.shared
        logs = [np.log((1 - BACKOFF) * np.maximum(
            counts[c] - (own == c) - self.discount[c], 0) / self.mass[c] + backoff) for c in (0, 1)]
        return logs[1] - logs[0]

    def ratios(self, words: DataFrame) -> DataFrame:
        """(word, ratio, ratio0, ratio1) of the words with a ratio, and with a text of either class left out.

        A word whose discounted count is zero in both classes has the shared backoff in both:
        its ratio is exactly zero, with or without its own text, so it needs no row.
        """
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                word, n, c0, c1 = (c.to_numpy() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word), *(pa.array(self.ratio(n, (c0, c1), own)) for own in (None, 0, 1))],
                    names=["word", "ratio", "ratio0", "ratio1"])

        over = (F.col("c0") > F.lit(float(self.discount[0]))) | (F.col("c1") > F.lit(float(self.discount[1])))
        return words.where(over).mapInArrow(run, "word long, ratio double, ratio0 double, ratio1 double")


def terms(ratio: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is summed over the words of a text: ratios, ratios beyond one nat, words beyond two nats."""
    return ratio, np.maximum(ratio - 1, 0), (ratio > 2).astype(float)


def looked_up(table: tuple[np.ndarray, np.ndarray], word: np.ndarray) -> np.ndarray:
    """Ratio of each word by a sorted table of (words, ratios); zero where it is not in the table."""
    words, ratios = table
    if not len(words):
        return np.zeros(len(word))
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    return np.where(words[at] == word, ratios[at], 0.0)


def joined_sums(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(_row, _s0, _s1, _s2): ``terms`` summed over the words of each text, for rows that have a word of ``ratios``.

    ``rows`` has (_row, text, own), own being the class whose counts hold the text, or null.
    Distinct words of a text meet their ratios by a join, so no task holds the vocabulary.
    """
    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            texts, ids, own = text_bytes(batch.column(1)), batch.column(0).to_numpy(), batch.column(2)
            for a, b in blocks(texts):
                doc, word = word_cells(texts[a:b])
                words, at = np.unique(word, return_inverse=True)
                if not len(words):
                    continue
                once, times = np.unique(doc * len(words) + at, return_counts=True)
                doc = once // len(words) + a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), own.take(pa.array(doc)), pa.array(words[once % len(words)]), pa.array(times)],
                    names=["_row", "own", "word", "times"])

    pairs = rows.select("_row", "text", "own").mapInArrow(spread, "_row long, own long, word long, times long")
    ratio = F.when(F.col("own") == 0, F.col("ratio0")).when(F.col("own") == 1, F.col("ratio1")).otherwise(F.col("ratio"))
    met = pairs.join(ratios.hint("merge"), "word").select("_row", "times", ratio.alias("r"))
    return met.groupBy("_row").agg(
        F.sum(F.col("times") * F.col("r")).alias("_s0"),
        F.sum(F.col("times") * F.greatest(F.col("r") - 1, F.lit(0.0))).alias("_s1"),
        F.sum(F.when(F.col("r") > 2, F.col("times")).otherwise(0).cast("double")).alias("_s2"))


#: Features of a text: mean ratio, mean ratio beyond one nat, share of words beyond two nats, and these by length.
N_FEATURES = 6


def features(words: np.ndarray, sums) -> np.ndarray:
    """(n, N_FEATURES): length-normalised comparisons of the two log-likelihoods, from words and summed ``terms`` of each text."""
    all_, clear, strong = (x / np.maximum(words, 1) for x in sums)
    return np.stack([all_, clear, strong, np.log1p(words), clear * np.sqrt(words), strong * np.sqrt(words)], axis=1)


def text_features(texts: list[bytes], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``features`` of texts by a table of ratios held in memory."""
    doc, word = word_cells(texts)
    n = len(texts)
    return features(np.bincount(doc, minlength=n), [np.bincount(doc, x, minlength=n) for x in terms(looked_up(table, word))])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1):
    """(centre, scale, weights) of a logistic curve over the features, by Newton steps."""
    if not len(y) or y.min() == y.max():
        # without both classes nothing can be told apart: every score is one half
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z, w = np.c_[np.ones(len(x)), (x - centre) / scale], np.zeros(N_FEATURES + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``row`` (all columns of a row of ``docs``), held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    The row is carried as one struct, so its column names do not matter. Only the text is scored; null counts as empty, and texts without words get the score of
    empty evidence. Labels are read for rows that are not held out; of several labels of an
    id the largest counts, null labels count as none. Repeated rows and null ids are scored.
    Without training rows of both classes every score is 0.5. An empty table gives no rows.

    Labels grow with the corpus: they are joined by a shuffle at every size, never broadcast.
    Class counts cover all training rows and backoff counts all rows, by word, in a table
    that grows with the vocabulary. The calibration is fitted on about CALIBRATION_ROWS
    different training rows, drawn by a hash of id and text whatever the number of rows of an
    id, and scored without their own counts. Words with a ratio other than zero are
    broadcast up to BROADCAST_WORDS, and scoring is then one pass without a shuffle; where
    there are more, the distinct words of each document are joined to them instead. The
    session's Arrow batches are made smaller (``small_batches``).
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("class")).where(
        F.col("class").isin(0, 1)).groupBy("doc_id").agg(F.max("class").alias("class"))
    marks = marks.where(~held_out(F.col("doc_id")))
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    squeezed = lambda df: df.mapInArrow(_squeezed, "doc_id long, text binary").join(
        marks.hint("merge"), "doc_id")
    words = document_counts(docs.select(text), squeezed(train).select("text", "class"))
    models = Models(words)
    ratios = stored(models.ratios(words), "word-ratios")
    few = ratios.count() <= BROADCAST_WORDS

    keys = train.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"))
    n = keys.join(marks.hint("merge"), "doc_id", "left_semi").distinct().count()
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, CALIBRATION_ROWS / max(n, 1)))
    examples = squeezed(train.where(chosen)).dropDuplicates(["doc_id", "text"]).select("text", "class")
    if few:
        held = ratios.toArrow().sort_by("word")
        given = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in held.columns))

        def measured(batches):
            import pyarrow as pa

            for batch in batches:
                rows = [text_features([zlib.decompress(t)], (given.value[0], given.value[2 + k]))[0].tolist()
                        for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "class"])

        got = examples.mapInArrow(measured, "x array<double>, class long").toPandas()
    else:
        def opened(batches):
            import pyarrow as pa

            for batch in batches:
                texts = [zlib.decompress(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column(1)], names=["text", "own"])

        chosen_rows = stored(examples.mapInArrow(opened, "text binary, own long").withColumn(
            "_row", F.monotonically_increasing_id()), "examples")

        def measured(batches):
            import pyarrow as pa

            for batch in batches:
                x = _summed_features(text_bytes(batch.column(0)), batch, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "class"])

        got = _with_sums(chosen_rows, joined_sums(chosen_rows, ratios)).select("text", "own", "_s0", "_s1", "_s2").mapInArrow(
            measured, "x array<double>, class long").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T)
    curve = calibrate(x[order], got["class"].to_numpy(float)[order])

    row = T.StructField("row", T.StructType(docs.schema.fields), False)
    schema = T.StructType([row, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def scored(batches, of_block):
        import pyarrow as pa

        centre, scale, weights = curve
        for batch in batches:
            texts, out = text_bytes(batch.column(2)), []
            for a, b in blocks(texts):
                z = (of_block(texts[a:b], batch.slice(a, b - a)) - centre) / scale
                out.append(1 / (1 + np.exp(-np.clip(weights[0] + z @ weights[1:], -30, 30))))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:2] + [pa.array(np.concatenate(out) if out else np.zeros(0))], names=schema.names)

    given_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(given_row, held_out(F.col(id_col)).alias("held_out"), text)
    if few:
        out = rows.mapInArrow(lambda bs: scored(bs, lambda texts, _: text_features(texts, given.value[:2])), schema)
    else:
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "documents")
        sums = joined_sums(rows.select("_row", "text", F.lit(None).cast("long").alias("own")), ratios)
        rows = _with_sums(rows, sums).select("row", "held_out", "text", "_s0", "_s1", "_s2")
        out = rows.mapInArrow(lambda bs: scored(bs, lambda texts, part: _summed_features(texts, part, 3)), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _with_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` with their sums, zero where no word of a row has a ratio."""
    return rows.join(sums, "_row", "left").fillna(0.0, ["_s0", "_s1", "_s2"])


def _summed_features(texts: list[bytes], batch, first: int) -> np.ndarray:
    """``features`` of texts whose sums are three columns of the batch from ``first`` on."""
    doc, _ = word_cells(texts)
    return features(np.bincount(doc, minlength=len(texts)), [batch.column(first + k).to_numpy() for k in range(3)])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, see ``score_toxicity``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    return score_toxicity(own, marks, threshold=threshold).select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")
