"""Slots of shards where one id, or one row, holds a third of the table."""

import random
import zlib

from pyspark.sql import functions as F

from cohortflow.llm import common, sharding


def test_slots_of_a_hot_id(spark, monkeypatch):
    """Many texts of one id, many copies of one row, null ids beside id 0: slots as in one ordered list per shard."""
    monkeypatch.setattr(sharding, "RUN", 3)
    rng = random.Random(4)
    rows = [(7, f"text {i}") for i in range(400)] + [(9, "same")] * 401 + [(rng.randint(-50, 50), None) for _ in range(300)]
    rows += [(None, "n"), (None, None), (0, "n"), (None, "n"), (-5, ""), (-5, None)]
    rng.shuffle(rows)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(got) == len(rows)
    bucket = lambda k: ((k % (1 << 64)) * sharding.MULTIPLIER + 1) % (1 << 64) // (sharding.WRAP // sharding.BUCKETS)
    shard_of = {r.doc_id: r.shard for r in got}
    want = {}
    for i, text in rows:
        raw = (text or "").encode()
        want.setdefault(shard_of[i], []).append((bucket(i or 0), i is not None, i or 0, zlib.crc32(raw), len(raw) + 1))
    for shard, list_ in want.items():
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [(bucket(r.doc_id or 0), r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in mine] == sorted(list_)


def test_an_id_is_parted(spark):
    """A window over rows of one id holds one piece of its texts, and equal rows are one row."""
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1500).alias("text"))
    parts = docs.distinct().groupBy(F.floor(F.crc32("text") / sharding.PIECE).alias("piece")).count()
    assert parts.agg(F.max("count")).first()[0] < 30
    got = sharding.shard_documents(docs)
    assert sorted(r.slot for r in got.collect()) == list(range(3000))


def test_nested_offsets(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.randint(0, 4), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "q string, b int, f int, i int, n long")
    got = {r.i: r.start for r in common.nested_offsets(df, ["q"], "b", ["f"], ["i"], "n").collect()}
    want, upto = {}, {"a": 0, "b": 0}
    for q, _, _, i, n in sorted(rows):
        want[i] = upto[q]
        upto[q] += n
    assert got == want


def test_jump_shards_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (1, "a", 5)], "doc_id long, slots string, n int")
    got = sharding.jump_shards(df, "doc_id", 4, ["slots"]).collect()
    assert sorted((r.doc_id or 0, r.slots, r.n) for r in got) == [(0, "b", 6), (1, "a", 5), (1, "a", 5)]
    assert len({(r.shard, r.slot) for r in got}) == 3
