"""Shards by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import nested_offsets

#: Fixed values of the published algorithm: the multiplier of its generator and 2**64.
MULTIPLIER, WRAP = 2862933555777941757, 18446744073709551616
#: Slots of a shard are counted in this many independent pieces.
BUCKETS = 4096
#: The texts of one key are counted in up to 256 pieces, by the first bits of their CRC.
PIECE = 1 << 24
#: Equal rows are written out in runs of this many slots.
RUN = 65536


def _decimal(value) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _next(key: Column) -> Column:
    """Next state of the 64-bit linear congruential generator; decimals do not overflow."""
    return ((key * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1)).cast(
        "decimal(38,0)") % F.lit(str(WRAP)).cast("decimal(20,0)")


def first_state(key: Column) -> Column:
    """Generator state of a long key, as an unsigned number."""
    wide = key.cast("decimal(20,0)")
    return F.when(wide < 0, wide + _decimal(WRAP)).otherwise(wide).cast("decimal(20,0)")


def jump_points(key: Column, shards: int) -> Column:
    """Shards that the key has as their number grows from 1 to ``shards``, each once, rising."""
    start = F.struct(_next(first_state(key)).cast("decimal(20,0)").alias("state"),
                     F.array(F.lit(0)).alias("points"), F.lit(False).alias("over"))

    def step(acc, _):
        last = F.element_at(acc["points"], -1)
        drawn = F.floor(acc["state"] / F.lit(str(1 << 33)).cast("decimal(20,0)")).cast("double") + 1.0
        jump = F.floor((last.cast("double") + 1.0) * (F.lit(2147483648.0) / drawn))
        over = acc["over"] | (jump >= shards)
        return F.struct(
            _next(acc["state"]).cast("decimal(20,0)").alias("state"),
            F.when(over, acc["points"]).otherwise(F.concat(acc["points"], F.array(jump.cast("int")))).alias("points"),
            over.alias("over"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["points"])


def jump_shards(df: DataFrame, key: str, shards: int, order: list[str], shard: str = "shard",
                slot: str = "slot", grown: str = "grown_shard", buckets: int = BUCKETS,
                piece: Column | None = None, amount: str | None = None) -> DataFrame:
    """Add ``shard`` (0 to shards - 1), a gapless ``slot`` in it and ``grown``, the shard among shards + 1.

    The long ``key`` and the number of shards decide; a null key counts as 0. One more
    shard takes rows into itself and moves no others. ``order`` breaks ties of one key;
    ``piece``, a number that must not fall along it, says where the rows of one key may be
    parted. A row takes ``amount`` slots, from ``slot`` on, else one.
    Shards are uneven by chance only, but any share of the rows may have one key; slots are
    counted per (shard, bucket of the generator's first state, key, piece), with bases from
    pre-aggregated counts, so neither a shard, nor a key in pieces, nor the table meets in one task.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    points = df.withColumn("_points", jump_points(own, shards + 1))
    bucket = F.floor(_next(first_state(own)) / F.lit(str(WRAP // buckets)).cast("decimal(20,0)")).cast("int")
    placed = points.withColumns({
        grown: F.element_at("_points", -1), "_bucket": bucket, "_known": F.col(key).isNotNull(), "_own": own,
        "_piece": F.coalesce((F.lit(0) if piece is None else piece).cast("int"), F.lit(-1)),
        "_slots": (F.lit(1) if amount is None else F.col(amount)).cast("long"),
        shard: F.when(F.element_at("_points", -1) < shards, F.element_at("_points", -1)).otherwise(
            F.element_at("_points", -2))}).drop("_points")
    return nested_offsets(placed, [shard], "_bucket", ["_known", "_own", "_piece"], order, "_slots", slot).drop(
        "_bucket", "_known", "_own", "_piece", "_slots")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: id and number of shards decide. ``size`` is the text's UTF-8 bytes
    plus 1; a null text has none and the CRC 0. Rows with a null id are placed like id 0,
    before its rows; repeated rows share a shard and have slots of their own. Other columns of
    ``docs`` are not read; an empty table gives an empty one.

    Rows of equal id, CRC and size are counted before the shuffle and take their slots as one
    run, so an id or a row that is a third of the table is neither sorted nor held in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    placed = jump_shards(equal, "doc_id", shards, ["text_crc32", "size"], piece=F.floor(F.col("text_crc32") / PIECE), amount="_n")
    # in two steps: one sequence over all copies would be an array that grows with them
    runs = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, F.col("_n")) - 1)))
    return each.withColumn("slot", F.col("slot") + F.col("_i")).drop("_n", "_from", "_i")
