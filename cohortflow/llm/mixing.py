"""Mixing sources to target weights: budgets down a domain-language-source tree, prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import identity, queue_offsets

#: Up to this many leaves the plan is broadcast; a larger plan is joined by its keys.
BROADCAST_LEAVES = 10_000
#: White space that separates tokens where no other count is given.
WORD = r"[^ \t\n\x0B\f\r]+"
TREE = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fill(nodes: DataFrame, parent: list[str], key: str, budget: str, out: str = "alloc") -> DataFrame:
    """Share the ``budget`` of each parent among its children by ``weight``, none above ``cap``.

    What a full child cannot take goes to its siblings by weight. Children are ordered by
    cap / weight: full ones come first, and the first that is not full fixes the level of the
    rest. Whole numbers throughout; rounding down loses less than one token a child.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), key)
    before, family = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    ranked = nodes.withColumns({
        "_rank": F.row_number().over(order),
        "_left": F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "_open": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    short = ranked.withColumn("_first", F.min(F.when(wide("cap", "_open") > wide("weight", "_left"), F.col("_rank"))).over(family))
    level = short.withColumn("_at", F.max(F.when(F.col("_rank") == F.col("_first"), F.struct("_left", "_open"))).over(family))
    share = F.expr("cast(weight as decimal(19,0)) * cast(_at._left as decimal(19,0)) div _at._open")
    return level.withColumn(out, F.when(F.col("_rank") >= F.col("_first"), share).otherwise(F.col("cap")).cast("long")).drop(
        "_rank", "_left", "_open", "_first", "_at")


def plan_mix(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """Quota of tokens per leaf.

    ``leaves`` has the columns of TREE, ``tokens`` and the weights w_domain, w_lang and
    w_source (positive whole numbers; those of a node must agree in all its leaves). A leaf
    holds ``epochs`` times its tokens. Shortages go to siblings first: a node passes on only
    what all leaves below it cannot take.
    """
    leaf = leaves.withColumn("cap", F.col("tokens") * epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight"),
                                              F.max("w_domain").alias("w_domain"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"))
    top = domain.withColumn("_all", F.least(F.sum("cap").over(Window.partitionBy()), budget.cast("long")))
    domain = fill(top, [], "domain", "_all", "domain_quota").select("domain", "domain_quota")
    lang = fill(lang.join(domain, "domain"), ["domain"], "lang", "domain_quota", "lang_quota").select("domain", "lang", "lang_quota")
    leaf = leaf.withColumn("weight", F.col("w_source")).join(lang, ["domain", "lang"])
    return fill(leaf, ["domain", "lang"], "source", "lang_quota", "quota").select(*TREE, "tokens", "quota")


def mix_sources(docs: DataFrame, domain: Column, share: float = 0.75, epochs: int = 2, seed: int = 7,
                weights: dict[str, dict[str, int]] | None = None, tokens: Column | None = None,
                id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """Rows drawn to meet the target weights, once per epoch drawn in.

    The budget is ``share`` of all tokens (words unless ``tokens`` counts otherwise);
    ``weights`` maps the levels of TREE to weights by name, 1 where not named. Returns
    doc_id, domain, lang, source, epoch, tokens, start (tokens of the leaf's epoch before
    the row), taken (the tokens within the quota: all but for the last row of a leaf) and
    the identity columns. An epoch orders a leaf by MD5 of seed, epoch and id; a leaf takes
    whole epochs and then a prefix of one more. Null domains, languages and sources are
    named ``(none)``; a null text has no tokens; rows without tokens are drawn where the
    prefix reaches them. Repeated rows are rows of their own.

    Only leaf totals are gathered before the plan. Running sums go through buckets of the
    MD5, so a leaf with any share of the rows is spread over many tasks.
    """
    named = {"domain": domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("(none)")).alias(k) for k, c in named.items()),
        (word_count(F.col(text_col)) if tokens is None else tokens).cast("long").alias("tokens"),
        *(c.alias(k) for k, c in identity(id_col, text_col).items()))
    leaves = rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    for level in TREE:
        weight = F.lit(1).cast("long")
        for name, value in sorted(((weights or {}).get(level) or {}).items()):
            weight = F.when(F.col(level) == name, F.lit(value).cast("long")).otherwise(weight)
        leaves = leaves.withColumn(f"w_{level}", weight)
    total = leaves.agg(F.sum("tokens").alias("_total"))
    plan = plan_mix(leaves, F.floor(F.lit(share) * F.coalesce(total.scalar(), F.lit(0))), epochs)
    plan = plan.withColumnRenamed("tokens", "leaf_tokens").where("quota > 0")
    few = plan.count() <= BROADCAST_LEAVES
    drawn = rows.join(F.broadcast(plan) if few else plan, list(TREE)).withColumn("epoch", F.explode(F.expr(
        "sequence(0, cast((quota + leaf_tokens - 1) div leaf_tokens as int) - 1)")))
    drawn = drawn.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    drawn = queue_offsets(drawn.withColumn("_bucket", F.substring("_order", 1, 3)), [*TREE, "epoch"], "_bucket",
                          ["_order", "doc_id", "tokens", "_text_key"], "tokens")
    left = F.col("quota") - F.col("epoch") * F.col("leaf_tokens") - F.col("start")
    return drawn.where(left > 0).select("doc_id", *TREE, "epoch", "tokens", "start",
                                        F.least("tokens", left).alias("taken"), "_id", "_null_id", "_text_key")
