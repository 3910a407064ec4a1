"""A corpus from documents to packed sequences, one stored table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortflow.llm.common import pick
from cohortflow.llm.exact_dedup import exact_dedup
from cohortflow.llm.mixing import mix_sources
from cohortflow.llm.packing import pack
from cohortflow.llm.simhash import simhash_dedup
from cohortflow.llm.toxicity import score_toxicity
from cohortflow.shared import stored

#: Domains of the documents' sources; of 20 sources every second belongs to either.
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'web' ELSE 'books' END"
#: Target weights of the mixture and its share of all words; each document is drawn once at most.
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted to be toxic. One pass over the texts, nothing shuffled but counts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest id."""
    return pick(docs, exact_dedup(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest id. Rows without an id stay."""
    return pick(docs, simhash_dedup(docs).where("_null_id OR doc_id = component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that meet the target weights; the last row of a leaf is kept whole."""
    return pick(docs, mix_sources(docs, F.expr(DOMAIN), share=SHARE, epochs=1, weights=WEIGHTS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens in which sources keep their share."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("packing", pack_sequences),
]

#: SQL has no XXH64, no tokenizer and no such models: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
