"""The corpus pipeline: what an operator of ``brindle.llm`` decides about documents, stage after stage.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, language_id, minhash, packing, suffix_dedup
from brindle.llm.queries import vocabulary
from brindle.plans.recovery import delete, shared_path
from brindle.plans.tables import table

#: A document is rejected if it has no letters, or if less than this share of its n-grams is of the best language, counted with so many more that are.
LEAST_SCORE, PRIOR = 0.1, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those in no learned language, go; ``lang`` becomes the prediction. The shorter a text, the less its n-grams prove."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    judged = language_id.identify(docs.toDF(*names.values()), names["doc_id"], names["text"], names["lang"], keep=list(names.values()))
    share = (F.col("_score") * F.col("_n_grams") + PRIOR) / (F.col("_n_grams") + PRIOR)
    kept = judged.filter((F.col("_lang_pred") != "und") & (share >= LEAST_SCORE))
    return kept.select(*[F.col("_lang_pred" if c == "lang" else own).alias(c) for c, own in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, similarity 0.8) stays."""
    return minhash.deduplicate(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string of a document with a smaller id go; ``n_chars`` follows the text."""
    left = suffix_dedup.remove(docs)
    return left.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also one with other parameters, go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages (a learned model, hashing, token ids); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
