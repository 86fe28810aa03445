"""A training corpus from raw documents: language, exact and near duplicates, secrets, packing.

Every stage works on all that the one before kept; it is written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflow.llm import bloom, exact_dedup, language, near_dedup, packing, secrets
from wayflow.llm.batches import free_name
from wayflow.llm.queries import table, tokenizer_path
from wayflow.storage import save

#: Texts farther than this from every language learned (out-of-place distance, at most 1) are rejected, as are those without a letter.
MOST_DISTANCE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every learned language; all others stay as they are.

    A null or empty text goes. Repeated rows and ids, null ids and further columns pass through. An empty table stays empty.
    """
    lang, score, distance = (free_name(docs, x) for x in ("found_lang", "found_score", "found_distance"))
    found = language.identify(docs, language.learn(docs), out=(lang, score, distance))
    return found.where((F.col(lang) != "und") & (F.col(distance) <= MOST_DISTANCE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; a null id is the smallest, of equal ids one row stays. An empty table stays empty."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Only documents that a Bloom filter of the dropped ids lets through meet those ids in a join. Documents without words or with a null id
    stay, rows that share an id stay or go together. Further columns pass through, whatever their names. An empty table stays empty.
    """
    dropped = near_dedup.near_duplicates(docs).where("not kept and component_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    dropped = save(dropped, "dropped")
    words = bloom.words_for(dropped.count())
    bits = save(bloom.members(dropped, F.xxhash64("gone"), words), "bloom")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    marked = bloom.probe(rows, F.xxhash64("id"), words, bits, "maybe")
    checked = marked.where("maybe").join(dropped, F.col("id") == F.col("gone"), "left_anti")
    return marked.where("not maybe").select("row").unionByName(checked.select("row")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, null texts too; secrets in its text are masked. Further columns pass through; an empty table stays empty."""
    return secrets.redact(docs, secrets.learn(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences; a null text is an empty one. Only id and text are read; an empty table gives none."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Trained models, word sets and tokenizers have no form in SQL; the tests compare ``run`` with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
