"""Exact duplicates by two-pass Bloom filtering.

Pass one counts 64-bit hashes of the text digests in a counting Bloom filter of bounded size. Pass two
probes every row: rows whose hash surely occurs once go straight to the result, the others are
grouped by their SHA-256. More hashes than one filter holds (67 million) are dealt by range into shards of the digest table, each with a filter
of its own, one after the other; so the method is the same at any size. A hot text is counted before the shuffle, and rows meet their group in a
join that Spark may split.

Defined cases: a null text counts as empty. Rows of equal text and equal id are all reported as kept,
and ``drop_duplicates`` keeps one of them. A null id is smaller than any other. Other columns are ignored
by ``exact_duplicates`` and passed on by ``drop_duplicates``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save
from . import bloom


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _split(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, sha) of the rows that surely have no equal, and of the possibly repeated rest."""
    digests = save(docs.select(F.col(id_col).alias("id"), _sha(F.col(text_col)).alias("sha")), "digests")
    n, h = digests.count(), F.xxhash64("sha")
    shards = bloom.shards_for(n)
    words = bloom.words_for(-(-n // shards))
    if shards > 1:
        # upper bits; the filter takes the lower ones
        digests = save(digests.withColumn("shard", F.pmod(F.shiftright(h, 40), F.lit(shards)).cast("int")), "digests", by="shard")
    marked = []
    for k in range(shards):
        part = digests.where(F.col("shard") == k).drop("shard") if shards > 1 else digests
        bits = save(bloom.repeated(part, h, words), "bloom")
        found = bloom.probe(part, h, words, bits, "again")
        # with several filters, each has left memory before the next is sent out
        marked.append(found if shards == 1 else save(found, "marked"))
    rows = reduce(DataFrame.unionByName, marked)
    return rows.where("not again").drop("again"), rows.where("again").drop("again")


def _groups(again: DataFrame) -> DataFrame:
    return save(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id (largest id among equal texts), group_size, kept, text_sha256 (hex)."""
    once, again = _split(docs, id_col, text_col)
    alone = once.select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    grouped = again.join(_groups(again), "sha").select("id", "sha", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that of the largest id.

    A second filter, of the repeated digests, lets all other rows pass straight on. Of the rest only those that stay meet their group, by
    (digest, id): no key is hot.
    """
    _, again = _split(docs, id_col, text_col)
    repeated = save(_groups(again).where("group_size > 1"), "repeated")
    words = bloom.words_for(repeated.count())
    bits = save(bloom.members(repeated, F.xxhash64("sha"), words), "bloom")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), _sha(F.col(text_col)).alias("sha"))
    marked = bloom.probe(rows, F.xxhash64("sha"), words, bits, "maybe")
    maybe = marked.where("maybe")
    single = maybe.join(repeated.select("sha"), "sha", "left_anti").select("row")
    stays = repeated.select(F.col("sha").alias("of"), "keep_id")
    kept = maybe.join(stays, (F.col("sha") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi").dropDuplicates(["sha", "id"]).select("row")
    return marked.where("not maybe").select("row").unionByName(single).unionByName(kept).select("row.*")
