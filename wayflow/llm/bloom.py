"""Bloom filters of fixed size as small tables, built and probed with SQL functions only.

A filter has ``words`` words of 16 cells; both cells of a hash lie in one word. Stored as rows
(``bloom_bucket``, ``bloom_bits``) of 4 KB bitmaps it takes ``2 * words`` bytes, whatever the number of
hashes, so it may be broadcast: 64 MB at ``MOST_WORDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 25
#: Hashes a word, up to which a filter of MOST_WORDS words spares most shuffles; more hashes are dealt into several filters (``exact_dedup``).
FULL_WORDS = 2
_WORDS_A_BUCKET = 2048
#: Above this many hashes in one word its 4-bit counters could overflow; all its cells then count as repeated, as they do where the sum itself does.
_FULL = 15


def words_for(n: int) -> int:
    """Words for ``n`` hashes: two a hash, a power of two, at most MOST_WORDS."""
    return min(MOST_WORDS, 1 << max(11, (2 * max(n, 1) - 1).bit_length()))


def shards_for(n: int) -> int:
    """Filters that ``n`` hashes take."""
    return max(1, -(-n // (FULL_WORDS * MOST_WORDS)))


def _place(h: Column, words: int) -> tuple[Column, Column, Column]:
    first = h.bitwiseAND(15)
    second = (first + 1 + F.pmod(F.shiftright(h, 4), F.lit(15))) % 16
    return F.shiftright(h, 12).bitwiseAND(words - 1), first, second


def _bitmaps(cells: DataFrame) -> DataFrame:
    """Bitmaps of rows (word, cell)."""
    at = F.col("word") * 16 + F.col("cell")
    return cells.groupBy(F.shiftright(at, 15).alias("bloom_bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bloom_bits"))


def repeated(hashes: DataFrame, h: Column, words: int) -> DataFrame:
    """Filter of the hashes that may occur more than once.

    First pass of the two: a word keeps sixteen 4-bit counters in one BIGINT, so that counting is a plain
    sum, combined before the shuffle.
    """
    word, first, second = _place(h, words)
    one = lambda c: F.expr("shiftleft(1L, cast(4 * {} as int))".format(c))
    counted = (
        hashes.select(word.alias("word"), first.alias("c1"), second.alias("c2"))
        .groupBy("word")
        .agg(F.try_sum(one("c1") + one("c2")).alias("counters"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    cells = counted.select("word", "counters", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    return _bitmaps(cells.where(F.col("counters").isNull() | (F.col("n") > _FULL) | (F.expr("shiftright(counters, 4 * cell) & 15") > 1)))


def members(hashes: DataFrame, h: Column, words: int) -> DataFrame:
    """Filter of all given hashes."""
    word, first, second = _place(h, words)
    cells = hashes.select(word.alias("word"), F.explode(F.array(first, second)).alias("cell"))
    return _bitmaps(cells)


def probe(df: DataFrame, h: Column, words: int, bits: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean column ``out``: false only where the filter surely lacks the hash. No shuffle of ``df``."""
    word, first, second = _place(h, words)
    two = F.conv(F.hex(F.substring("bloom_bits", F.col("bloom_word").bitwiseAND(_WORDS_A_BUCKET - 1).cast("int") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    bit = lambda c: f"(shiftright(bloom_two, cast(({c} + 8) % 16 as int)) & 1) = 1"
    placed = df.withColumns({"bloom_word": word, "bloom_c1": first, "bloom_c2": second}).withColumn("bloom_bucket", F.shiftright("bloom_word", 11))
    found = placed.join(F.broadcast(bits), "bloom_bucket", "left").withColumn("bloom_two", two)
    return found.withColumn(out, F.coalesce(F.expr(f"{bit('bloom_c1')} and {bit('bloom_c2')}"), F.lit(False))).drop(
        "bloom_word", "bloom_c1", "bloom_c2", "bloom_bucket", "bloom_bits", "bloom_two"
    )
