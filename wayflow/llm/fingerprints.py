"""Document fingerprints by consistent weighted sampling, with SQL functions only.

Terms are the lower-cased words of a text, weighted by how often they occur. For each of SAMPLES samples every word draws, fixed by
the word and the sample's number, r, c ~ Gamma(2, 1) and b ~ U(0, 1) (by quantile tables, c as the sum of two exponentials). With its weight w, ``t = floor(ln(w) / r + b)`` and
``ln a = ln c - r (t - b + 1)``; the word of least ``a`` in the text gives the sample (word, t). Two texts have the same sample with the probability
of the generalised Jaccard similarity ``sum min / sum max`` of their weights, so the share of equal samples estimates it without bias.

Words are counted first, so a word draws once for each sample however often it occurs. Both aggregations (words of a text, samples of a text)
run where the text already is: texts cross the network once, by id.

A fingerprint is SAMPLES samples of 16 bits, four hex digits each. Unequal samples meet in those bits once in 65,536.

Defined cases: a null text counts as empty. A text without a word has the empty fingerprint; two such texts are alike (1), one such
and another are not (0). Rows that share an id have the same next document, and are the next document by their least text.
Repeated rows are each reported. A null id comes last in descending order. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save

SAMPLES, A_ROW = 64, 4
GRAIN = 256  # steps of the tables that draws come from
_SHIFT = 128.0  # ln a lies above -128 and below 128


def _gamma_quantiles() -> list[float]:
    """Quantiles of Gamma(2, 1) at the middles of GRAIN equal shares, by bisection of ``1 - (1 + x) e^-x``."""
    want = (np.arange(GRAIN) + 0.5) / GRAIN
    lo, hi = np.zeros(GRAIN), np.full(GRAIN, 64.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < want
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return hi.tolist()


def _table(values: list[float]) -> Column:
    """An array as one foldable expression, so that plans stay small."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _tables() -> tuple[Column, Column]:
    """Quantiles of Gamma(2, 1) and of Exp(1)."""
    return _table(_gamma_quantiles()), _table((-np.log((np.arange(GRAIN) + 0.5) / GRAIN)).tolist())


def _samples(word: Column, log_weights: list[Column], k: Column, tables: tuple[Column, Column]) -> list[Column]:
    """What a word draws for sample ``k`` by each weight: ln a in the upper bits, order-preserving, and 16 bits of (word, t) below. Null for a null weight."""
    gamma, exponential = tables
    x = F.xxhash64(word, k)
    part = lambda shift: F.shiftrightunsigned(x, shift).bitwiseAND(GRAIN - 1).cast("int")
    r = F.get(gamma, part(56))
    c = F.get(exponential, part(48)) + F.get(exponential, part(40))
    b = (x.bitwiseAND((1 << 20) - 1) + 0.5) / float(1 << 20)
    high = F.log(c) + _SHIFT

    def drawn(log_weight: Column) -> Column:
        t = F.floor(log_weight / r + b)
        level = ((high - r * (t - b + 1)) * float(1 << 38)).cast("bigint")
        return F.shiftleft(level, 16).bitwiseOR((F.shiftrightunsigned(x, 18) + t * 40503).bitwiseAND(0xFFFF))

    return [drawn(w) for w in log_weights]


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(*keys, columns...) with the fingerprints of those text columns, of each row that has a word in any; ``keys`` tell rows apart, by numbers.

    Needs no shuffle where ``texts`` are partitioned by some of the keys. Words that texts of a row share draw once for all of them. A row draws for
    A_ROW samples at once: so the compiled loop stays small, and few rows are made.
    """
    cut = lambda c: F.split(F.lower(c), r"[\x20\x09-\x0D]+")
    each = texts.select(*keys, F.posexplode(F.array(*columns)).alias("form", "text"))
    words = each.select(*keys, "form", F.explode(cut("text")).alias("word")).where("word <> ''")
    hashed = words.select(*keys, "form", F.xxhash64("word").alias("word"))
    counted = hashed.groupBy(*keys, "word").agg(*[F.sum((F.col("form") == i).cast("int")).alias(f"n{i}") for i in range(len(columns))])
    first = F.explode(F.array(*[F.lit(k) for k in range(0, SAMPLES, A_ROW)])).alias("k")
    weighed = counted.select(*keys, "word", *[F.log(F.col(f"n{i}").cast("double")).alias(f"w{i}") for i in range(len(columns))], first)
    tables, weights = _tables(), [F.col(f"w{i}") for i in range(len(columns))]
    least = [F.min(s).alias(f"s{i}_{j}") for j in range(A_ROW) for i, s in enumerate(_samples(F.col("word"), weights, F.col("k") + j, tables))]
    digits = lambda i: F.concat(*[F.lpad(F.hex(F.col(f"s{i}_{j}").bitwiseAND(0xFFFF)), 4, "0") for j in range(A_ROW)])
    rows = weighed.groupBy(*keys, "k").agg(*least).select(*keys, F.struct("k", *[digits(i).alias(f"p{i}") for i in range(len(columns))]).alias("part"))
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return parts.select(*keys, *[F.array_join(f"parts.p{i}", "").alias(c) for i, c in enumerate(columns)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 if neither fingerprint has any, 0 if one has none."""
    at = lambda f, k: F.substring(f, 4 * k + 1, 4)
    equal = reduce(add, [(at(a, k) == at(b, k)).cast("int") for k in range(SAMPLES)])
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / float(SAMPLES))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next) for distinct keys in descending order, the last followed by the first.

    Two levels: within range partitions, then between their ends. Only keys are sorted and moved.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = save(ids.repartitionByRange(parts, F.desc("key")).withColumn("part", F.spark_partition_id()), "ranges")
    heads = placed.groupBy("part").agg(F.max("key").alias("head"))
    # one row a partition
    after = heads.withColumn("after", F.lead("head").over(Window.orderBy("part"))).crossJoin(heads.agg(F.max("head").alias("first")))
    ends = after.select("part", F.coalesce("after", "first").alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    return placed.withColumn("inside", inside).join(F.broadcast(ends), "part").select("key", F.coalesce("inside", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness, and that to the next document.

    The edited text has its last third (rounded down) replaced by as many first characters, or all, of the next document in
    descending id. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Whole texts cross the network once, by id; the join with the prefixes reuses that exchange and the aggregations its partitions.
    """
    lowest = F.lit(-(1 << 63)).cast("bigint")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), lowest).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = save(keyed.groupBy("key").agg(F.max(F.length("text")).alias("n")), "sizes")
    after = save(next_ids(sizes.select("key")).join(sizes, "key").select(F.col("next").alias("key"), F.col("key").alias("of"), F.floor(F.col("n") / 3).cast("int").alias("take")), "after")
    # of rows that share an id the first one by text is the next document
    rows = keyed.withColumn("row", F.row_number().over(Window.partitionBy("key").orderBy("text")))
    # without the row's number, so that the same exchange of texts serves both; the least lead is that of the least text
    given = keyed.join(after, "key").select(F.col("of").alias("key"), F.expr("substring(text, 1, take)").alias("lead"))
    leads = given.groupBy("key").agg(F.min("lead").alias("lead"))
    met = rows.join(leads, "key").withColumn("n", F.length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("lead", F.lit(1), third))
    made = met.select("key", "row", F.col("n").cast("bigint").alias("n"), "text", edited.alias("edited"))
    prints = fingerprints(made.select("key", "row", F.col("text").alias("print"), F.col("edited").alias("edited_print")), ["key", "row"], ["print", "edited_print"])
    said = save(made.select("key", "row", "n", F.sha2("edited", 256).alias("sha")).join(prints, ["key", "row"], "left").na.fill("", ["print", "edited_print"]), "prints")
    following = after.select("key", "of").join(said.where("row = 1").select("key", F.col("print").alias("next_print")), "key").select(F.col("of").alias("key"), "next_print")
    near = lambda other: likeness(F.col("print"), F.col(other))
    return said.join(following, "key").select(
        F.when(F.col("key") != lowest, F.col("key")).alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), near("edited_print").alias("near_edited"), near("next_print").alias("near_next"),
    )
