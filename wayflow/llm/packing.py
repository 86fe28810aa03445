"""Packing of tokenised texts into sequences by cutting-stock column generation.

A text's ids are cut into full sequences and one rest. Rests are classed by length in steps of GRID
tokens. The histogram of classes is the only thing that reaches the driver: at most CAPACITY / GRID counts. A
linear program over patterns (how many rests of each class share a sequence) is solved by column generation:
a knapsack dynamic program prices new patterns against the duals until none is worth adding. Rounded-down
patterns take rests by their rank within a class; the few rests that rounding leaves are packed first-fit decreasing.

Ranks come in two steps (hash bucket inside a class, then counts of buckets), so that no class meets in one task.

Defined cases: a null text counts as empty and has the end id only. Rows that share an id are packed each
for itself, told apart by nothing but their place. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import save
from .batches import Batches, map_batches

CAPACITY, GRID, END_ID = 2048, 8, 1
_CACHE = 900_000
#: Texts of these characters only are cut at blanks, and unknown words into the tokenizer's own pre-tokens; others go to the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


@functools.cache
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them without special tokens.

    The file's model works on pre-tokens alone, which never reach across blanks, so ids of words are kept and reused, up to _CACHE of them. A Python
    worker makes one encoder and keeps it for all its tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker is one core's, and forked
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def apart(pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded as one text with blanks between."""
        found = tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids, word = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
        cuts = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(ids)]
        if len(cuts) != len(pieces) + 1:  # not one for one: each for itself
            return whole(pieces)
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def encode(texts: list[str]) -> list[bytes]:
        words = [text.lower().split() if _PLAIN.fullmatch(text) and "<|" not in text else None for text in texts]
        fresh = set().union(*(ws for ws in words if ws)).difference(known)
        parts = {w: _TOKEN.findall(w) for w in fresh}
        new = list({t for ts in parts.values() for t in ts if t not in known})
        more: dict[str, bytes] = {}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            more.update(zip(part, apart(part), strict=True))
        of = lambda t: more[t] if t in more else known[t]
        found = {w: b"".join(map(of, ts)) for w, ts in parts.items()}
        if len(known) < _CACHE:
            known.update(found)
            look = known.__getitem__
        else:
            look = lambda w: known[w] if w in known else found[w]
        return [b"".join(map(look, ws)) if ws is not None else whole([text])[0] for ws, text in zip(words, texts, strict=True)]

    return encode


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of each full sequence and each rest of every text."""

    def run(batches: Batches) -> Batches:
        encode = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                row, start, length, crc, total = [], [], [], [], []
                for k, ids in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, CAPACITY):
                        b = min(n, a + CAPACITY)
                        row.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        total.append(n)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *numbers], names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(ids, run, T.StructType([ids.schema.fields[0], *(T.StructField(n, T.LongType()) for n in names[1:])]))


def _price(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over units 1..len(values): best value in ``room`` and how often each unit is taken."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        k = min(r, len(values))
        options = values[:k] + best[r - 1 :: -1][:k]
        took[r] = options.argmax()
        best[r] = options[took[r]]
        if best[r - 1] > best[r] - 1e-12:
            best[r], took[r] = best[r - 1], -1
    pattern, r = np.zeros(len(values), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= int(took[r]) + 1
    return float(best[room]), pattern


def _first_fit(counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Largest items first, each pattern as often as its items last."""
    left, out = counts.copy(), []
    while left.any():
        pattern, free = np.zeros(len(left), np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            take = min(int(left[i]), free // (i + 1))
            pattern[i] = take
            free -= take * (i + 1)
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        out.append((pattern, times))
        left -= pattern * times
    return out


def solve(counts: np.ndarray, room: int, most: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Integer patterns and how often to use each, covering ``counts[i]`` items of i + 1 units in bins of ``room`` units.

    The master program starts from each class by itself, takes in first-fit patterns while their reduced cost
    is negative, and then those that the knapsack prices, until none is or Farley's bound is met.
    """
    m = len(counts)
    have = np.flatnonzero(counts)
    if not len(have):
        return []
    columns = np.zeros((m, len(have)), np.int64)
    columns[have, np.arange(len(have))] = room // (have + 1)
    inverse = np.diag(1 / (room // (have + 1)).astype(float))
    need = counts[have].astype(float)
    used = need * inverse.diagonal()
    pool = np.array([p for p, _ in _first_fit(counts, room)])
    bound = need @ (have + 1.0) / room
    for _ in range(most):
        own = inverse.sum(axis=0)
        worth = (pool[:, have] * own).sum(axis=1)
        if worth.max() > 1 + 1e-7:
            pattern = pool[worth.argmax()]
        else:
            duals = np.zeros(m)
            duals[have] = own
            value, pattern = _price(duals, room)
            bound = max(bound, used.sum() / max(value, 1.0))  # Farley: no cover is shorter
            if value <= 1 + 1e-7 or used.sum() - bound < max(0.5, 1e-4 * used.sum()):
                break
        way = (inverse * pattern[have]).sum(axis=1)
        up = np.flatnonzero(way > 1e-9)
        leaves = up[np.argmin(np.maximum(used[up], 0) / way[up])]
        step = max(used[leaves], 0) / way[leaves]
        used -= step * way
        used[leaves] = step
        row = inverse[leaves] / way[leaves]
        inverse -= np.outer(way, row)
        inverse[leaves] = row
        columns[:, leaves] = pattern
    left, out = counts.copy(), []
    for k in np.argsort(-used):
        fits = columns[:, k] > 0
        times = min([int(np.floor(used[k] + 1e-9)), *(left[fits] // columns[fits, k])])
        if times > 0:
            out.append((columns[:, k].copy(), int(times)))
            left -= columns[:, k] * times
    return out + _first_fit(left, room)


def _plan(counts: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, rank from, rank to, items a sequence, first sequence, first slot), for all classes.

    Class CAPACITY / GRID needs a sequence for each piece.
    """
    room = CAPACITY // GRID
    histogram = np.array([counts.get(i + 1, 0) for i in range(room - 1)], np.int64)
    whole = counts.get(room, 0)
    plan = [(room, 0, whole, 1, 0, 0)] if whole else []
    reached = np.zeros(room - 1, np.int64)
    sequence = whole
    for pattern, times in solve(histogram, room):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[i])
            plan.append((int(i) + 1, int(reached[i]), int(reached[i]) + n * times, n, sequence, slot))
            reached[i] += n * times
            slot += n
        sequence += times
    return plan


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = save(pieces(docs, path, id_col, text_col).withColumn("class", F.ceil(F.col("length") / GRID).cast("int")), "pieces")
    counts = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}
    buckets = max(16, sum(counts.values()) // 50_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")).select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("id", "start", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(ahead, ["class", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside") - 1)
    schema = "class int, lo long, hi long, items long, sequence long, slot long"
    # at most one row for each class of each pattern, and no more patterns than classes and leftovers: some thousands
    plan = spark.createDataFrame(_plan(counts), schema)
    place = F.col("rank") - F.col("lo")
    put = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(place / F.col("items"))).cast("long").alias("sequence_id"), (F.col("slot") + place % F.col("items")).alias("slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return put.withColumn("offset", offset).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
