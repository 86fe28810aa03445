"""How far the sources of a language diverge: exact counts of its frequent terms by a perfect-hash recount.

A first pass counts in how many documents of a language each term occurs; those of at least LEAST_DOCS are kept, exactly. The kept (language, term)
pairs are dealt by hash into shards of about SHARD_KEYS, each of which gets a minimal perfect hash and stores its keys. HELD shards at a time,
of bounded size whatever the vocabulary, are broadcast. The second pass looks each term up, compares it with the stored key, and adds to
slots that lie dense for each (language, source) group. More shards than HELD are taken in rounds: terms and their counts in
a batch are first dealt out by round, so texts are read once.

Slots are cut into blocks so narrow that a block of all sources of the language is bounded (BLOCK_CELLS), and a task adds up a block, compares
its sources with each other and with the language, and puts out partial sums and the block's best terms. A group with a third of all rows only
adds to slots of its own in every task.

Defined cases: null text, language or source counts as ''. A group without terms has counts of 0. A language that keeps no
term has pairs of value 0. Very long texts are read whole. Repeated rows count each. Equal values rank by item in UTF-8. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save
from . import words
from .batches import Batches, map_batches
from .perfect_hash import PerfectHash

LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Keys of a shard (on average) and shards broadcast at a time: at most about 100 MB, whatever the vocabulary.
SHARD_KEYS, HELD = 1 << 19, 4
#: Slots of a block at most, and cells (slots times sources) of a block and of the dense arrays of a task.
BLOCK_SLOTS, BLOCK_CELLS, TASK_CELLS = 1 << 13, 1 << 22, 1 << 23
_BLOCK_BYTES = 8 << 20
_U = np.uint64
#: Bytes that part terms: all of ASCII but the letters.
_APART = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _strings(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).fill_null("")


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """For stretches of rows (from, to): row and code of each term, and the distinct terms that the codes stand for."""
    data, at = words.utf8(texts)
    for i, j in words.blocks(at, _BLOCK_BYTES):
        part = data[at[i] : at[j]]
        starts, ends, first = words.word_spans(part, at[i : j + 1] - at[i], _APART)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        joined = _LOWER[part[~_APART[part]]]
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
        yield i, j, np.repeat(np.arange(i, j), np.diff(first)), found.indices.to_numpy(), found.dictionary


def hashes(strings: pa.Array) -> np.ndarray:
    data, at = words.utf8(strings)
    return words.word_hashes(data, at[:-1], at[1:])


def _key_hashes(langs: np.ndarray, of_terms: np.ndarray) -> np.ndarray:
    return words.mix(of_terms + words.mix(langs ^ _U(0xA5A5A5A5)) * _U(3))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(20)) % _U(shards)).astype(np.int64)


def _counted(codes: np.ndarray, distinct: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a code and one below ``n``, and how often each occurs; sorted by the first, then the second."""
    pairs, count = np.unique(codes.astype(np.int64) * n + distinct, return_counts=True)
    return pairs // n, pairs % n, count


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of all terms that occur in at least ``least`` documents of the language."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            coded = _strings(batch.column(1)).dictionary_encode()
            lang = coded.indices.to_numpy()
            for _, _, rows, codes, distinct in terms(batch.column(0)):
                row, term, _ = _counted(rows, codes, max(1, len(distinct)))
                l, t, n = _counted(lang[row], term, max(1, len(distinct)))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(l)), distinct.take(pa.array(t)), pa.array(n, pa.int64())], ["lang", "term", "n"])

    counted = map_batches(docs.select("text", "lang"), count, "lang string, term string, n long")
    return save(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), "kept")


@dataclass
class Shard:
    """A perfect hash over (language, term), and the keys by slot: sorted by language, then term."""

    table: PerfectHash
    slot_of: np.ndarray  # by the hash's number
    langs: dict[str, tuple[int, int, int]]  # slots of a language: from, to; slots of its blocks
    stored: pa.Array

    def slots(self, langs: list[str], lang: np.ndarray, keys: np.ndarray, said: pa.Array) -> np.ndarray:
        """Slots of terms within those of their language; -1 for what was not kept. A slot counts only if its stored key is the very term and language."""
        if not len(self.slot_of):
            return np.full(len(keys), -1, np.int64)
        numbers = self.table.numbers(keys)
        slots = self.slot_of[numbers]
        span = np.array([self.langs.get(x, (0, 0, 1)) for x in langs], np.int64).reshape(-1, 3)
        same = pc.equal(self.stored.take(pa.array(slots)), said).to_numpy(zero_copy_only=False)
        good = (numbers >= 0) & same & (slots >= span[lang, 0]) & (slots < span[lang, 1])
        return np.where(good, slots - span[lang, 0], -1)


def _shards(kept: DataFrame, shards: int) -> DataFrame:
    """Rows of two kinds: (shard, blob) with a pickled Shard, and (shard, lang, block, terms) with the terms of a block of slots.

    The column ``width`` of ``kept`` has the slots of a block of the language.
    """

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            lang, term = batch.column(0), batch.column(1)
            keys = _key_hashes(hashes(lang), hashes(term))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(keys, shards))], ["lang", "term", "width", "shard"])

    def build(batches: Batches) -> Batches:
        names = ["shard", "lang", "block", "terms", "blob"]
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        for shard, group in itertools.groupby(rows, key=lambda r: r["shard"]):
            langs, said, at = {}, [], 0
            for lang, keys in itertools.groupby(group, key=lambda r: r["lang"]):
                keys = list(keys)
                own = [r["term"] for r in keys]
                step = keys[0]["width"]
                langs[lang] = (at, at + len(own), step)
                at += len(own)
                said += own
                cuts = range(0, len(own), step)
                lists = pa.array([own[a : a + step] for a in cuts], pa.list_(pa.string()))
                k = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * k), pa.array([lang] * k, pa.string()), pa.array(range(k), pa.int64()), lists, pa.nulls(k, pa.binary())], names)
            stored = pa.array(said, pa.string())
            of_lang = np.repeat(hashes(pa.array(list(langs), pa.string())), [b - a for a, b, _ in langs.values()])
            keys = _key_hashes(of_lang, hashes(stored))
            table = PerfectHash(keys)
            slot_of = np.zeros(len(keys), np.int32)
            slot_of[table.numbers(keys)] = np.arange(len(keys))
            blob = pickle.dumps(Shard(table, slot_of, langs, stored))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.string())), pa.array([blob], pa.binary())], names)

    dealt = map_batches(kept.select("lang", "term", "width"), deal, "lang string, term string, width long, shard long")
    placed = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "term")
    return save(map_batches(placed, build, "shard long, lang string, block long, terms array<string>, blob binary"), "shards")


class _Slots:
    """Dense counts of a task, by (language, source, shard)."""

    def __init__(self, held: dict[int, bytes], shards: int, most: int):
        self.held, self.shards, self.most, self.dense, self.cells = {k: pickle.loads(x) for k, x in held.items()}, shards, most, {}, 0

    def add(self, langs: pa.Array, lang_of: np.ndarray, sources: list[str], group: np.ndarray, term: np.ndarray, count: np.ndarray, distinct: pa.Array) -> Batches:
        """Counts of terms in groups; ``group`` ascends. Puts out what the arrays hold whenever they hold too many cells."""
        said = langs.to_pylist()
        pairs, back = np.unique(lang_of[group].astype(np.int64) * max(1, len(distinct)) + term, return_inverse=True)
        lang, code = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
        keys = _key_hashes(hashes(langs)[lang], hashes(distinct)[code])
        shard, slot = shard_of(keys, self.shards), np.full(len(keys), -1, np.int64)
        for k, table in self.held.items():
            here = np.flatnonzero(shard == k)
            slot[here] = table.slots(said, lang[here], keys[here], distinct.take(pa.array(code[here])))
        shard, slot = shard[back], slot[back]
        good = np.flatnonzero(slot >= 0)
        for k in self.held:
            own = good[shard[good] == k]
            cuts = np.flatnonzero(np.diff(group[own], prepend=-1)).tolist()
            for a, b in itertools.pairwise([*cuts, len(own)]):
                g = int(group[own[a]])
                name = said[lang_of[g]], sources[g], k
                if name not in self.dense:
                    first, end, _ = self.held[k].langs[name[0]]
                    self.dense[name] = np.zeros(end - first, np.int64)
                    self.cells += end - first
                self.dense[name][slot[own[a:b]]] += count[own[a:b]]
        if self.cells > self.most:
            yield from self.drain()

    def drain(self) -> Batches:
        """(lang, source, shard, block, n, slots, counts): what the arrays hold, by blocks of slots, as bytes of 32-bit slots and 64-bit counts."""
        for (lang, source, k), dense in self.dense.items():
            width = self.held[k].langs[lang][2]
            at = np.flatnonzero(dense)
            out = []
            for a, b in itertools.pairwise([*np.flatnonzero(np.diff(at // width, prepend=-1)).tolist(), len(at)]):
                own = dense[at[a:b]]
                block = int(at[a]) // width
                out.append((lang, source, k, block, int(own.sum()), (at[a:b] - block * width).astype("<i4").tobytes(), own.astype("<i8").tobytes()))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _COUNTED)
        self.dense, self.cells = {}, 0


_COUNTED = ["lang", "source", "shard", "block", "n", "slots", "counts"]
_COUNTED_SCHEMA = "lang string, source string, shard long, block long, n long, slots binary, counts binary"


def _group_counts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of (text, lang, source) rows: languages, language of each group, source of each group, and its terms with their counts."""
    lang, source = (_strings(batch.column(k)).dictionary_encode() for k in (1, 2))
    groups, of_row = np.unique(lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(), return_inverse=True)
    lang_of = groups // max(1, len(source.dictionary))
    sources = source.dictionary.take(pa.array(groups % max(1, len(source.dictionary)))).to_pylist()
    for _, _, rows, codes, distinct in terms(batch.column(0)):
        yield lang.dictionary, lang_of, sources, *_counted(of_row[rows], codes, max(1, len(distinct))), distinct


def recount(docs: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """(lang, source, shard, block, n, slots, counts) partial counts of the kept terms, in rounds of HELD shards."""
    rounds = -(-shards // HELD)
    context = docs.sparkSession.sparkContext
    counted = []
    dealt = save(_dealt(docs, shards), "dealt", by="round") if rounds > 1 else None
    for r in range(rounds):
        found = built.where(F.col("blob").isNotNull() & (F.floor(F.col("shard") / HELD) == r)).select("shard", "blob").collect()
        held = context.broadcast({x["shard"]: bytes(x["blob"]) for x in found})

        def from_texts(batches: Batches, held=held) -> Batches:
            slots = _Slots(held.value, shards, TASK_CELLS)
            for batch in batches:
                for found in _group_counts(batch):
                    yield from slots.add(*found[:3], *found[3:6], found[6])
            yield from slots.drain()

        def from_counts(batches: Batches, held=held) -> Batches:
            slots = _Slots(held.value, shards, TASK_CELLS)
            for batch in batches:
                lang, source, term = (_strings(batch.column(k)).dictionary_encode() for k in range(3))
                groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
                order = np.argsort(group, kind="stable")
                sources = source.dictionary.take(pa.array(groups % len(source.dictionary))).to_pylist()
                codes = term.indices.to_numpy()[order]
                # a pair that a batch has twice adds twice: such are summed first
                pairs, back = np.unique(group[order].astype(np.int64) * len(term.dictionary) + codes, return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, back, batch.column(3).to_numpy()[order])
                yield from slots.add(lang.dictionary, groups // len(source.dictionary), sources, pairs // len(term.dictionary), pairs % len(term.dictionary), total, term.dictionary)
            yield from slots.drain()

        if dealt is None:
            counted.append(save(map_batches(docs.select("text", "lang", "source"), from_texts, _COUNTED_SCHEMA), "recount"))
        else:
            counted.append(save(map_batches(dealt.where(F.col("round") == r).drop("round"), from_counts, _COUNTED_SCHEMA), "recount"))
        held.unpersist()
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n, round) of the terms of each batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for langs, lang_of, sources, group, term, count, distinct in _group_counts(batch):
                keys = _key_hashes(hashes(langs)[lang_of[group]], hashes(distinct)[term])
                columns = [langs.take(pa.array(lang_of[group])), pa.array(sources, pa.string()).take(pa.array(group)), distinct.take(pa.array(term)), pa.array(count, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shard_of(keys, shards) // HELD, pa.int32())], ["lang", "source", "term", "n", "round"])

    return map_batches(docs.select("text", "lang", "source"), run, "lang string, source string, term string, n long, round int")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * counts / total)`` in whole numbers that stay below 2^63 for totals below 2^53: SCALE is taken in three steps of 1000."""
    out, left = np.zeros(np.broadcast(counts, total).shape, np.int64), counts
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _block(said: list[str], groups: list[tuple[str, int, int]], matrix: np.ndarray, lang: str, top: int) -> pa.RecordBatch:
    """Partial sums of the pairs, and the ``top`` best terms, of one block: ``groups`` as (source, total, kept terms of the language)."""
    sources = [s for s, _, _ in groups]
    totals = np.array([n for _, n, _ in groups], np.int64)
    kept = groups[0][2]
    p = shares(matrix + 1, (totals + kept)[:, None])
    q = shares(matrix.sum(0) + 1, np.array([totals.sum() + kept]))
    out = []
    for a, own in enumerate(p):
        if len(sources) > 1:
            apart = own - p
            sums = (apart * apart // p).sum(1)
            out += [("pair", sources[a], sources[b], int(x)) for b, x in enumerate(sums) if b != a]
        at = np.flatnonzero((matrix[a] > 0) & (own > q))
        values = (own[at] - q[at]) ** 2 // q[at]
        best = np.argsort(-values, kind="stable")[:top]  # slots ascend by term
        out += [("term", sources[a], said[t], int(v)) for t, v in zip(at[best].tolist(), values[best].tolist(), strict=True)]
    columns = [pa.array([lang] * len(out), pa.string()), *(pa.array([r[k] for r in out], pa.string()) for k in (1, 0, 2)), pa.array([r[3] for r in out], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _compare(batches: Batches, top: int) -> Batches:
    """Blocks of rows sorted by block and kind: 0 its terms, 1 its groups, 2 partial counts, which are added one after the other."""
    rows = itertools.chain.from_iterable(x.to_pylist() for b in batches for x in (b.slice(i, 64) for i in range(0, len(b), 64)))
    for (lang, _, _), block in itertools.groupby(rows, key=lambda r: (r["lang"], r["shard"], r["block"])):
        said, groups, place, matrix = [], [], {}, None
        for r in block:
            if r["kind"] == 0:
                said = r["terms"]
            elif r["kind"] == 1:
                place[r["source"]] = len(groups)
                groups.append((r["source"], r["n"], r["kept"]))
            else:
                if matrix is None:
                    matrix = np.zeros((len(groups), len(said)), np.int64)
                matrix[place[r["source"]], np.frombuffer(r["slots"], "<i4")] += np.frombuffer(r["counts"], "<i8")
        if matrix is None:
            matrix = np.zeros((len(groups), len(said)), np.int64)
        yield _block(said, groups, matrix, lang, top)


def _compared(built: DataFrame, counted: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every block of slots."""
    blocks = built.where(F.col("terms").isNotNull()).select("lang", "shard", "block", "terms")
    totals = groups.join(counted.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, "n")
    totals = save(totals.join(langs.select("lang", "kept"), "lang"), "totals")
    shape = {"source": "string", "n": "long", "kept": "long", "terms": "array<string>", "slots": "binary", "counts": "binary"}
    rows = lambda df, kind, own: df.select("lang", "shard", "block", F.lit(kind).alias("kind"), *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in shape.items()])
    each = blocks.select("lang", "shard", "block").join(totals, "lang")
    all_rows = rows(blocks, 0, ("terms",)).unionByName(rows(each, 1, ("source", "n", "kept"))).unionByName(rows(counted, 2, ("source", "slots", "counts")))
    placed = all_rows.repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", "kind", "source")
    return map_batches(placed, lambda batches: _compare(batches, TOP_TERMS), "lang string, source string, part string, item string, value long")


def _ranked(found: DataFrame) -> DataFrame:
    """Pairs whole, terms to TOP_TERMS of each group; each task puts out TOP_TERMS a group at most before the shuffle."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def audit(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other, and the terms it has more of than the language."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = save(read.select("lang", "source").distinct(), "groups")
    kept = kept_terms(read, least)
    n = kept.count()
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = save(sources.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").fillna(0, "kept"), "langs")
    # every pair has a row of value 0, so that languages without kept terms have theirs
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    if n:
        shards = -(-n // SHARD_KEYS)
        width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SLOTS), F.floor(F.lit(BLOCK_CELLS) / F.col("sources")))).cast("long")
        built = _shards(kept.join(langs.select("lang", width.alias("width")), "lang"), shards)
        found = found.unionByName(save(_compared(built, recount(read, built, shards), groups, langs), "compared"))
    return _ranked(found)
