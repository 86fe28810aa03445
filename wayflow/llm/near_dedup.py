"""Near duplicates on word shingles by HyperMinHash.

1. Every whole text becomes its set of distinct shingles, a digest of that set and one-byte HyperMinHash
   registers (leading zeros and mantissa bits). Equal sets are one class, named by its least id.
2. Registers are banded. In each bucket the least class is the pivot; each other one is compared to it: first by sizes and
   the collision-corrected estimate, then on full sets. So a group of n copies costs n comparisons. A pivot's text travels
   once for a block of its partners, not once for each.
3. Buckets that still hold classes outside the pivot's component are cut into tiles of bounded size: classes outside
   against all. Tiles see registers only and name the classes that have a possible partner, in the first bucket that the two share.
   Full sets travel for those classes alone; tiles of them compare full sets and put out a spanning forest of the links
   found, so what leaves a tile grows with its classes, not with its pairs.
4. Connected components of all links.

With 60 bands of 5 registers a pair at similarity 0.75 shares no bucket with probability 9e-8; the
estimate's margin of 0.11 is four standard deviations there. Texts travel only for classes in shared buckets
(picked by a broadcast Bloom filter of bounded size).

Defined cases: no text or no words: empty set, linked with nothing, its own component. Fewer words than
a shingle: the whole sequence is one shingle. A null id: row kept, component null. Rows that share an id
are of one component. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save
from . import bloom
from .batches import Batches, fixed_bytes, groups, map_batches
from .components import connected_components
from .hyperminhash import band_keys, estimate, registers
from .words import shingle_sets

BANDS, ROWS = 60, 5
WIDTH = BANDS * ROWS
MARGIN = 0.11
STAR_BLOCK = 1024  # partners of a pivot for which its text travels once
BLOCK, SET_BLOCK = 1024, 256  # classes a side of a tile: with registers, with full sets
SET_BYTES = 4 << 20  # of the full sets of a side of a tile, on average


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Batches) -> Batches:
        for batch in batches:
            sizes, digests, regs = [], [], []
            for items in shingle_sets(batch.column(1), size):
                sizes.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                regs.append(registers(items, WIDTH).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])

    return map_batches(docs, sign, "id long, n long, digest binary, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n) of every class."""

    def keys(batches: Batches) -> Batches:
        for batch in batches:
            found = band_keys(fixed_bytes(batch.column(2), WIDTH), BANDS)
            each = lambda k: pa.array(np.repeat(batch.column(k).to_numpy(), BANDS))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(found.ravel()), each(0), each(1)], ["band", "key", "node", "n"])

    return map_batches(nodes.select("node", "n", "regs"), keys, "band int, key long, node long, n long")


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), given with their sizes, whose estimated similarity is at least ``least``."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"))

    def keep(batches: Batches) -> Batches:
        for p in batches:
            equal = (fixed_bytes(p.column(4), WIDTH) == fixed_bytes(p.column(5), WIDTH)).sum(1)
            near = estimate(equal, p.column(2).to_numpy(), p.column(3).to_numpy(), WIDTH) >= least
            yield p.select([0, 1]).filter(pa.array(near))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    return map_batches(met, keep, "a long, b long")


def _near(both: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * both >= threshold * (n + m - both)


def _verified_stars(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach ``threshold`` per cent; few a, each with many b."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).alias("blocks"))
    dealt = save(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "stars")
    heads = dealt.select("a", "block").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(0).alias("member"), F.col("a").alias("b"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "block", F.lit(1).alias("member"), "b", "text")

    def keep(batches: Batches) -> Batches:
        now, sets = (None, None), []
        for p in batches:
            out_a, out_b = [], []
            keys = zip(*(p.column(k).to_pylist() for k in range(4)), strict=True)
            for (a, block, member, b), items in zip(keys, shingle_sets(p.column(4), size), strict=True):
                if (a, block) != now:
                    now, sets = (a, block), []
                if not member:
                    sets.append(items)
                elif any(_near(len(np.intersect1d(x, items, assume_unique=True)), len(x), len(items), threshold) for x in sets):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    ordered = heads.unionByName(rest).repartition("a", "block").sortWithinPartitions("a", "block", "member")
    return map_batches(ordered, keep, "a long, b long")


def _tiled(rows: DataFrame, block: int, size: Column | None = None) -> DataFrame:
    """``rows`` (band, key, node, outside, ...) dealt into tiles (band, key, lo, hi): each class of a bucket meets each one outside in one tile.

    A class has a block among all of its bucket and, if outside, one among those outside. ``asks``: it is there as one outside. A block has
    ``block`` classes on average, and where they have a ``size`` in bytes, SET_BYTES of them at most on average.
    """
    large = lambda part: F.lit(0) if size is None else F.ceil(F.sum(F.when(part, size).otherwise(0)) / SET_BYTES)
    blocks = lambda part: F.greatest(F.ceil(F.count_if(part) / block), large(part))
    per = rows.groupBy("band", "key").agg(blocks(F.lit(True)).alias("blocks"), blocks(F.col("outside")).alias("others"))
    met = rows.join(per.where("others > 0"), ["band", "key"])
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    given = met.withColumns({"lo": deal("blocks"), "asks": F.lit(False)}).withColumn("hi", each("others"))
    asking = met.where("outside").withColumns({"hi": deal("others"), "asks": F.lit(True)}).withColumn("lo", each("blocks"))
    return given.unionByName(asking).drop("blocks", "others")


def _candidates(band: int, asks: np.ndarray, node: np.ndarray, n: np.ndarray, component: np.ndarray, outside: np.ndarray, regs: np.ndarray, least: float, threshold: int):
    """For each asking class of a tile: its row and the rows of its possible partners."""
    there = np.flatnonzero(~asks)
    for k in np.flatnonzero(asks).tolist():
        # of two classes outside the larger one asks
        apart = (component[there] != component[k]) & (~outside[there] | (node[there] < node[k]))
        apart &= 100 * np.minimum(n[there], n[k]) >= threshold * np.maximum(n[there], n[k])
        at = there[apart]
        if not len(at):
            continue
        same = regs[at] == regs[k]
        # the estimate without its correction is an upper bound
        close = np.flatnonzero(same.sum(1) >= least * WIDTH)
        if not len(close):
            continue
        close = close[same[close].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
        if len(close):
            close = close[estimate(same[close].sum(1), np.full(len(close), n[k]), n[at[close]], WIDTH) >= least]
        if len(close):
            yield k, at[close]


_KEYS = ["band", "key", "lo", "hi"]
_SEEN = ["asks", "node", "n", "component", "outside", "regs"]


def _tile(batch: pa.RecordBatch, a: int, b: int):
    part = batch.slice(a, b - a)
    numbers = [part.column(k).to_numpy(zero_copy_only=False) for k in range(4, 9)]
    return int(part.column(0)[0].as_py()), *numbers, fixed_bytes(part.column(9), WIDTH)


def _with_partners(rows: DataFrame, least: float, threshold: int) -> DataFrame:
    """(band, key, node) of the classes that may be linked with one of another component in that bucket."""

    def find(batches: Batches) -> Batches:
        for batch, at in groups(batches, len(_KEYS)):
            band, key, node = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                tile = _tile(batch, a, b)
                found: set[int] = set()
                for k, partners in _candidates(*tile, least, threshold):
                    found.update((int(tile[2][k]), *tile[2][partners].tolist()))
                band += [tile[0]] * len(found)
                key += [batch.column(1)[a].as_py()] * len(found)
                node += found
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(key, pa.int64()), pa.array(node, pa.int64())], ["band", "key", "node"])

    tiles = _tiled(rows, BLOCK).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return map_batches(tiles.select(*_KEYS, *_SEEN), find, "band int, key long, node long").distinct()


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of items that each of ``others`` shares with ``x``; all sorted and distinct."""
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _forests(rows: DataFrame, least: float, threshold: int) -> DataFrame:
    """Links (a, b) between classes of different components, on full sets: a spanning forest of those in each tile."""

    def link(batches: Batches) -> Batches:
        for batch, at in groups(batches, len(_KEYS), 256):
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                band, asks, node, n, component, outside, regs = _tile(batch, a, b)
                sets = [np.frombuffer(batch.column(10)[i].as_buffer(), np.uint64) for i in range(a, b)]
                tree = component.copy()
                for k, partners in _candidates(band, asks, node, n, component, outside, regs, least, threshold):
                    partners = partners[tree[partners] != tree[k]]
                    if not len(partners):
                        continue
                    both = _shared(sets[k], [sets[p] for p in partners])
                    for p in partners[_near(both, n[k], n[partners], threshold)].tolist():
                        if tree[p] != tree[k]:
                            tree[tree == tree[p]] = tree[k]
                            out.append((int(node[p]), int(node[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    tiles = _tiled(rows, SET_BLOCK, F.length("items")).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return map_batches(tiles.select(*_KEYS, *_SEEN, "items"), link, "a long, b long").distinct()


def _items(texts: DataFrame, size: int) -> DataFrame:
    """(node, items): the texts' sets as sorted 64-bit hashes."""

    def hashes(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), size)], pa.binary())], ["node", "items"])

    return map_batches(texts.select("node", "text"), hashes, "node long, items binary")


def _links(docs: DataFrame, nodes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Verified links (a, b) between classes; enough of them to connect all that are linked."""
    bands = _bands(nodes)
    shared = save(bands.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    words = bloom.words_for(shared.count())
    bits = save(bloom.members(shared, F.xxhash64("key"), words), "bloom")
    some = bloom.probe(bands, F.xxhash64("key"), words, bits, "hit").where("hit").drop("hit")
    rows = save(some.join(shared.drop("members"), ["band", "key"]), "shared")

    least = threshold / 100 - MARGIN
    stars = rows.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    sized = stars.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    likely = save(_estimated(sized, nodes, least), "likely")
    ids = save(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct(), "ids")
    links = save(_verified_stars(likely, _texts(docs, ids), size, threshold), "links")

    parts = save(connected_components(links), "parts")
    of = lambda x, name: F.coalesce(F.col(name), F.col(x)).alias(name)
    placed = rows.join(parts, "node", "left").select("band", "key", "node", "n", "pivot", of("node", "component"))
    placed = placed.join(parts.select(F.col("node").alias("pivot"), F.col("component").alias("first")), "pivot", "left").select("band", "key", "node", "n", "component", (F.col("component") != F.coalesce("first", "pivot")).alias("outside"))
    left = save(placed, "placed")
    signed = nodes.select("node", "regs")
    open_ = left.where("outside").select("band", "key").distinct()
    flagged = save(_with_partners(left.join(open_, ["band", "key"], "left_semi").join(signed, "node"), least, threshold), "flagged")
    ids = save(flagged.select("node").distinct(), "ids")
    sets = _items(_texts(docs, ids), size)
    more = save(_forests(left.join(flagged, ["band", "key", "node"]).join(signed, "node").join(sets, "node"), least, threshold), "links")
    return parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the classes in ``ids`` (node); documents that a Bloom filter of the ids stops aren't shuffled."""
    words = bloom.words_for(ids.count())
    bits = save(bloom.members(ids, F.xxhash64("node"), words), "bloom")
    wanted = bloom.probe(docs.where("id is not null"), F.xxhash64("id"), words, bits, "hit").where("hit").drop("hit")
    return save(wanted.join(ids, F.col("id") == F.col("node")).select("node", "text"), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id linked, directly or through others), kept (id = component_id).

    ``threshold``: per cent of the union that the intersection must reach.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = save(_signatures(docs, shingle), "signatures")
    full = signed.where("n > 0 and id is not null")
    nodes = save(full.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    parts = connected_components(_links(docs, nodes, shingle, threshold))
    named = save(nodes.select("digest", "node").join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "named")
    rest = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    found = signed.where("n > 0 and id is not null").select("id", "n", "digest").join(named, "digest").select("id", "n", "component")
    return found.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
