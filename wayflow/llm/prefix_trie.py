"""The trie of conversations' beginnings: who shares which turns, and what sharing them saves.

Conversations are rebuilt, written as sequences of 16-byte digests of their turns, and sorted. Shards are runs of the sorted, distinct
sequences. A shard writes its part of the trie as balanced parentheses: the matching closing one delimits a node's subtree, the
number of ``()`` pairs within it is that of its leaves, and differences of cumulative sums give members and savings. Only nodes on a shard's first
or last sequence, its spine, can reach into other shards: their parts are merged by key, and each merged spine node adds what it has to itself and
the spine nodes above it.

Sequences are cut into segments of LEVEL turns, so that no row grows with a conversation: a segment hangs below the digest of all turns before it. Where
conversations are longer, the tries of later segments are built first, their totals are summed up over the segments behind each, and the
segments before take those totals at their ends. Turns are numbered by range partitions and offsets, so a conversation with a third of all rows is dealt over many tasks.

The digest of a node's ending conversations is sequential by nature; ids are first joined into long strings, in parallel, and one
task of each group only hashes those strings one after the other.

Defined cases: null role or text counts as empty; rows with a null conv_id belong to no conversation and are left out. Turns are ordered by number, null first, those of equal
number by the digest of role and text, so repeated rows are turns of their own. Very long texts only have a digest and a length. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save
from .batches import Batches, map_batches
from .parens import Parens

# Conversations of a block, and the modulus of the turns borrowed from its first.
BLOCK_CONVS, MOST_BORROWED = 100, 6
#: Turns of a segment, and nodes of a shard at most (a sequence more).
LEVEL, SHARD_NODES = 128, 1 << 17
_WIDTH, _NONE = 16, hashlib.sha256(b"").hexdigest()
#: Characters of joined ids that are hashed at a time.
_CHUNK = 1 << 16


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, _WIDTH)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) of turns, numbered from 1 in each conversation.

    Rows are range-partitioned in order, so a conversation lies in one partition or in consecutive ones; those that span several are at most as many
    as partitions, and the offsets of their parts are broadcast.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", _digest(named).alias("digest"), F.length(text).cast("long").alias("size"))
    order = ("conv_id", "turn", "digest")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    placed = save(placed.drop("turn"), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("before", F.sum("n").over(ahead)).where("before is not null").select("conv_id", "part", "before")
    local = placed.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")))
    pos = F.col("pos") + F.coalesce(F.col("before"), F.lit(0))
    return save(local.join(F.broadcast(save(offsets, "offsets")), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "digest", "size"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, digest, size) of their rebuilt turns."""
    own = numbered(turns)
    first = F.col("conv_id") - F.col("conv_id") % BLOCK_CONVS
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED
    convs = save(own.where("pos = 1").select("conv_id"), "convs")
    heads = own.where((F.col("conv_id") % BLOCK_CONVS == 0) & (F.col("pos") < MOST_BORROWED)).select(F.col("conv_id").alias("first"), "pos", "digest", "size")
    lent = convs.select("conv_id", first.alias("first"), borrowed.alias("h")).join(heads, "first").where("pos <= h").select("conv_id", "pos", "digest", "size")
    there = heads.groupBy("first").agg(F.count(F.lit(1)).alias("there"))
    kept = own.withColumns({"first": first, "h": borrowed}).where("pos > h").join(there, "first", "left")
    shift = F.least(F.col("h"), F.coalesce(F.col("there"), F.lit(0))) - F.col("h")
    return convs, lent.unionByName(kept.select("conv_id", (F.col("pos") + shift).alias("pos"), "digest", "size"))


def _chained(batches: Batches) -> Batches:
    """Of (conv_id, seg, digest of the segment) in order: (conv_id, seg, prefix), the digest of all segments before."""
    conv, prefix = None, b""
    for batch in batches:
        out = []
        for c, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != conv:
                conv, prefix = c, b""
            out.append(prefix)
            prefix = hashlib.sha256(prefix + digest).digest()[:_WIDTH]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["conv_id", "seg", "prefix"])


def segments(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, seg, prefix, path, sizes, more): runs of LEVEL turns; ``more`` where the conversation goes on behind. One without turns has an empty one."""
    turn = F.struct("pos", "digest", "size")
    rows = turns.select("conv_id", F.floor((F.col("pos") - 1) / LEVEL).cast("int").alias("seg"), turn.alias("turn"))
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).alias("seg"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn")))
    cut = rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # LEVEL at most
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    cut = save(cut.select("conv_id", "seg", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "cut")
    long = save(cut.where("seg > 0").select("conv_id", F.col("seg") - 1), "long").toDF("conv_id", "seg")
    of_long = cut.join(long.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "seg", _digest(F.col("path")).alias("digest"))
    prefixes = map_batches(of_long.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), _chained, "conv_id long, seg int, prefix binary").where("seg > 0")
    marked = cut.join(long.withColumn("more", F.lit(True)), ["conv_id", "seg"], "left").join(prefixes, ["conv_id", "seg"], "left")
    return save(marked.select("conv_id", "seg", F.coalesce("prefix", F.lit(b"")).alias("prefix"), "path", "sizes", F.coalesce("more", F.lit(False)).alias("more")), "segments")


def _joined(batches: Batches, most: int) -> Batches:
    """Of (key, conv_id) in order: (key, first id, ids joined by commas, about ``most`` characters of them)."""
    key, first, held, size, out = None, 0, [], 0, []
    rows = itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for b in batches)
    names = ["key", "first", "ids"]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names)
    for k, conv in rows:
        if k != key or size > most:
            if held:
                out.append((key, first, ",".join(held)))
            key, first, held, size = k, conv, [], 0
            if len(out) >= 1000 or sum(len(x[2]) for x in out[-20:]) > 20 * most:
                yield flush()
                out.clear()
        held.append(str(conv))
        size += len(held[-1]) + 1
    if held:
        out.append((key, first, ",".join(held)))
    yield flush()


def _hashed(batches: Batches) -> Batches:
    """Of (key, first id, ids) in order: (key, SHA-256 of all its ids)."""
    key, sha = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends(found: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end."""
    rows = found.where("not more").select(_digest(F.col("prefix"), F.col("path")).alias("key"), "conv_id")
    most = _CHUNK
    join = lambda batches: _joined(batches, most)
    joined = save(map_batches(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), join, "key binary, first long, ids string"), "joined")
    return save(map_batches(joined.repartition("key").sortWithinPartitions("key", "first"), _hashed, "key binary, ends_sha256 string"), "ends")


_NODE = {"seg": pa.int32(), "prefix": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64()}
_NODE |= {"n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "size": pa.int64(), "more": pa.bool_(), "more_leaves": pa.int64(), "more_saved": pa.int64()}
_NODE |= {"shard": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "above": pa.list_(pa.binary())}
_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
_SCHEMA = ", ".join(f"{k} {_SPARK.get(t, 'array<binary>')}" for k, t in _NODE.items())


def _common(a: dict, b: dict) -> int:
    """Nodes that two sequences share, the root among them."""
    if a["prefix"] != b["prefix"]:
        return 0
    x, y = a["path"], b["path"]
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return 1 + n // _WIDTH
    return 1 + int((np.frombuffer(x, np.uint8)[:n] != np.frombuffer(y, np.uint8)[:n]).argmax()) // _WIDTH


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minima of ranges, from those of all ranges whose length is a power of two."""
    tables = [values]
    while 2 ** len(tables) <= len(values):
        half, last = 2 ** (len(tables) - 1), tables[-1]
        tables.append(np.minimum(last[: len(last) - half], last[half:]))
    k = np.log2(stop - start).astype(np.int64)
    out = np.empty(len(start), np.int64)
    for level, table in enumerate(tables):
        of = np.flatnonzero(k == level)
        out[of] = np.minimum(table[start[of]], table[stop[of] - 2**level])
    return out


def _key(row: dict, turns: int) -> bytes:
    return hashlib.sha256(row["prefix"] + row["path"][: turns * _WIDTH]).digest()[:_WIDTH]


def shard_nodes(rows: list[dict], shard: str, level: int = LEVEL) -> pa.RecordBatch:
    """The nodes of a shard's sequences. Those off the spine are whole; of spine nodes, numbers of leaves, savings and children leave out other spine nodes."""
    lengths = np.array([1 + len(r["path"]) // _WIDTH for r in rows])
    common = np.array([0, *(_common(a, b) for a, b in itertools.pairwise(rows))])
    opened, closed = lengths - common, np.append(0, lengths[:-1] - common[1:])
    bits = np.repeat(np.tile(np.array([0, 1], np.int8), len(rows)), np.column_stack([closed, opened]).ravel())
    trie = Parens(np.append(bits, np.zeros(lengths[-1], np.int8)))
    m, opens, close = len(trie.opens), trie.opens, trie.find_close(trie.opens)
    stop = trie.rank[close]  # the first node behind the subtree, in preorder
    path_of, last = np.repeat(np.arange(len(rows)), opened), np.cumsum(opened) - 1  # of each node; node at which each sequence ends
    parent, depth, size, stack = np.full(m, -1), np.empty(m, np.int64), np.zeros(m, np.int64), np.zeros(lengths.max(), np.int64)
    for r, end, n, c in zip(rows, last.tolist(), lengths.tolist(), common.tolist(), strict=True):
        own = np.arange(end + 1 - (n - c), end + 1)
        stack[c:n], depth[own] = own, np.arange(c, n)
        parent[own] = np.append(stack[c - 1] if c else -1, own[:-1])
        size[own] = ([0, *r["sizes"]])[c:n]
    spine = {v: _key(rows[0], v) for v in range(opened[0])} | {v: _key(rows[-1], k) for k, v in enumerate(stack[: lengths[-1]].tolist())}
    on = np.zeros(m, bool)
    on[list(spine)] = True
    off = ~on

    def within(values: np.ndarray) -> np.ndarray:
        """Sums over each subtree."""
        sums = np.append(0, np.cumsum(values))
        return sums[stop] - sums[:m]

    def at_end(name: str) -> np.ndarray:
        values = np.zeros(m, np.int64)
        values[last] = [r[name] for r in rows]
        return values

    members = within(at_end("n"))
    low = _least(np.array([r["low"] for r in rows], np.int64), path_of, np.searchsorted(last, stop))
    roots = np.flatnonzero(parent < 0)  # below a segment before, whose end has members that end there too
    low[roots] = [int(v) if (top := rows[i]["top"]) is None else top for v, i in zip(low[roots], path_of[roots].tolist(), strict=True)]
    more, more_leaves, more_saved = (at_end(c) for c in ("more", "more_leaves", "more_saved"))
    children = np.bincount(parent[(parent >= 0) & off], minlength=m) + at_end("more_children")
    before = np.append(0, trie.leaves)[opens]  # pairs that begin ahead of the node
    alone = trie.leaves[opens] - before  # 1 where the node is a pair itself
    # pairs on the spine may go on in another shard; those where sequences go on count what lies behind instead
    leaves = trie.leaves[close] - before - within(alone * on) + within((more_leaves - more) * off)
    saved = within(((members - 1) * size + more_saved) * off)
    said = np.full(m, None, object)
    said[last] = [r["ends_sha256"] for r in rows]
    below_spine = np.append(on, False)[parent]

    def above(v: int) -> Iterator[bytes]:
        while v >= 0:
            yield spine[v]
            v = int(parent[v])

    each = range(m)
    columns = {
        "seg": np.array([r["seg"] for r in rows])[path_of],
        "prefix": [rows[i]["prefix"] for i in path_of.tolist()],
        "depth": depth + np.array([r["seg"] for r in rows])[path_of] * level,
        "conv_id": low,
        "n_convs": members,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "ends_sha256": said.tolist(),
        "size": size,
        "more": more > 0,
        "more_leaves": more_leaves,
        "more_saved": more_saved,
        "shard": [shard] * m,
        "key": [spine.get(v) for v in each],
        "parent_key": [spine[p] if s else None for p, s in zip(parent.tolist(), below_spine.tolist(), strict=True)],
        "above": [list(above(v)) if v in spine else None for v in each],
    }
    found = {k: pa.array(v, _NODE[k]) for k, v in columns.items()}
    found["parent_conv_id"] = pa.array(np.append(low, 0)[parent], mask=(parent < 0) | below_spine)
    return pa.RecordBatch.from_arrays([found[k] for k in _NODE], list(_NODE))


def _shards(batches: Batches, most: int, level: int) -> Batches:
    """Nodes of sorted sequences, in shards of about ``most`` nodes."""
    held, nodes, number = [], 0, 0
    place = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    for r in rows():
        held.append(r)
        nodes += 1 + len(r["path"]) // _WIDTH
        if nodes >= most:
            yield shard_nodes(held, f"{place}-{number}", level)
            held, nodes, number = [], 0, number + 1
    if held:
        yield shard_nodes(held, f"{place}-{number}", level)


_OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _nodes(found: DataFrame, ended: DataFrame, totals: DataFrame | None) -> DataFrame:
    """All nodes of the tries of segments: (seg, prefix, *_OUT). ``totals`` has, by the ``next`` prefix, what lies behind a segment."""
    grouped = found.groupBy("prefix", "path").agg(
        F.first("seg").alias("seg"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.max("more").alias("more")
    )
    keyed = grouped.withColumn("key", _digest(F.col("prefix"), F.col("path"))).join(ended, "key", "left").drop("key")
    if totals is None:
        classes = keyed.withColumns({c: F.lit(0).cast("long") for c in ("more_leaves", "more_saved", "more_children")})
        classes = classes.withColumn("top", F.lit(None).cast("long"))
    else:
        keyed = save(keyed.withColumn("next", F.when(F.col("more"), _digest(F.col("prefix"), _digest(F.col("path"))))), "keyed")
        tops = keyed.where("more").select(F.col("next").alias("prefix"), F.col("low").alias("top"))
        classes = keyed.join(totals, "next", "left").drop("next").fillna(0, ["more_leaves", "more_saved", "more_children"]).join(tops, "prefix", "left")
    classes = save(classes, "classes")
    placed = classes.repartitionByRange("prefix", "path").sortWithinPartitions("prefix", "path")
    most, level = SHARD_NODES, LEVEL
    nodes = save(map_batches(placed, lambda batches: _shards(batches, most, level), _SCHEMA), "nodes")
    spine = nodes.where("key is not null")
    firsts = ("seg", "prefix", "depth", "size", "parent_key", "above")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens", "more_leaves", "more_saved")
    merged = save(
        spine.groupBy("key").agg(
            *(F.first(c).alias(c) for c in firsts), *(F.sum(c).alias(c) for c in sums), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), F.max("more").alias("more")
        ),
        "spine",
    )
    on_spine = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more_kids"))
    joined = merged.join(on_spine, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more_kids", F.lit(0)))
    own_leaves = F.when(F.col("more"), F.col("more_leaves")).when(F.col("n_children") == 0, 1).otherwise(0)
    own_saved = (F.col("n_convs") - 1) * F.col("size") + F.col("more_saved")
    joined = save(joined.withColumns({"own_leaves": own_leaves.cast("long"), "own_saved": own_saved}), "spine")
    up = joined.select(F.explode("above").alias("key"), "own_leaves", "own_saved").groupBy("key").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    whole = joined.join(up, "key").join(parents, "parent_key", "left").withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved"), "parent_conv_id": F.col("parent")}
    )
    # nodes right below the spine ask for their parent by shard, so that no key is hot
    known = spine.select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    fringe = nodes.where("key is null and parent_key is not null").join(known, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("parent"))
    out = ("seg", "prefix", *_OUT)
    inner = nodes.where("key is null and parent_key is null")
    return inner.select(*out).unionByName(fringe.select(*out)).unionByName(whole.select(*out)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))


def _totals(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(next, more_leaves, more_saved, more_children) of all that lies behind a segment, from the tries of single segments.

    A trie's own numbers go to its smallest conversation; a conversation's numbers are summed up from each segment to its last, and those sums over
    the conversations of a trie. So each trie below counts once.
    """
    roots = nodes.where(F.col("depth") == F.col("seg") * LEVEL).select("prefix", F.col("conv_id").alias("owner"), "n_leaves", "saved_tokens", "n_children")
    rows = found.select("conv_id", "seg", "prefix").join(roots, "prefix")
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    owned = lambda c: F.sum(F.when(F.col("conv_id") == F.col("owner"), F.col(c)).otherwise(0)).over(behind)
    summed = rows.select("prefix", "n_children", owned("n_leaves").alias("leaves"), owned("saved_tokens").alias("saved"))
    of_prefix = summed.groupBy(F.col("prefix").alias("next")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.max("n_children").alias("more_children"))
    return save(of_prefix, "totals")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = segments(*rebuilt(turns))
    ended = ends(found)
    later = found.where("seg > 0")
    nodes = _nodes(found, ended, _totals(later, _nodes(later, ended, None)))
    return nodes.where((F.col("seg") == 0) | (F.col("depth") > F.col("seg") * LEVEL)).select(*_OUT)
