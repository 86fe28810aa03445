"""The perfect-hash recount against plain Python counts."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayflow.llm import divergence
from wayflow.llm.perfect_hash import PerfectHash

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(s for g, s in counts if g == lang)
        whole = sum((counts[lang, s] for s in groups), collections.Counter())

        def share(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in groups}
        q = share(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            best = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def rows() -> list[tuple]:
    r = random.Random(3)
    words = [w + str(k) if k % 3 else w + "é" * (k % 4) for k, w in enumerate(["road", "Lane", "BRIDGE", "signal", "übung", "日本", "queue", "light", "a", "of"] * 6)]
    words += ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    out = []
    for i in range(300):
        lang = r.choice(["en", "en", "en", "de", "fr", None])
        source = r.choice(["hot"] * 6 + ["s1", "s2", "s3", "", None])
        own = words[::2] if source == "s1" else words
        out.append((i, " ".join(r.choice(own) + r.choice([",", "", "1x", "@", "[", "`b", "\x7f"]) for _ in range(r.randrange(60))), lang, source))
    out += [(None, "road lane", "en", "s1"), (900, None, "en", "empty"), (901, "", "xx", "s1"), (902, "once", "xx", "s2"), (903, "42 !?", "yy", "s1"), (904, "lane " * 30_000, "en", "s2"), (5, "road", "en", "s1"), (5, "road", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    return made.repartition(5).withColumns({"term": F.lit(1), "n": F.lit("clash"), "shard": F.lit(2), "value": F.lit(3)})


def said(df) -> set[tuple]:
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_as_plain_counts(docs):
    assert said(divergence.audit(docs)) == plain(rows())
    assert said(divergence.audit(docs, least=8)) == plain(rows(), least=8)
    assert divergence.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("held", "cells"), [(100, 1), (2, 1 << 20)])
def test_many_shards_rounds_and_blocks(docs, monkeypatch, held, cells):
    """Shards of few keys, in one round or many; arrays that are put out after every batch; blocks of few slots."""
    for name, value in (("SHARD_KEYS", 40), ("HELD", held), ("TASK_CELLS", cells), ("BLOCK_SLOTS", 16), ("BLOCK_CELLS", 64)):
        monkeypatch.setattr(divergence, name, value)
    assert said(divergence.audit(docs)) == plain(rows())


def test_top_terms_break_ties_by_item(docs, monkeypatch):
    monkeypatch.setattr(divergence, "TOP_TERMS", 7)
    assert said(divergence.audit(docs)) == plain(rows(), top=7)


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        table = PerfectHash(keys)
        assert sorted(table.numbers(keys).tolist()) == list(range(len(keys)))
        assert table.numbers(r.integers(0, 1 << 63, 100).astype(np.uint64)).max(initial=-1) < max(1, len(keys))
    with pytest.raises(ValueError):
        PerfectHash(np.zeros(2, np.uint64))


def test_strange_terms_are_refused():
    """A term that was not kept gets some number of the hash; the stored key says no."""
    stored = sorted(f"w{k}" for k in range(500))
    keys = divergence._key_hashes(divergence.hashes(pa.array(["en"] * 500)), divergence.hashes(pa.array(stored)))
    table = PerfectHash(keys)
    slot_of = np.zeros(500, np.int32)
    slot_of[table.numbers(keys)] = np.arange(500)
    shard = divergence.Shard(table, slot_of, {"en": (0, 500, 8)}, pa.array(stored))
    others = pa.array([f"x{k}" for k in range(2000)] + stored)
    hashed = divergence._key_hashes(divergence.hashes(pa.array(["en"] * 2500)), divergence.hashes(others))
    assert shard.slots(["en"], np.zeros(2500, np.int64), hashed, others).tolist() == [-1] * 2000 + list(range(500))
    assert set(shard.slots(["de"], np.zeros(2500, np.int64), hashed, others).tolist()) == {-1}


def test_shares_of_large_counts():
    for count, total in ((0, 1), (1, 7), (10**12, 10**15), (123_456_789_012_345, 2**52)):
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 1_000_000_000 * count // total
