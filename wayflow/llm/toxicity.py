"""Toxic passages by maximum-scoring segments.

A token is a lower-cased word. Its score is the log-odds of toxic against clean texts with
an informative Dirichlet prior (the token's rate in both together), less a drift that makes clean text score
below zero. One pass over the prefix sums finds all maximal-scoring segments of a text. A segment's
score S among n tokens is worth ``lambda S - ln(K n)`` (extreme-value statistics); lambda solves
``sum p e^(lambda s) = 1`` over the scores of clean text and K comes from the best segments of clean texts.
A text's worth, over all significant segments, becomes a probability by logistic calibration.

Defined cases: a null text counts as empty; a text without tokens has no segments and gets the score of worth 0.
Without labels of both kinds the score is the share of toxic labels. Whole texts are read. Rows that share an id are each scored; their
label is the largest. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import training
from .batches import Batches, map_batches

SAMPLE_ROWS = 10_000  # learned from about so many labelled texts of either kind
PRIOR_SHARE, DRIFT, LEAST_Z = 0.05, 0.08, 3.0  # the prior weighs this share of all tokens counted
#: A segment counts if fewer than so many such would be expected in a clean text.
EXPECTED = 0.01
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    size: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(at: np.ndarray, gains: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments as (score, first, last token): ``gains`` at positions ``at``, ``-drift`` elsewhere.

    Linear in the number of positive tokens. The stack holds candidates by the sums left of and up to their
    ends; a new one joins back to the last candidate with a smaller left sum (each keeps the place of its
    own such), if its own end is higher.
    """
    stack: list[list[float]] = []  # left sum, right sum, first, last, place of the last candidate with a smaller left sum
    gained = 0.0
    for p, g in zip(at.tolist(), gains.tolist(), strict=True):
        left = gained - drift * p
        gained += g + drift
        if g <= 0:
            continue
        new = [left, gained - drift * (p + 1), p, p]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= new[0]:
                k = int(stack[k][4])
            if k < 0 or stack[k][1] >= new[1]:
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
        stack.append([*new, k])
    return [(b - a, int(i), int(j)) for a, b, i, j, _ in stack]


def _found(text: str, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    words = tokens(text)
    scores = model.scores
    hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
    at = np.array([i for i, _ in hits], np.int64)
    gains = np.array([s for _, s in hits])
    return len(words), segments(at, gains, DRIFT)


def worth(text: str, model: Model) -> tuple[float, float, int]:
    """Summed worth of the significant segments, the greatest, and their number."""
    n, found = _found(text, model)
    if not n:
        return 0.0, 0.0, 0
    floor = np.log(max(model.size * n, 1.0))
    good = [x for s, _, _ in found if (x := model.rate * s - floor) > -np.log(EXPECTED)]
    return float(sum(good)), float(max(good, default=0.0)), len(good)


def _features(w: float, best: float) -> list[float]:
    return [np.log1p(w), float(best > 0)]


def _rate(values: np.ndarray, shares: np.ndarray) -> float:
    """Positive root of ``sum p e^(lambda s) = 1``."""
    lo, hi = 1e-6, 1.0
    excess = lambda x: float((shares * np.exp(np.minimum(x * values, 600))).sum() - 1)
    if values.max(initial=0) <= 0:
        return 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Token scores, extreme-value constants and calibration from rows that are not held out.

    The driver gets the tokens of the bounded sample that are sure enough (LEAST_Z), and two numbers for each sampled text.
    """
    n_good, n_bad = training.label_counts(labels, label, id_col)
    picked = training.sample(docs, labels, label, rows, id_col, text_col)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted(set(tokens(text)))  # repeats within a text say nothing new
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y] * len(words), pa.int64())], ["token", "y"])

    texts = picked.select("text", F.col("label").cast("long").alias("y"))
    counted = map_batches(texts, count, "token string, y long").groupBy("token").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    totals = counted.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = float(totals[0] or 0), float(totals[1] or 0)
    if not bad or not good:
        share = n_bad / max(n_good + n_bad, 1)
        return Model(weights=np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    mass = PRIOR_SHARE * (bad + good)
    prior = PRIOR_SHARE * (F.col("bad") + F.col("good"))
    b, g = F.col("bad") + prior, F.col("good") + prior
    odds = F.log(b / (bad + mass - b)) - F.log(g / (good + mass - g))
    sure = counted.select("token", "bad", "good", odds.alias("odds"), (odds / F.sqrt(1 / b + 1 / g)).alias("z")).where(F.abs("z") >= LEAST_Z)
    surest = sure.collect()
    model = Model({r["token"]: r["odds"] - DRIFT for r in surest})
    values = np.array([*(r["odds"] - DRIFT for r in surest), -DRIFT])
    shares = np.array([*(r["good"] / good for r in surest), 0.0])
    shares[-1] = 1 - shares.sum()
    model.rate = min(_rate(values, shares), 4.0)

    def best(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                n, found = _found(text, model)
                out.append((n, max((s for s, _, _ in found), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64()), batch.column(1)], ["n", "s", "y"])

    clean = map_batches(texts.where("y = 0"), best, "n long, s double, y long").where("n > 0 and s > 0").select("n", "s").toPandas()
    if len(clean):
        # mean of exp(-lambda S) over texts of n tokens is about 1 / (K n)
        model.size = float(np.clip(1 / np.mean(np.exp(-np.minimum(model.rate * clean["s"], 500)) * clean["n"]), 1e-6, 10.0))

    def worths(batches: Batches) -> Batches:
        for batch in batches:
            out = [worth(x, model) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), batch.column(1)], ["w", "best", "y"])

    seen = map_batches(texts, worths, "w double, best double, y long").toPandas()
    x = np.array([_features(*r) for r in zip(seen["w"], seen["best"], strict=True)])
    y = seen["y"].to_numpy().astype(float)
    model.weights = training.fit_logistic(x, y)
    # the sample holds the kinds in other shares than the labels do
    model.weights[-1] += np.log(n_bad / n_good) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), n_segments, worth, passages (first:last word numbers of the significant segments)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows, said = [], []
            for text in batch.column(1):
                n, found = _found(text.as_py() or "", model)
                floor = np.log(max(model.size * n, 1.0))
                good = [(model.rate * s - floor, i, j) for s, i, j in found if model.rate * s - floor > -np.log(EXPECTED)]
                rows.append((sum(g for g, _, _ in good), max((g for g, _, _ in good), default=0.0), len(good)))
                said.append(",".join(f"{i}:{j}" for _, i, j in good))
            x = np.array([_features(w, b) for w, b, _ in rows]).reshape(len(rows), 2)
            p = training.logistic(x, model.weights)
            cols = [pa.array(p), pa.array([r[2] for r in rows], pa.int64()), pa.array([float(r[0]) for r in rows], pa.float64()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = [id_col, "score", "n_segments", "worth", "passages"]
    ids = docs.select(id_col, text_col)
    kinds = (T.DoubleType(), T.LongType(), T.DoubleType(), T.StringType())
    return map_batches(ids, run, T.StructType([ids.schema.fields[0], *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))]))
