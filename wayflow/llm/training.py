"""Bounded samples of labelled rows, the held-out rule and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save

_GRAIN = 1_000_000


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5. Remainder 0 is held out; a null id has none and is not learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def _thinned(rows: DataFrame, group: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each group at most, by a hash of the id."""
    counts = rows.groupBy(group).count().collect()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(_GRAIN, _GRAIN * bound // r[1]))]) if counts else None
    return rows if share is None else rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_GRAIN)) < share[F.col(group)])


def sample(docs: DataFrame, labels: DataFrame | None, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of about ``bound`` rows of each label value, none of them held out.

    The label is a column of ``labels`` or, without such a table, of ``docs``. The ids picked are at most
    ``bound`` times the number of label values in expectation, hence the broadcast; texts are not shuffled.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if labels is None:
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label).alias("label"))
        rows = rows.where(F.col("label").isNotNull() & (fold(F.col("id")) != 0))
        picked = _thinned(rows, "label", bound)
    else:
        rows = labels.where(F.col(label).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
        picked = texts.join(F.broadcast(_thinned(rows, "label", bound)), "id")
    return save(picked.select("id", "text", "label"), "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept last) of a ridge-penalised logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or len(set(y.tolist())) < 2:
        w[-1] = 0.0 if not len(y) else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    ridge = np.full(x.shape[1], weight * len(y) ** 0.5)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))


def sample_share(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """Share of label 1 among all rows that are not held out, kept off 0 and 1; one half without any."""
    found = labels.where(fold(F.col(id_col)) != 0).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if found is None else float(np.clip(found, 1e-3, 1 - 1e-3))


def label_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> tuple[int, int]:
    """Ids of label 0 and of label 1 that are not held out, counted as ``sample`` takes them."""
    rows = labels.where(F.col(label).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg(F.max(F.col(label).cast("long")).alias("y"))
    found = rows.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    return int(found[0] or 0), int(found[1] or 0)
