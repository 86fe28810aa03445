"""Language identification by rank-order profiles of letter n-grams (out-of-place distance).

Grams of one to three letters lie inside words, which are padded by a blank on either side. A profile lists
the most frequent grams by rank. A text's distance to a language is the sum over its own profile of
the difference in rank, or the most possible for grams that the language's profile lacks, as a share of the most possible.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and distance 1, and so is any text when
nothing was learned. Ties go to the language that sorts first. Whole texts are read; other columns are passed on. Repeated rows
are each judged. An empty table teaches nothing and gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import training
from .batches import Batches, map_batches

PROFILE, OWN = 400, 300  # grams in a language's profile and in a text's
SAMPLE_ROWS = 2000  # learned from about so many texts of each language
_SHARPNESS = 30.0
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text; 21 bits a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[_BLANK], np.where(_letters()[c], c, _BLANK), [_BLANK]]).astype(np.int64)
    letter = c != _BLANK
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    grams = np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
    return np.unique(grams, return_counts=True)


def top_grams(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent, in order of rank; ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, list[int]]:
    """Profiles from rows that are not held out. What reaches the driver is PROFILE codes a language."""
    picked = training.sample(docs, None, lang_col, rows, id_col, text_col)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = gram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counted = map_batches(picked.select("text", F.col("label").cast("string")), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "distance")) -> DataFrame:
    """``docs`` with three more columns, by the names in ``out``: language, score (0 to 1) and distance (0 to 1, to the language named).

    A column of ``docs`` by one of these names is an error: give other names.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = sorted(profiles)
    tables = []
    for name in names:
        codes = np.array(profiles[name], np.int64)
        order = np.argsort(codes)
        tables.append((codes[order], order.astype(np.int64)))

    def judge(text: str | None) -> tuple[str, float, float]:
        codes, counts = gram_counts(text or "")
        if not len(codes) or not names:
            return "und", 0.0, 1.0
        own = top_grams(codes, counts, OWN)
        ranks = np.arange(len(own))
        away = np.empty(len(names))
        for k, (known, rank) in enumerate(tables):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            away[k] = np.where(known[at] == own, np.minimum(np.abs(rank[at] - ranks), PROFILE), PROFILE).sum() / (PROFILE * len(own))
        likely = np.exp(-_SHARPNESS * (away - away.min()))
        best = int(away.argmin())
        return names[best], float(likely[best] / likely.sum()), float(away[best])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column(at_text)]
            more = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *out])

    at_text = docs.columns.index(text_col)
    added = [T.StructField(n, t) for n, t in zip(out, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *added]))
