"""Quality by compression: Zstandard dictionaries of good and of bad labelled texts.

A text is compressed with either dictionary. The normalised difference of the sizes, and how far the text
compresses at all, become a probability by logistic calibration.

Defined cases: a null or empty text has no sizes to compare and gets the share of good labels. Without labels of both kinds
every text gets that share. Whole texts are read. Rows that share an id are each scored; their label is the largest. Other columns are ignored. An empty
table gives an empty result. Where a sample is too small to train a dictionary on, its texts themselves are the (raw) dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import training
from .batches import Batches, map_batches

SAMPLE_ROWS = 4000  # calibrated on about so many labelled texts of either kind
DICTIONARY_ROWS = 1000  # of these, so many of either kind are for the dictionaries
DICTIONARY_BYTES, LEVEL = 65_536, 1
DICTIONARY_TEXT = 65_536  # longer texts, in characters, are calibrated on but not for the dictionaries: so the driver gets 2 * DICTIONARY_ROWS of these at most


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    share: float


def _dictionary(texts: list[str]) -> bytes:
    data = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small texts: the texts themselves
        return b"".join(data)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes by the two dictionaries."""

    def __init__(self, model: Model) -> None:
        self.by = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> list[float]:
        raw = text.encode()
        good, bad = (len(c.compress(raw)) for c in self.by)
        low = np.log((good + bad) / (2 * len(raw) + 30))
        return [10 * (bad - good) / (bad + good), low, low * low]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries and calibration from rows that are not held out. The driver gets the dictionaries' texts and three numbers for each sampled text."""
    share = training.sample_share(labels, label, id_col)
    picked = training.sample(docs, labels, label, rows, id_col, text_col).where("text <> ''").withColumn("y", F.col("label").cast("long"))
    turn = F.xxhash64("id", F.lit(11))
    of = lambda y: [r["text"] for r in picked.where((F.col("y") == y) & (F.length("text") <= DICTIONARY_TEXT)).orderBy(turn, "id").limit(DICTIONARY_ROWS).select("text").collect()]
    good, bad = of(1), of(0)
    model = Model(_dictionary(good), _dictionary(bad), np.zeros(4), share)
    if not good or not bad:
        return model

    def measure(batches: Batches) -> Batches:
        sizes = Sizes(model)
        for batch in batches:
            x = np.array([sizes.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column(1)], ["d", "low", "low2", "y"])

    seen = map_batches(picked.select("text", "y"), measure, "d double, low double, low2 double, y long").toPandas()
    y = seen["y"].to_numpy().astype(float)
    model.weights = training.fit_logistic(seen[["d", "low", "low2"]].to_numpy(), y)
    # the sample holds the kinds in other shares than the labels do
    here = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.weights[-1] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1)."""

    def run(batches: Batches) -> Batches:
        sizes = Sizes(model) if model.weights.any() else None
        for batch in batches:
            p = np.full(len(batch), model.share)
            if sizes is not None:
                texts = batch.column(1).to_pylist()
                has = [k for k, t in enumerate(texts) if t]
                if has:
                    p[has] = training.logistic(np.array([sizes.features(texts[k]) for k in has]), model.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [id_col, "score"])

    ids = docs.select(id_col, text_col)
    return map_batches(ids, run, T.StructType([ids.schema.fields[0], T.StructField("score", T.DoubleType())]))
