"""Arrow batches of modest size, groups within sorted partitions, and column names that clash with nothing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts may be long, and a batch lies in memory several times over (JVM, Python, and again on the way back): a batch has so many rows and about so many bytes at most.
MOST_ROWS, MOST_BYTES = 1000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns memory that a worker's allocators hold but don't use; an idle worker shares its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, body: Callable[[Batches], Batches], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most MOST_ROWS rows and about MOST_BYTES. Lowers the session's settings where they are larger, and leaves them so: plans run later."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= MOST_ROWS:
        conf.set(_ROWS, str(MOST_ROWS))
    # a size may be said with a unit; a bare number counts bytes
    said = conf.get(_BYTES)
    if not said.isdigit() or not 0 < int(said) <= MOST_BYTES:
        conf.set(_BYTES, str(MOST_BYTES))

    def run(batches: Batches) -> Batches:
        yield from body(batches)
        give_back()

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column (in either case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def groups(batches: Batches, keys: int, most_rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups, with the groups' first rows and the end; of rows sorted by the first ``keys`` columns (numbers).

    A batch ends with a group once it has ``most_rows`` rows; only a larger group makes a larger batch.
    """
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(parts)
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(max(0, len(whole) - 1), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        return whole, np.concatenate([[0], np.flatnonzero(new) + 1, [len(whole)]])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= most_rows:
            whole, at = cut(held)
            if len(at) > 2:  # the last group may go on
                yield whole.slice(0, int(at[-2])), at[:-1]
                whole = whole.slice(int(at[-2]))
            held = [whole]
    if held:
        yield cut(held)


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of the bytes of a binary column whose values all have ``width`` bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    start = int(at[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + width * len(column)].reshape(-1, width)
