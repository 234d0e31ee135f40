"""Numpy arrays as rows: what a task has gathered travels as few binary rows, one for
each bucket of its keys, instead of one row for each entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket (a range of hashes) of each hash; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The non-empty buckets of ascending hashes, and where their entries lie."""
    b = bucket_of(sorted_hashes, buckets)
    edge = np.flatnonzero(np.r_[True, np.diff(b) != 0]) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(edge, np.r_[edge[1:], len(b)]):
        yield int(b[lo]), slice(int(lo), int(hi))


def rows(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*records)) if records else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def gathered(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    """All rows of a partition whose size the caller's number of buckets bounds."""
    return [r for b in batches for r in b.to_pylist()]


def by_bucket(df: DataFrame, partitions: int, key: str = "bucket") -> DataFrame:
    return df.repartition(partitions, key)


def take(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start+length]``, one after another."""
    to = np.cumsum(length)
    return flat[np.repeat(start - (to - length), length) + np.arange(int(to[-1]) if len(to) else 0)]
