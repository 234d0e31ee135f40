"""Places of repeated keys over a whole table, without moving texts.

Each task gathers places (key, document, place) in arrays. Of equal keys in one
task only the first place is sent on, so a key that a third of all documents
hold arrives at most once from each flush of a task; the rest are settled where
they are: they repeat something earlier. The sent places meet by key.

A document is its whole-number id (null: after all others) and the crc32 of its
text, in this order; rows equal in both are the same document listed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardbook.llm import blobs, frames

U64 = np.uint64
LAST = (1 << 63) - 1
FLUSH = 600_000
SENT = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("check", pa.binary()), ("doc", pa.binary()), ("crc", pa.binary()), ("place", pa.binary()), ("more", pa.binary())])
SENT_SQL = "bucket int, key binary, check binary, doc binary, crc binary, place binary, more binary"
PLACES = pa.schema([("doc", pa.int64()), ("crc", pa.int64()), ("places", pa.list_(pa.int32()))])
PLACES_SQL = "doc long, crc long, places array<int>"


def identity(doc_id: Column, text: Column) -> list[Column]:
    """The columns doc and crc of a row."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("doc"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc")]


class Places:
    """Gathered (key, check, doc, crc, place); ``check`` is a second hash of what the key stands for."""

    KINDS = (np.uint64, np.uint32, np.int64, np.uint32, np.int32)

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(tuple(c.astype(k) for c, k in zip(columns, self.KINDS)))
        self.size += len(columns[0])

    def sorted(self) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """All columns by key, check and document order, each place once, and where a new key starts."""
        cols = tuple(np.concatenate(c) for c in zip(*self.parts)) if self.parts else tuple(np.zeros(0, k) for k in self.KINDS)
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
        cols = tuple(c[order] for c in cols)
        if len(order):
            new_key = np.r_[True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]
            fresh = new_key | np.r_[True, (np.diff(cols[2]) != 0) | (np.diff(cols[3]) != 0) | (np.diff(cols[4]) != 0)]
            return tuple(c[fresh] for c in cols), new_key[fresh]
        return cols, np.zeros(0, bool)

    def flush(self, buckets: int) -> pa.RecordBatch:
        """Rows to send: first places by bucket, and settled ones (without key) by document."""
        cols, new = self.sorted()
        self.parts, self.size = [], 0
        more = np.r_[~new[1:], False] if len(new) else new
        first = tuple(c[new] for c in cols) + (more[new],)
        plain = not first[1].any()  # no second hash in use
        out = [(b, *[None if plain and i == 1 else c[s].tobytes() for i, c in enumerate(first)]) for b, s in blobs.cut(first[0], buckets)]
        rest = tuple(c[~new] for c in cols)
        if len(rest[0]):
            order = np.argsort(mixed := _spread(rest[2]), kind="stable")
            rest = tuple(c[order] for c in rest)
            out += [(b, None, None, rest[2][s].tobytes(), rest[3][s].tobytes(), rest[4][s].tobytes(), None) for b, s in blobs.cut(mixed[order], buckets)]
        return blobs.rows(out, SENT)


def _spread(doc: np.ndarray) -> np.ndarray:
    return (doc.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)


def scatter(read, buckets: int):
    """A function for mapInArrow that gathers what ``read(batch)`` yields for Places.add()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Places()
        for b in batches:
            for columns in read(b):
                got.add(*columns)
                if got.size > FLUSH:
                    yield got.flush(buckets)
        yield got.flush(buckets)
    return run


def repeated(sent: DataFrame, partitions: int, firsts: bool) -> DataFrame:
    """All places of keys that stand at more than one place, as rows for ``collected``; with
    ``firsts`` false, without the first place of each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, more, out = Places(), [], []
        for r in blobs.gathered(batches):
            doc, crc, place = np.frombuffer(r["doc"], np.int64), np.frombuffer(r["crc"], np.uint32), np.frombuffer(r["place"], np.int32)
            if r["key"] is None:
                out.append((doc, crc, place))
            else:
                key, some = np.frombuffer(r["key"], np.uint64), np.frombuffer(r["more"], bool)
                got.add(key, np.frombuffer(r["check"], np.uint32) if r["check"] else np.zeros(len(key), np.uint32), doc, crc, place)
                more.append(key[some])
        (key, _, doc, crc, place), new = got.sorted()
        if firsts:
            keep = ~new | (np.r_[~new[1:], False] if len(new) else new) | np.isin(key, np.concatenate(more) if more else key[:0])
        else:
            keep = ~new
        out.append((doc[keep], crc[keep], place[keep]))
        yield to_documents(*(np.concatenate(c) for c in zip(*out)), partitions)

    return frames.arrow(blobs.by_bucket(sent, partitions), run, FOUND_SQL)


FOUND = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("crc", pa.binary()), ("place", pa.binary())])
FOUND_SQL = "bucket int, doc binary, crc binary, place binary"


def to_documents(doc: np.ndarray, crc: np.ndarray, place: np.ndarray, partitions: int) -> pa.RecordBatch:
    """One row for each range of documents' hashes, each document whole in one."""
    spread = _spread(doc)
    order = np.argsort(spread, kind="stable")
    doc, crc, place = doc[order], crc[order].astype(np.uint32), place[order].astype(np.int32)
    return blobs.rows([(b, doc[s].tobytes(), crc[s].tobytes(), place[s].tobytes()) for b, s in blobs.cut(spread[order], partitions)], FOUND)


def collected(found: DataFrame, partitions: int) -> DataFrame:
    """One row (doc, crc, places) for each document, places ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(np.frombuffer(r[c], t) for c, t in (("doc", np.int64), ("crc", np.uint32), ("place", np.int32))) for r in blobs.gathered(batches)]
        if rows:
            doc, crc, place = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((place, crc, doc))
            doc, crc, place = doc[order], crc[order], place[order]
            same = np.r_[False, (np.diff(doc) == 0) & (np.diff(crc) == 0)] if len(doc) else np.zeros(0, bool)
            again = same & np.r_[False, np.diff(place) == 0] if len(doc) else same
            doc, crc, place, same = doc[~again], crc[~again], place[~again], same[~again]
            new = np.flatnonzero(~same)
            for lo in range(0, len(new), 4096):
                at = np.r_[new[lo:lo + 4096], new[lo + 4096] if lo + 4096 < len(new) else len(doc)]
                lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(place[at[0]:at[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[at[:-1]]), pa.array(crc[at[:-1]].astype(np.int64)), lists], schema=PLACES)

    return frames.arrow(blobs.by_bucket(found, partitions), run, PLACES_SQL)
