"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction.

A document's set is its distinct shingles of ``k`` words (with fewer words, the whole
sequence as one). The sketch holds, ascending, the 64-bit hashes below 1 / ``scale`` of the
hash range; where none is, the smallest hash, so that only a text without words has an
empty sketch. As the threshold is the same for all, sketches merge by union, and the share
of one sketch's hashes that another has estimates containment however unequal the two are.

``sketch_documents`` adds the sketch to each document without a shuffle. ``sketch_edits``
compares each document with the next one and with a copy of which the tail is replaced by
the next one's head: the ids alone are put in order first, which gives ranges and the first
document of each; then every text moves once, compressed, to the task of its range, where
the documents are read in order, one batch at a time; only a range's first document goes to
the range before as well.

Edge cases. Null text is empty. Documents stand in ascending order of id (null first), those of one
id in order of a hash of their text; rows that repeat id and text follow one another and travel as
one row with a count. The last document's next is the first, a single document's next is itself.
The share of an empty sketch is 1 in an empty one, else 0. An empty table stays empty.
Further columns pass through ``sketch_documents``; ``sketch`` replaces a column of that name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardbook.llm import frames, textops
from wardbook.llm.blobs import take

#: shingles in words, and the part of the hashes that a sketch keeps: one in SCALE
K, SCALE = 5, 8


def _sketches(texts: pa.Array, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending hashes of each text's sketch, one after another, and where each begins (n + 1)."""
    data, offs = textops.column(texts)
    limit, out, counts = np.uint64(((1 << 64) - 1) // scale), [], np.zeros(len(offs) - 1, np.int64)
    for lo, hi in textops.chunks(offs):
        found = textops.words(data, offs[lo:hi + 1], textops.NOT_SPACE, lower=True)
        h, n = found.hashes(), found.counts
        shingle, whole = textops.shingles(h, found.first, k)
        of = found.text
        low = whole & (shingle < limit)
        text, value = of[low], shingle[low]
        # texts of fewer words, and those without a hash below the limit
        more = [(t, textops.fold(h[found.first[t]:found.first[t + 1]])) for t in np.flatnonzero((n > 0) & (n < k)).tolist()]
        rest = np.flatnonzero((n >= k) & (np.bincount(text, minlength=hi - lo) == 0))
        more += [(t, shingle[found.first[t]:found.first[t + 1] - k + 1].min()) for t in rest.tolist()]
        if more:
            text = np.r_[text, np.array([t for t, _ in more], np.int64)]
            value = np.r_[value, np.array([v for _, v in more], np.uint64)]
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        out.append(value[new])
        counts[lo:hi] = np.bincount(text[new], minlength=hi - lo)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(counts)]


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Sketches as bytes: eight for each hash, highest first."""
    flat = values.astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _pick(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[rows]
    return take(values, first[:-1][rows], n), np.r_[0, np.cumsum(n)]


def _shares(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each sketch in ``a`` the share of hashes that its counterpart in ``b`` has."""
    n, m = np.diff(a[1]), np.diff(b[1])
    row = np.r_[np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]
    value = np.r_[a[0], b[0]]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(n))
    return np.where(n > 0, both / np.maximum(n, 1), np.where(m == 0, 1.0, 0.0))


def sketch_documents(docs: DataFrame, text: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """``docs`` with ``sketch``: eight bytes (big-endian) for each hash, ascending."""
    make = lambda: lambda texts: [_binary(*_sketches(texts, k, scale))]
    return frames.map_text(docs, text, make, T.StructType([T.StructField("sketch", T.BinaryType())]))


def merge_sketches(sketched: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """The union of the sketches of each ``by``, as rows (``by``, hash): a group may be of any size."""
    name = lambda c: F.col(f"`{c}`")
    at = sketched.where(F.length(name(sketch)) > 0).select(name(by).alias(by), name(sketch).alias("s"), F.explode(F.expr(f"sequence(1, length(`{sketch}`), 8)")).alias("i"))
    return at.select(F.col(f"`{by}`"), F.substring(F.col("s"), F.col("i"), F.lit(8)).alias("hash")).distinct()


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (has, id, tie, text) dealt out by ranges of the order, sorted within each: range,
    border (the next range's first document), has, id, tie, copies, text (compressed)."""
    own = docs.select("has", "id", "tie").repartitionByRange(ranges, "has", "id", "tie")
    starts = own.groupBy(F.spark_partition_id()).agg(F.min(F.struct("has", "id", "tie")).alias("first"))
    bounds = sorted(((r["first"]["has"], *([r["first"]["id"]] if r["first"]["has"] else []), r["first"]["tie"]) for r in starts.collect()))
    kinds = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            has, ids, ties, texts = (b.column(i).to_pylist() for i in range(4))
            found: dict[tuple, list] = {}
            for i, key in enumerate(zip(has, ids, ties)):
                found.setdefault(key, [i, 0])[1] += 1
            rows: list[list] = [[] for _ in range(7)]
            for key, (i, copies) in found.items():
                order = key if key[0] else (key[0], key[2])
                r = bisect.bisect_right(bounds, order) - 1
                data = (texts[i] or "").encode()
                packed = len(data).to_bytes(8, "big") + (codec.compress(data, asbytes=True) if data else b"")
                for to, border in [(r, False), *([((r - 1) % len(bounds), True)] if bounds[r] == order else [])]:
                    for column, x in zip(rows, (to, border, *key, copies, packed)):
                        column.append(x)
            kind = [pa.int32(), pa.bool_(), pa.bool_(), b.schema.field(1).type, pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kind)], names=["range", "border", "has", "id", "tie", "copies", "packed"])

    sent = frames.arrow(docs, run, f"range int, border boolean, has boolean, id {kinds}, tie long, copies long, packed binary")
    return sent.repartition("range").sortWithinPartitions("range", "border", "has", "id", "tie")


def sketch_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, scale: int = SCALE, part: int = 4) -> DataFrame:
    """For each document: id, n_chars, sketch; the edited text (its last n_chars // ``part`` code points replaced
    by as many, or all, from the start of the next document) as SHA-256 and sketch; ``in_edited`` and
    ``in_next``: the share of its sketch found in that of the edited text and of the next document;
    ``like_edited`` and ``like_next``: the same as shares of both sketches' union (Jaccard)."""
    name = lambda c: F.col(f"`{c}`")
    keyed = docs.select(name(doc_id).isNotNull().alias("has"), name(doc_id).alias("id"), F.xxhash64(F.coalesce(name(text), F.lit(""))).alias("tie"), name(text).alias("text"))
    ranges = 2 * frames.parts(docs.sparkSession)

    def pairs(ids: list, texts: list[str], copies: list[int], following: list[int], own: int) -> pa.RecordBatch:
        """Rows of the first ``own`` documents; ``following[i]``: where i's next document stands."""
        row, nxt = [], []
        for i in range(own):
            if copies[i] > 1:  # all copies but the last are followed by a copy
                row.append(i)
                nxt.append(i)
            row.append(i)
            nxt.append(following[i])
        changed = []
        for i, j in zip(row, nxt):
            n = len(texts[i])
            changed.append(texts[i][:n - n // part] + texts[j][:n // part])
        times = np.array([copies[i] - 1 if i == j and copies[i] > 1 else 1 for i, j in zip(row, nxt)], np.int64)
        times[[x for x in range(1, len(row)) if row[x] == row[x - 1]]] = 1
        mine = _sketches(pa.array(texts, pa.large_string()), k, scale)
        edited = _sketches(pa.array(changed, pa.large_string()), k, scale)
        a, b = _pick(*mine, np.array(row, np.int64)), _pick(*mine, np.array(nxt, np.int64))
        columns = [pa.array([ids[i] for i in row], kind), pa.array([len(texts[i]) for i in row], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in changed]), _binary(*a), _binary(*edited)]
        for other in (edited, b):
            share = _shares(a, other)
            n, m = np.diff(a[1]), np.diff(other[1])
            common = np.where(n > 0, share * n, 0)
            columns += [pa.array(share), pa.array(np.where(n + m > 0, common / np.maximum(n + m - common, 1), 1.0))]
        batch = pa.RecordBatch.from_arrays(columns, names=out.names)
        return batch if (times == 1).all() else batch.take(pa.array(np.repeat(np.arange(len(row)), times)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        unpack = lambda x: codec.decompress(x[8:], int.from_bytes(x[:8], "big"), asbytes=True).decode() if len(x) > 8 else ""
        held = None  # the document whose next one has not come yet: (range, key, id, text, copies)
        for b in batches:
            ids, texts, copies, following, size = [], [], [], [], 0
            last: list[tuple[str, int]] = []  # texts that only follow
            for r, border, has, i, tie, n, packed in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and not border and (r, (has, i, tie)) == held[:2]:
                    held = (*held[:4], held[4] + n)
                    continue
                t = unpack(packed)
                if held is not None and held[0] == r:
                    ids.append(held[2])
                    texts.append(held[3])
                    copies.append(held[4])
                    following.append(len(ids))  # the next one on the list, or the border
                    if border:
                        last.append((t, len(ids) - 1))
                    size += len(held[3])
                held = None if border else (r, (has, i, tie), i, t, n)
                if size > textops.CHUNK:
                    yield finish(ids, texts, copies, following, last, held)
                    ids, texts, copies, following, size, last = [], [], [], [], 0, []
            if ids:
                yield finish(ids, texts, copies, following, last, held)

    def finish(ids, texts, copies, following, last, held) -> pa.RecordBatch:
        own, texts = len(ids), list(texts)
        if held is not None:
            texts.append(held[3])
        for t, i in last:
            following[i] = len(texts)
            texts.append(t)
        return pairs(ids, texts, copies, following, own)

    ordered = _ranged(keyed, ranges)
    fields = "n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, in_edited double, like_edited double, in_next double, like_next double"
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *T._parse_datatype_string(fields).fields])
    out, kind = frames.to_arrow_schema(schema), frames.to_arrow_schema(schema).field("id").type
    return frames.arrow(ordered, run, schema)
