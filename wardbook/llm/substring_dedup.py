"""Substring dedup: runs of ``length`` words that occurred before are removed.

By suffix automata, of reference shards that are drawn up so that no automaton
and no broadcast grows with the corpus. The documents' earlier texts are the
reference, which has no size bound; so it is not cut by size but by content:

1. In each window of ``length`` words the ``gram`` words with the smallest hash
   are its anchor: equal windows have equal anchors, at the same place. Places of
   anchors that occur once in the whole table are dropped.
2. Around each place of a repeated anchor, all words that may share a window
   with it are one piece; pieces of one anchor form a shard. In the order of
   documents, each piece is streamed through the shard's suffix automaton for its
   matching statistics (the longest match with an earlier piece that ends at each
   word); where they reach ``length``, and the match stands at another place than
   the piece itself, the words are covered. Then the piece joins the automaton. A
   piece equal to an earlier one is covered whole, without the automaton.
3. Covered words are taken out; overlapping runs merge.

Words are compared by 32 bits of their hashes, a run by ``length`` times that.

Edge cases. Null or empty text: no words, an empty result. Fewer words than a
window: nothing is removed. An overlapping recurrence in one document counts
(its earlier start stays). Rows of one id and one text are the same document
listed again and get the same answer; of one id, the texts are told apart by
crc32; null ids come last. Columns pass through; ``n_words``, ``n_removed`` and
``kept`` (the words left, one space between them) replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardbook.llm import blobs, frames, repeats, textops

U64 = np.uint64
PIECES = pa.schema([("bucket", pa.int32()), ("anchor", pa.binary()), ("doc", pa.binary()), ("crc", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("words", pa.binary())])
PIECES_SQL = "bucket int, anchor binary, doc binary, crc binary, start binary, size binary, words binary"


class Automaton:
    """A suffix automaton over several pieces; each state knows where its strings first ended."""

    __slots__ = ("next", "link", "size", "first")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _state(self, size: int, link: int, nxt: dict, first) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        k = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def add(self, piece: list[int], place: tuple, start: int) -> None:
        last = 0
        for i, c in enumerate(piece):
            q = self.next[last].get(c)
            if q is not None:  # known from an earlier piece
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, q, c)
                continue
            new = self._state(self.size[last] + 1, 0, {}, (place, start + i))
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)
            last = new

    def matches(self, piece: list[int], place: tuple, start: int, length: int) -> list[int]:
        """Ends in the piece of runs of ``length`` that stand elsewhere before."""
        out, state, size = [], 0, 0
        for i, c in enumerate(piece):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            state = self.next[state].get(c, 0)
            size = size + 1 if state else 0
            if size >= length:
                s = state
                while self.size[self.link[s]] >= length:
                    s = self.link[s]
                if self.first[s] != (place, start + i):
                    out.append(i)
        return out


def _anchors(gram: np.ndarray, first: np.ndarray, length: int, k: int) -> np.ndarray:
    """Positions that are the (leftmost) smallest of the ``length - k + 1`` grams of some window."""
    n, span = len(gram), length - k + 1
    if n < length:
        return np.zeros(0, np.int64)
    starts = np.arange(n) + length <= np.repeat(first[1:], np.diff(first))
    best, width = np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        other = best[step:]
        mine = best[:len(best) - step]
        best = np.r_[np.where(gram[mine] <= gram[other], mine, other), best[len(best) - step:]]
        width += step
    hit = np.zeros(n, bool)
    hit[best[starts]] = True
    return np.flatnonzero(hit)


def _anchor_places(docs: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        doc, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, offs = textops.column(batch.column(2))
        for lo, hi in textops.chunks(offs):
            w = textops.words(data, offs[lo:hi + 1], textops.NOT_SPACE)
            gram, _ = textops.shingles(w.hashes(), w.first, k)
            at = _anchors(gram, w.first, length, k)
            t = np.searchsorted(w.first, at, "right") - 1
            yield gram[at], np.zeros(len(at), np.uint32), doc[lo + t], crc[lo + t], at - w.first[t]

    return frames.arrow(docs, repeats.scatter(read, buckets), repeats.SENT_SQL)


def _content(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece's words."""
    start = np.cumsum(size) - size
    at = np.arange(len(words)) - np.repeat(start, size)
    return textops.mix(np.add.reduceat(textops.mix(words.astype(U64) + U64(1)) * textops.mix(at.astype(U64) + U64(77)), start) + size.astype(U64)) if len(size) else np.zeros(0, U64)


def _pieces(docs: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """Pieces around the places, by anchor. Of equal pieces of one task only the first is sent;
    the others are covered (rows without anchor)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0

        def flush():
            anchor, doc, crc, start, n, words = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            content = _content(words, n)
            order = np.lexsort((start, crc, doc, content, anchor))
            a, c = anchor[order], content[order]
            again = np.r_[False, (np.diff(a) == 0) & (np.diff(c) == 0) & (np.diff(doc[order]) == 0) & (np.diff(crc[order]) == 0) & (np.diff(start[order]) == 0)]
            order, a, c = order[~again], a[~again], c[~again]  # a row listed again
            new = np.r_[True, (np.diff(a) != 0) | (np.diff(c) != 0)]
            out, at = [], np.cumsum(n) - n
            send, rest = order[new], order[~new]
            for b, s in blobs.cut(anchor[send], buckets):
                i = send[s]
                out.append((b, anchor[i].tobytes(), doc[i].tobytes(), crc[i].tobytes(), start[i].tobytes(), n[i].astype(np.uint8).tobytes(), blobs.take(words, at[i], n[i]).tobytes()))
            rest = rest[n[rest] >= length]
            spread = repeats._spread(doc[rest])
            rest, spread = rest[np.argsort(spread, kind="stable")], np.sort(spread)
            for b, s in blobs.cut(spread, buckets):
                i = rest[s]
                out.append((b, None, doc[i].tobytes(), crc[i].tobytes(), start[i].tobytes(), n[i].astype(np.uint8).tobytes(), None))
            return blobs.rows(out, PIECES)

        for batch in batches:
            doc, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offs = textops.column(batch.column(2))
            places = batch.column(3)
            to, flat = places.offsets.to_numpy(), places.values.to_numpy()
            for lo, hi in textops.chunks(offs):
                w = textops.words(data, offs[lo:hi + 1], textops.NOT_SPACE)
                h = w.hashes()
                gram, _ = textops.shingles(h, w.first, k)
                t = np.repeat(np.arange(hi - lo), np.diff(to[lo:hi + 1]))
                at = flat[to[lo]:to[hi]] + w.first[t]
                begin = np.maximum(at - (length - k), w.first[t])
                n = np.minimum(at + length, w.first[t + 1]) - begin
                parts.append((gram[at], doc[lo + t], crc[lo + t].astype(np.uint32), (begin - w.first[t]).astype(np.int32), n, blobs.take((h >> U64(32)).astype(np.uint32), begin, n)))
                size += len(at)
                if size > 80_000:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    return frames.arrow(docs, run, PIECES_SQL)


def _covered(pieces: DataFrame, partitions: int, length: int) -> DataFrame:
    """(doc, crc, places): first word of each covered run of ``length`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.int64, np.uint32, np.int32, np.uint8, np.uint32)
        parts, done = [], []
        for r in blobs.gathered(batches):
            cols = [np.frombuffer(r[c], t) if r[c] is not None else None for c, t in zip(("anchor", "doc", "crc", "start", "size", "words"), kinds)]
            if cols[0] is None:
                done.append(_runs(*cols[1:4], cols[4].astype(np.int64), length))
            else:
                parts.append(cols)
        if parts:
            anchor, doc, crc, start, n, words = (np.concatenate(c) for c in zip(*parts))
            n = n.astype(np.int64)
            content, at = _content(words, n), np.cumsum(n) - n
            order = np.lexsort((start, crc, doc, anchor))
            anchor, doc, crc, start, n, content, at = (x[order] for x in (anchor, doc, crc, start, n, content, at))
            shard = np.cumsum(np.r_[False, np.diff(anchor) != 0])
            # equal pieces of a shard: all but the first are covered whole
            by = np.lexsort((np.arange(len(shard)), content, shard))
            new = np.ones(len(shard), bool)
            new[by[1:]] = (np.diff(shard[by]) != 0) | (np.diff(content[by]) != 0)
            same = ~new
            again = np.zeros(len(shard), bool)  # the same place sent twice
            again[by[1:]] = ~new[by[1:]] & (doc[by[1:]] == doc[by[:-1]]) & (crc[by[1:]] == crc[by[:-1]]) & (start[by[1:]] == start[by[:-1]])
            whole = same & ~again & (n >= length)
            done.append(_runs(doc[whole], crc[whole], start[whole], n[whole], length))
            distinct = np.bincount(shard, weights=new)
            some = np.flatnonzero(new & (distinct[shard] > 1))
            d, c, p, current, auto = [], [], [], -1, None
            for i in some.tolist():
                if shard[i] != current:
                    current, auto = shard[i], Automaton()
                piece, place, s = words[at[i]:at[i] + n[i]].tolist(), (int(doc[i]), int(crc[i])), int(start[i])
                ends = auto.matches(piece, place, s, length)
                d += [place[0]] * len(ends)
                c += [place[1]] * len(ends)
                p += [s + e - length + 1 for e in ends]
                auto.add(piece, place, s)
            done.append((np.array(d, np.int64), np.array(c, np.uint32), np.array(p, np.int32)))
        if done:
            yield repeats.to_documents(*(np.concatenate(x) for x in zip(*done)), partitions)

    return frames.arrow(blobs.by_bucket(pieces, partitions), run, repeats.FOUND_SQL)


def _runs(doc, crc, start, n, length) -> tuple[np.ndarray, ...]:
    """Starts of the runs that cover whole pieces: every ``length`` words, and the last."""
    k = -(-n // length)
    i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    first = np.repeat(start, k) + np.minimum(i * length, np.repeat(n - length, k))
    return np.repeat(doc, k), np.repeat(crc, k), first.astype(np.int32)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20, gram: int = 5) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``. ``length`` may be at most 120."""
    parts = frames.parts(docs.sparkSession)
    name = lambda c: F.col(f"`{c}`")
    rest = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "n_removed", "kept")]
    # both joins read the same columns, so that the texts are shuffled once for both
    keyed = docs.select(*repeats.identity(name(doc_id), name(text)), name(text).alias("t"), F.struct(F.lit(0).alias("__"), *[name(c) for c in rest]).alias("row"))
    anchors = repeats.collected(repeats.repeated(_anchor_places(keyed.select("doc", "crc", "t"), length, gram, 4 * parts), parts, firsts=True), parts)
    around = keyed.join(anchors, ["doc", "crc"]).select("doc", "crc", "t", "places", "row")
    covered = repeats.collected(_covered(_pieces(around, length, gram, 4 * parts), parts, length), parts)
    both = keyed.join(covered, ["doc", "crc"], "left").select("row", "t", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_words, n_gone = [], [], []
            for t, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = (t or "").encode().split()
                n = len(words)
                if places:
                    out, at = [], 0
                    for p in places:  # ascending
                        out += words[at:p]
                        at = max(at, p + length)
                    words = out + words[at:]
                n_words.append(n)
                n_gone.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["row", "t", "n_words", "n_removed", "kept"])

    done = frames.arrow(both, run, T.StructType([both.schema["row"], both.schema["t"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c == text or c in rest], "n_words", "n_removed", "kept")
