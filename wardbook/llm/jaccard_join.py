"""N-gram Jaccard join: documents linked by like sets of word shingles.

Two documents link when 100 * intersection >= ``percent`` * union of their sets
of ``width``-word shingles (64-bit hashes). The result is each document's
component; links inside dense groups are not listed one by one, but none that
joins two components is lost. Steps:

1. Each task sends its sets' shingles (32 bits beside the bucket) in one row for
   each bucket; the buckets count in how many documents each shingle is, and send
   back what is in two or more. A partner shares at least ``percent`` of a set,
   so documents with fewer shingles in other documents are alone.
2. Equal sets form classes by a 128-bit signature; the smallest id stands for all.
3. The shingles of a set are ordered by rarity over all documents; two sets that
   link share one in their prefixes. Sharing one (as a star around the smallest
   id, pre-aggregated in each task) makes clusters: no link leaves a cluster.
4. Clusters are joined exactly inside tasks. One of more than ``block`` sets is
   dealt out by pairs of blocks, so no task grows with a cluster. The join skips
   by set relations. Skipping in the index: lists of prefix shingles lie in order
   of size and only the span of possible sizes is read, entries whose positions
   leave too little room are passed over, and sets that already are in the
   component have left the lists. Skipping by answers: a set is reached from a
   linked set whose overlaps are known; with o the known overlap with a third set,
   its own is at most o + what it has beyond the linked set, and is otherwise
   derived from o by the two small differences alone.
5. Links found and classes are joined to components.

Edge cases. Fewer words than ``width``: the whole sequence is the one shingle.
Null text or no words: an empty set, linked with nothing. Null id: links with
nothing and has no component. Rows that repeat an id are one document with the
links of all its texts; each row keeps its own size. Empty table: no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardbook.llm import blobs, frames, textops
from wardbook.llm.components import components
from wardbook.session import cut_lineage

U64 = np.uint64
SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("per", pa.binary()), ("shingles", pa.binary()), ("seen", pa.binary()),
                  ("doc", pa.binary()), ("known", pa.binary()), ("n", pa.binary()), ("s1", pa.binary()), ("s2", pa.binary())])
SENT_SQL = "bucket int, batch long, per binary, shingles binary, seen binary, doc binary, known binary, n binary, s1 binary, s2 binary"
FLUSH = 1_500_000


def document_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin."""
    w = textops.words(data, offs, textops.NOT_SPACE, lower=True)
    h = w.hashes()
    gram, ok = textops.shingles(h, w.first, width)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    for i in short:  # the whole sequence, told apart from longer ones' shingles
        gram[w.first[i]] = textops.mix(np.array([textops.fold(h[w.first[i]:w.first[i + 1]])], U64) ^ U64(int(w.counts[i])))[0]
        ok[w.first[i]] = True
    text = w.text[ok]
    gram = gram[ok]
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.r_[True, (np.diff(gram) != 0) | (np.diff(text) != 0)] if len(gram) else np.zeros(0, bool)
    gram, text = gram[new], text[new]
    return gram, np.searchsorted(text, np.arange(len(offs)))


def needed(n, percent: int):
    """Shingles that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def overlap_needed(a, b, percent: int):
    """Smallest intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


# -- 1: how common each shingle is -----------------------------------------------------

def _send_sets(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 32
        held: list[tuple] = []

        def flush(serial: int) -> pa.RecordBatch:
            doc, known, n, gram = (np.concatenate(c) for c in zip(*held))
            held.clear()
            at = np.cumsum(n) - n
            some = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(some):
                s1[some] = np.add.reduceat(textops.mix(gram + U64(1)), at[some])
                s2[some] = np.add.reduceat(textops.mix(gram ^ U64(0x5851F42D4C957F2D)), at[some])
            out = [(int(serial % buckets), serial, None, None, None, doc.tobytes(), known.tobytes(), n.astype(np.int32).tobytes(), s1.tobytes(), s2.tobytes())]
            own = np.repeat(np.arange(len(n)), n)
            keep = known[own]
            gram, own = gram[keep], own[keep]
            b = blobs.bucket_of(gram, buckets)
            order = np.argsort(b, kind="stable")  # by document inside each bucket
            gram, own, b = gram[order], own[order], b[order]
            edge = np.searchsorted(b, np.arange(buckets + 1))
            for k in range(buckets):
                s = slice(edge[k], edge[k + 1])
                if s.stop > s.start:
                    out.append((k, serial, np.bincount(own[s], minlength=len(n)).astype(np.uint32).tobytes(), (gram[s] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), None, None, None, None, None, None))
            return blobs.rows(out, SENT)

        size = 0
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            data, offs = textops.column(batch.column(1))
            for lo, hi in textops.chunks(offs):
                gram, first = document_sets(data, offs[lo:hi + 1], width)
                held.append((doc[lo:hi], known[lo:hi], np.diff(first), gram))
                size += len(gram) + hi - lo
                if size > FLUSH:
                    yield flush(serial)
                    serial, size = serial + 1, 0
        if held:
            yield flush(serial)

    return frames.arrow(docs, run, SENT_SQL)


def _seen(sent: DataFrame, partitions: int) -> DataFrame:
    """Each bucket's shingles that are in two documents or more, with that number (at most 65535)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], []
        for r in blobs.gathered(batches):
            if r["shingles"] is None:
                out.append(tuple(r[c] for c in SENT.names))
            else:
                rows.append((r["bucket"], r["batch"], np.frombuffer(r["per"], np.uint32), np.frombuffer(r["shingles"], np.uint32)))
        if rows:
            key = np.concatenate([x.astype(U64) | U64(b << 32) for b, _, _, x in rows])
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            seen = np.minimum(count, 65535).astype(np.uint16)[inverse]
            at = 0
            for b, batch, per, x in rows:
                s = seen[at:at + len(x)]
                at += len(x)
                many = s > 1
                if many.any():
                    own = np.repeat(np.arange(len(per)), per)[many]
                    out.append((b, batch, np.bincount(own, minlength=len(per)).astype(np.uint32).tobytes(), x[many].tobytes(), s[many].tobytes(), None, None, None, None, None))
        for i in range(0, len(out), 64):
            yield blobs.rows(out[i:i + 64], SENT)

    return frames.arrow(blobs.by_bucket(sent, partitions), run, SENT_SQL)


def _prefixes(seen: DataFrame, partitions: int, percent: int) -> DataFrame:
    """(doc, n, s1, s2, prefix): every document; prefix is null if it is alone."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for r in blobs.gathered(batches):
            by.setdefault(r["batch"], []).append(r)
        for rows in by.values():
            head = next(r for r in rows if r["doc"] is not None)
            doc, known, n = np.frombuffer(head["doc"], np.int64), np.frombuffer(head["known"], bool), np.frombuffer(head["n"], np.int32).astype(np.int64)
            rows = [r for r in rows if r["doc"] is None]
            cat = lambda f, kind: np.concatenate([f(r) for r in rows]).astype(kind) if rows else np.zeros(0, kind)
            own = cat(lambda r: np.repeat(np.arange(len(n)), np.frombuffer(r["per"], np.uint32)), np.int64)
            shingle = cat(lambda r: np.frombuffer(r["shingles"], np.uint32).astype(U64) | U64(r["bucket"] << 32), U64)
            seen = cat(lambda r: np.frombuffer(r["seen"], np.uint16), np.int64)
            common = np.bincount(own, minlength=len(n))
            candidate = known & (n > 0) & (common >= needed(n, percent))
            take = np.where(candidate, np.maximum(0, n - needed(n, percent) + 1 - (n - common)), 0)
            order = np.lexsort((shingle, seen, own))  # rarest first; those of one document come before all
            own, shingle = own[order], shingle[order]
            rank = np.arange(len(own)) - (np.cumsum(common) - common)[own]
            keep = rank < take[own]
            to = np.r_[0, np.cumsum(take)].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(to, mask=np.r_[~candidate, False]), pa.array(shingle[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=~known), pa.array(n), pa.array(np.frombuffer(head["s1"], np.int64)), pa.array(np.frombuffer(head["s2"], np.int64)), prefix], schema=schema)

    return frames.arrow(blobs.by_bucket(seen, partitions, "batch"), run, "doc long, n long, s1 long, s2 long, prefix array<long>")


# -- 3: clusters ------------------------------------------------------------------------

def _stars(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (smallest document, other) of each token, each once; and where in token order its smallest is."""
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    new = np.r_[True, np.diff(token) != 0] if len(token) else np.zeros(0, bool)
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
    other = ~new & (doc != least)
    pairs = np.unique(np.stack([least[other], doc[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], order[new]


EDGES = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("doc", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _sharing(prefixes: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """(a, b): documents that share a prefix shingle, as stars."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            token, doc = (np.concatenate(c) for c in zip(*held))
            held.clear()
            a, b, first = _stars(token, doc)
            spread = textops.mix(token[first])
            order = np.argsort(spread, kind="stable")
            first, spread = first[order], spread[order]
            yield blobs.rows([(k, token[first[s]].tobytes(), doc[first[s]].tobytes(), None, None) for k, s in blobs.cut(spread, buckets)], EDGES)
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(len(a)) % buckets).astype(np.int32)), none, none, pa.array(a), pa.array(b)], schema=EDGES)

        size = 0
        for batch in batches:
            prefix = batch.column(1)
            n = np.diff(prefix.offsets.to_numpy())
            held.append((prefix.flatten().to_numpy().view(U64), np.repeat(batch.column(0).to_numpy(), n)))
            size += int(n.sum())
            if size > 2 * FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, docs, pairs = [], [], [np.zeros((0, 2), np.int64)]
        for b in batches:
            own = b.column(1).is_null().to_numpy(zero_copy_only=False)
            some = b.filter(pa.array(own))
            pairs.append(np.stack([some.column(3).to_numpy(), some.column(4).to_numpy()], axis=1))
            for r in b.filter(pa.array(~own)).select(["token", "doc"]).to_pylist():
                tokens.append(np.frombuffer(r["token"], U64))
                docs.append(np.frombuffer(r["doc"], np.int64))
        if tokens:
            a, b, _ = _stars(np.concatenate(tokens), np.concatenate(docs))
            pairs.append(np.stack([a, b], axis=1))
        out = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["a", "b"])

    sent = frames.arrow(prefixes, send, "bucket int, token binary, doc binary, a long, b long")
    return frames.arrow(blobs.by_bucket(sent, partitions), meet, "a long, b long")


# -- 4: the exact join of some sets --------------------------------------------------------

class Join:
    """Links between sets (ascending distinct shingles), enough to join their components."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rarest first
        own = np.repeat(np.arange(len(sets)), self.n)
        token = rank[inverse]
        order = np.lexsort((token, own))
        self.token = token[order]
        self.at = np.r_[0, np.cumsum(self.n)]
        self.stamp = np.full(len(count), -1, np.int64)
        self.alive = np.ones(len(sets), bool)
        position = np.arange(len(own)) - self.at[own]
        prefix = position < (self.n - needed(self.n, percent) + 1)[own]
        self._index(own[prefix], self.token[prefix], position[prefix])

    def _index(self, own: np.ndarray, token: np.ndarray, position: np.ndarray) -> None:
        """Lists by token, in order of size."""
        key = token << 24 | np.minimum(self.n[own], (1 << 24) - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.own, self.position, self.list_token = key[order], own[order], position[order], token[order]
        self.indexed = int(self.alive.sum())

    def _leave(self, some: np.ndarray) -> None:
        self.alive[some] = False
        if 2 * int(self.alive.sum()) < self.indexed:  # lists without those that left
            keep = self.alive[self.own]
            self._index(self.own[keep], self.list_token[keep], self.position[keep])

    def set(self, x: int) -> np.ndarray:
        return self.token[self.at[x]:self.at[x + 1]]

    def candidates(self, x: int) -> np.ndarray:
        n, t = int(self.n[x]), self.percent
        prefix = self.set(x)[:n - needed(n, t) + 1]
        lo = np.searchsorted(self.key, prefix << 24 | min(needed(n, t), (1 << 24) - 1))
        hi = np.searchsorted(self.key, prefix << 24 | min(100 * n // t, (1 << 24) - 1), "right")
        size = hi - lo
        if not size.sum():
            return size[:0]
        entry = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        other, place = self.own[entry], np.repeat(np.arange(len(prefix)), size)
        room = 1 + np.minimum(n - place - 1, self.n[other] - self.position[entry] - 1) + np.minimum(place, self.position[entry])
        return np.unique(other[self.alive[other] & (room >= overlap_needed(n, self.n[other], t))])

    def _hits(self, tokens: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of the tokens each other set holds."""
        mark = self.stamp
        mark[tokens] = 1
        n = self.n[others]
        got = mark[blobs.take(self.token, self.at[others], n)] == 1
        mark[tokens] = -1
        return np.add.reduceat(got, np.cumsum(n) - n, dtype=np.int64)

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, sets linked with x that were in no component so far)."""
        answers: dict[int, list] = {}  # of sets whose linked sets are still to come: others, overlaps, how many
        for root in range(len(self.n)):
            if not self.alive[root]:
                continue
            self._leave(np.array([root]))
            queue: deque[tuple[int, int]] = deque([(root, -1)])
            while queue:
                x, parent = queue.popleft()
                others = self.candidates(x)
                if not len(others):
                    self._done(answers, parent)
                    continue
                overlap = np.full(len(others), -1, np.int64)
                least = overlap_needed(self.n[x], self.n[others], self.percent)
                fresh = np.ones(len(others), bool)
                if parent >= 0 and parent in answers:
                    known, known_overlap, _ = answers[parent]
                    at = np.minimum(np.searchsorted(known, others), len(known) - 1)
                    have = known[at] == others
                    plus = np.setdiff1d(self.set(x), self.set(parent), assume_unique=True)
                    minus = np.setdiff1d(self.set(parent), self.set(x), assume_unique=True)
                    base = known_overlap[at]
                    fresh = ~have
                    derive = np.flatnonzero(have & (base + len(plus) >= least))
                    if len(derive):
                        overlap[derive] = base[derive] + self._hits(plus, others[derive]) - self._hits(minus, others[derive])
                some = np.flatnonzero(fresh)
                if len(some):
                    overlap[some] = self._hits(self.set(x), others[some])
                self._done(answers, parent)
                linked = others[overlap >= least]
                if len(linked):
                    rest = (overlap >= 0) & (overlap < least)
                    if rest.any():
                        answers[x] = [others[rest], overlap[rest], len(linked)]
                    self._leave(linked)
                    queue.extend((int(y), x) for y in linked)
                    yield x, linked

    @staticmethod
    def _done(answers: dict, parent: int) -> None:
        if parent in answers:
            answers[parent][2] -= 1
            if not answers[parent][2]:
                del answers[parent]


def _links(dealt: DataFrame, partitions: int, width: int, percent: int) -> DataFrame:
    """(a, b): links among the rows (doc, text) of each deal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, met = [], [], set()
        for b in batches:
            doc = b.column(1).to_pylist()
            data, offs = textops.column(b.column(2))
            for lo, hi in textops.chunks(offs):
                gram, first = document_sets(data, offs[lo:hi + 1], width)
                for i in range(hi - lo):
                    own = gram[first[i]:first[i + 1]]
                    key = (doc[lo + i], blake2b(own.tobytes(), digest_size=16).digest())
                    if len(own) and key not in met:  # a set may come with several pairs of blocks
                        met.add(key)
                        docs.append(doc[lo + i])
                        sets.append(own.copy())
        a, b = [], []
        if len(sets) > 1:
            ids = np.array(docs, np.int64)
            for x, linked in Join(sets, percent).links():
                a.append(np.full(len(linked), ids[x]))
                b.append(ids[linked])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], names=["a", "b"])

    return frames.arrow(blobs.by_bucket(dealt, partitions, "deal"), run, "a long, b long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, block: int = 8192) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    parts = frames.parts(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t"))
    firsts = cut_lineage(_prefixes(_seen(_send_sets(rows, width, parts), parts), parts, percent))
    some = firsts.where("prefix IS NOT NULL AND doc IS NOT NULL")
    classes = cut_lineage(some.groupBy("s1", "s2").agg(F.min("doc").alias("rep")))
    member = some.join(classes, ["s1", "s2"]).select("doc", "rep")
    reps = some.join(classes.select("rep", F.col("s1").alias("r1"), F.col("s2").alias("r2")), (F.col("doc") == F.col("rep")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")))
    shared = components(_sharing(reps.select("doc", "prefix"), parts, parts), "a", "b")
    sizes = shared.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of = cut_lineage(shared.join(sizes, "component"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("component", F.least(k, own), F.greatest(k, own)))
    dealt = rows.join(of.select(F.col("node").alias("doc"), pairs.alias("deals")), "doc").select(F.explode("deals").alias("deal"), "doc", "t")
    links = _links(dealt, parts, width, percent)
    linked = components(links.unionByName(member.select(F.col("rep").alias("a"), F.col("doc").alias("b"))), "a", "b")
    out = firsts.join(linked, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
