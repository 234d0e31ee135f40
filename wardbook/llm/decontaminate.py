"""Benchmark decontamination: which words of each document lie in a benchmark window.

A prefix-filtered set join. An item's windows are its runs of ``width`` words
(an item of fewer words is one window). A window must be contained whole, so of
its shingles one is enough as prefix: the one that is rarest among all
documents. Documents are probed with these prefix shingles only; a hit proposes
a window start, which must respect the window's length and the document's ends
(length and positional bounds); then all words of the window are compared.

The benchmark side is broadcast in blocks of at most ``block_words`` words; a
larger benchmark takes several passes over the documents, each exact for its
block (one item is never split).

Edge cases. Null or empty text: no words, no hits. Null or empty item: no
window. Repeated items, or items of equal windows: each id is reported. A null
item id: its windows hit words, no id is reported. Repeated documents: each row
gets its own result. Empty tables give empty or clean results. Columns of the
documents pass through; the result's columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardbook.llm import frames, textops
from wardbook.session import cut_lineage

OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),   # first and last + 1 word, in turn
    T.StructField("items", T.ArrayType(T.StringType())),
])


class Windows:
    """The distinct windows of a block of items, and their shingles by size."""

    def __init__(self, ids: list, texts: list, width: int, shingle: int):
        w = textops.words(*textops.column(pa.array([t or "" for t in texts], pa.string())), textops.ALNUM, lower=True)
        h = w.hashes()
        where: dict[tuple, int] = {}
        self.words: list[np.ndarray] = []
        self.items: list[list[str]] = []
        for i, item in enumerate(ids):
            own = h[w.first[i]:w.first[i + 1]]
            n = min(width, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                k = where.setdefault(tuple(own[s:s + n].tolist()), len(self.words))
                if k == len(self.words):
                    self.words.append(own[s:s + n])
                    self.items.append([])
                if item is not None and (not self.items[k] or self.items[k][-1] != item):
                    self.items[k].append(item)
        self.length = np.array([len(x) for x in self.words], np.int64)
        self.sizes = sorted({min(shingle, len(x)) for x in self.words})
        # all shingles of the windows of one shingle size: hash, window, offset
        self.grams = {}
        for k in self.sizes:
            of = [i for i, x in enumerate(self.words) if min(shingle, len(x)) == k]
            rows = [(textops.shingles(self.words[i], np.array([0, len(self.words[i])]), k)[0][:len(self.words[i]) - k + 1], i) for i in of]
            self.grams[k] = (np.concatenate([g for g, _ in rows]),
                             np.concatenate([np.full(len(g), i) for g, i in rows]),
                             np.concatenate([np.arange(len(g)) for g, _ in rows]))
        # the words of all windows of one length, and the row of each window there
        self.by_length = {int(n): (np.stack([x for x in self.words if len(x) == n]), np.cumsum(self.length == n) - 1) for n in np.unique(self.length)}

    def prefixes(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep of each window its rarest shingle (ties: smaller hash, then offset)."""
        self.prefix = {}
        for k, (gram, window, offset) in self.grams.items():
            keys, n = counts[k]
            seen = n[np.searchsorted(keys, gram)]
            order = np.lexsort((offset, gram, seen, window))
            first = order[np.r_[True, np.diff(window[order]) != 0]]
            first = first[np.argsort(gram[first], kind="stable")]
            self.prefix[k] = Lookup(gram[first]), window[first], offset[first]
        del self.grams, self.words


class Lookup:
    """Positions of sorted hashes that are in a sorted array, behind a small bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << 20, bool)
        self.table[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are found; first and last + 1 of their keys."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, hashes[at], "left"), np.searchsorted(self.keys, hashes[at], "right")
        ok = hi > lo
        return at[ok], lo[ok], hi[ok]


def _count(docs: DataFrame, text: str, windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of the windows stands in all documents (bounded by the block)."""
    keys = {k: np.unique(g[0]) for k, g in windows.grams.items()}
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {k: Lookup(x) for k, x in sent.value.items()}
        total = {k: np.zeros(len(x), np.int64) for k, x in sent.value.items()}
        for b in batches:
            data, offs = textops.column(b.column(0))
            for lo, hi in textops.chunks(offs):
                w = textops.words(data, offs[lo:hi + 1], textops.ALNUM, lower=True)
                h = w.hashes()
                for k, x in look.items():
                    gram, ok = textops.shingles(h, w.first, k)
                    _, at, _ = x.find(gram[ok])
                    total[k] += np.bincount(at, minlength=len(total[k]))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], names=["k", "at", "n"])

    counted = frames.arrow(docs.select(F.col(f"`{text}`")), run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()
    sent.unpersist()
    out = {}
    for k, x in keys.items():
        n = np.zeros(len(x), np.int64)
        own = counted[counted["k"] == k]
        n[own["at"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        out[k] = x, n
    return out


def _matches(w: textops.Words, h: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window starts among the words, and the window of each, verified word by word."""
    starts, ids = [], []
    text_of_word = w.text
    for k, (look, window, offset) in windows.prefix.items():
        gram, ok = textops.shingles(h, w.first, k)
        at, lo, hi = look.find(gram)
        lo, hi, at = lo[ok[at]], hi[ok[at]], at[ok[at]]
        n = hi - lo
        key = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        start, win = at - offset[key], window[key]
        t = text_of_word[at]
        ok = (start >= w.first[t]) & (start + windows.length[win] <= w.first[t + 1])
        start, win = start[ok], win[ok]
        for length in np.unique(windows.length[win]):
            own = windows.length[win] == length
            s, x = start[own], win[own]
            want, row = windows.by_length[int(length)]
            ok = (h[s[:, None] + np.arange(length)] == want[row[x]]).all(axis=1)
            starts.append(s[ok])
            ids.append(x[ok])
    return (np.concatenate(starts), np.concatenate(ids)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spans(w: textops.Words, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the covered runs (first, last + 1 in turn, counted in the text), and how many each text has."""
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    inside = np.cumsum(cover)[:-1] > 0
    before = np.r_[False, inside[:-1]]
    before[w.first[:-1][w.counts > 0]] = False
    after = np.r_[inside[1:], False]
    after[w.first[1:][w.counts > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    t = w.text[first]
    borders = np.stack([first - w.first[t], last - w.first[t]], axis=1).ravel()
    return borders, 2 * np.bincount(t, minlength=len(w.first) - 1)


def merge_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sets of borders."""
    s = np.concatenate([a.reshape(-1, 2), b.reshape(-1, 2)])
    s = s[np.argsort(s[:, 0], kind="stable")]
    out: list[list[int]] = []
    for x, y in s.tolist():
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return np.array(out, np.int32).ravel()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = 10, shingle: int = 3, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (borders of the runs of words inside benchmark
    windows: first, last + 1, first, ...) and ``items`` (sorted ids of the items found)."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("t"),
                             F.length(F.coalesce(F.col(f"`{item_text}`"), F.lit(""))).alias("n")).where("n > 0")
    chars = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-chars // (2 * block_words)))  # a word and its gap take two characters at least
    out = docs
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == i).select("id", "t").orderBy("id", "t").collect()
        windows = Windows([r[0] for r in rows], [r[1] for r in rows], width, shingle)
        windows.prefixes(_count(docs, text, windows))
        if i:
            out = cut_lineage(out)
        out = _probe(out, text, windows, first=i == 0)
    return out


def _probe(docs: DataFrame, text: str, windows: Windows, first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def make():
        own = sent.value

        def f(texts: pa.Array) -> list[pa.Array]:
            data, offs = textops.column(texts)
            n_words, borders, per_text, items = [], [], [], []
            for lo, hi in textops.chunks(offs):
                w = textops.words(data, offs[lo:hi + 1], textops.ALNUM, lower=True)
                start, win = _matches(w, w.hashes(), own)
                b, n = _spans(w, start, own.length[win] if len(own.length) else win)
                n_words.append(w.counts)
                borders.append(b)
                per_text.append(n)
                found: list[list[str]] = [[] for _ in range(hi - lo)]
                if len(start):
                    pairs = pd.DataFrame({"t": w.text[start], "w": win}).drop_duplicates()
                    for t, ws in pairs.groupby("t")["w"]:
                        found[t] = sorted({x for i in ws for x in own.items[i]})
                items += found
            cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            to = np.r_[0, np.cumsum(cat(per_text))].astype(np.int32)
            return [pa.array(cat(n_words).astype(np.int64)), pa.ListArray.from_arrays(pa.array(to), pa.array(cat(borders).astype(np.int32))),
                    pa.array(items, pa.list_(pa.string()))]
        return f

    if first:
        return frames.map_text(docs, text, make, OUT)
    both = frames.map_text(docs.withColumnsRenamed({"spans": "__spans", "items": "__items"}), text, make, OUT)
    merge = F.pandas_udf(lambda a, b: pd.Series([merge_spans(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)]), T.ArrayType(T.IntegerType()))
    return both.select(
        *[F.col(f"`{c}`") for c in both.columns if c not in ("__spans", "__items", "spans", "items")],
        merge("__spans", "spans").alias("spans"), F.array_sort(F.array_union("__items", "items")).alias("items"))


def hit_words(spans: str = "spans"):
    """Number of words inside the spans."""
    return F.expr(f"aggregate({spans}, 0L, (a, x) -> x - a)")
