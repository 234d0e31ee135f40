"""Spelling variant grouping: words one letter apart, found by a bit-sliced position index.

Words are counted over all texts; each task sends its distinct words with their
counts. Words in which one code point is inserted, deleted or replaced share all
letters before or all letters behind the middle, so the vocabulary is dealt out by
these halves; groups that are still large are halved again around the window in
which the letters may differ, until they are small (a window of one letter holds a
bounded number of words). Nothing is capped.

Inside a group the index has, for each position of the window and each letter, the
set of words with that letter there, as bits in the order of their counts. For all
words of a block at once, one pass over the positions carries the words that agree
so far (no error) and, by the index at the same position, one further and one back,
those with one letter replaced, inserted or deleted. The number of bits left is the
number of near words, the lowest bit is the most frequent one; pairs are never
written out. A pair is counted in the group whose window holds the first position
in which the two differ, and only there.

Edge cases. Null text has no words, a null id counts as empty text. Rows that repeat
an id count each. Words of any length take part. Of near words with equal counts the
smallest in code-point order is the form. An empty table gives no word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wardbook.llm import textops
from wardbook.llm.blobs import take
from wardbook.llm.frames import arrow
from wardbook.session import cut_lineage

#: letters a-z and U+00C0 to U+00FF, as Latin-1 bytes
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0xC0:] = True
#: groups of more words are divided
MOST = 2048
#: rows of a block of groups that pass the index together
BLOCK = 1024
#: distinct words that a task gathers before it sends them
HELD = 200_000


def _latin(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with one byte a letter; all else is a zero byte or several."""
    base = int(offs[0])
    data = textops.LOWER[data[base:int(offs[-1])]]
    offs = offs - base
    lead = data == 0xC3
    out = np.where(LETTER[data] & (data < 0x80), data, 0).astype(np.uint8)
    at = np.flatnonzero(lead)
    out[at + 1] = data[at + 1] + 0x40  # U+00C0 to U+00FF are C3 80 to C3 BF
    before = np.r_[0, np.cumsum(lead)]
    return out[~lead], offs - before[offs]


_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """4 x 256 table: what ``length`` bytes behind it make of a CRC-32, byte by byte (CRCs are linear)."""
    if length not in _SHIFTS:
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << i) ^ none for i in range(32)], np.uint32)
        table = np.zeros((4, 256), np.uint32)
        for i in range(32):
            has = (np.arange(256) >> (i % 8) & 1).astype(bool)
            table[i // 8, has] ^= bits[i]
        if len(_SHIFTS) > 4096:
            _SHIFTS.clear()
        _SHIFTS[length] = table
    return _SHIFTS[length]


def _counted(crc: np.ndarray, data: np.ndarray, offs: np.ndarray, least: int, every: int) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts and their counts (a word may come twice); ``crc``: of each text's id and colon."""
    data, offs = _latin(data, offs)
    found = textops.words(data, offs, LETTER)
    keep = found.end - found.start >= least
    start, length, text = found.start[keep], (found.end - found.start)[keep], found.text[keep]
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    flat = take(found.data, start, length)
    ends = np.r_[0, np.cumsum(length)].astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = runs.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary())
    counts = np.bincount(code, minlength=len(words)).astype(np.int64)
    if not every:
        return words, counts
    spelled = words.to_pylist()
    plain = [w if w.isascii() else w.decode("latin-1").encode() for w in spelled]
    own = np.array([zlib.crc32(w) for w in plain], np.uint32)
    sizes, kind = np.unique([len(w) for w in plain], return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in sizes])
    pair, times = np.unique(text * len(words) + code, return_counts=True)
    doc, code = pair // len(words), pair % len(words)
    c, k = crc[doc].astype(np.uint32), kind[code]
    h = own[code]
    for i in range(4):
        h = h ^ tables[k, i, c >> np.uint32(8 * i) & np.uint32(255)]
    slip = np.flatnonzero(h % np.uint32(every) == 0)
    np.subtract.at(counts, code[slip], times[slip])
    changed, more = [], []
    for j in slip.tolist():
        w = spelled[code[j]]
        p = int(h[j]) % len(w)
        if len(w) > least:
            changed.append(w[:p] + w[p + 1:])
            more.append(int(times[j]))
    return pa.concat_arrays([words, pa.array(changed, pa.binary())]), np.r_[counts, np.array(more, np.int64)]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, every: int = 0) -> DataFrame:
    """word (Latin-1 bytes), n: runs of letters of ``least`` code points or more, A-Z lower-cased.

    With ``every``, a run of which the CRC-32 of "id:run" is a multiple of it loses the letter at
    that number modulo its length (spelling slips to try the operator on)."""
    name = lambda c: F.col(f"`{c}`")
    crc = F.crc32(F.concat(F.coalesce(name(doc_id).cast("string"), F.lit("")), F.lit(":")).cast("binary"))
    sent = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def folded(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        t = pa.table([t["word"], t["n_sum"]], schema=sent).combine_chunks()
        return t.filter(pc.greater(t["n"], 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            crcs = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = textops.column(b.column(1))
            for lo, hi in textops.chunks(offs):
                words, n = _counted(crcs[lo:hi], data, offs[lo:hi + 1], least, every)
                parts.append(pa.table([words, pa.array(n)], schema=sent))
                rows += len(n)
                if rows > 2 * HELD:
                    parts = [folded(parts)]
                    rows = len(parts[0])
                    if rows > HELD:
                        yield from parts[0].to_batches(max_chunksize=20_000)
                        parts, rows = [], 0
        if parts:
            yield from folded(parts).to_batches(max_chunksize=20_000)

    found = arrow(docs.select(crc.alias("crc"), name(text).alias("text")).where("text is not null"), run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _windows(rows: DataFrame, bounds: str) -> DataFrame:
    """``rows`` (word, n, m) once for each window (lo, hi) of the SQL array ``bounds``, with the key of all letters outside."""
    out = rows.selectExpr("word", "n", "m", f"inline({bounds})")
    suffix = "if(hi = m, X'', substring(word, hi - m, m - hi))"
    return out.withColumn("key", F.expr(f"concat(cast(concat_ws(',', m, lo, hi, '') as binary), substring(word, 1, lo), {suffix})"))


def _grouped(words: DataFrame, most: int) -> DataFrame:
    """word, n, m, lo, hi, key: every word among all words that share its letters outside the window (lo, hi).

    m is the length of the shorter words of a group; the others have a letter more. Each word
    stands with the words of its own length and longer, and with those of its own length and shorter."""
    classes = words.selectExpr("word", "n", "explode(array(length(word), length(word) - 1)) AS m").where("m > 0")
    halves = "array(named_struct('lo', {lo} + ({hi} - {lo}) div 2, 'hi', {hi}), named_struct('lo', {lo}, 'hi', {lo} + ({hi} - {lo}) div 2))"
    rows = _windows(classes, halves.format(lo="cast(0 as bigint)", hi="cast(m as bigint)"))
    done = None
    while True:
        rows = cut_lineage(rows)
        large = cut_lineage(rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > most).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        parts = rows.join(large, "key", "left_semi").withColumnsRenamed({"lo": "a", "hi": "b"})
        out = parts.selectExpr("word", "n", "m", f"inline({halves.format(lo='a', hi='b')})")
        rows = _windows(out.selectExpr("word", "n", "m", "lo AS a", "hi AS b"), "array(named_struct('lo', a, 'hi', b))")


def near_in_block(words: pa.Array, n: np.ndarray, group: np.ndarray, m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block (groups of one window): how many words of its group are one letter
    apart with the first difference in the window, and the place of the most frequent one (-1: none).
    The order of all three arrays is the returned order of the words."""
    data, offs = textops.column(words.view(pa.string()))
    spelled = np.array(words.to_pylist(), object)
    order = np.array(sorted(range(len(n)), key=lambda i: (group[i], -n[i], spelled[i])), np.int64)
    group, size = group[order], (offs[1:] - offs[:-1])[order]
    width, count = hi - lo, len(order)
    long = size > m
    at = offs[:-1][order][:, None] + lo + np.arange(width + 1)
    letters = data[np.minimum(at, offs[1:][order][:, None] - 1)] if len(data) else np.zeros((count, width + 1), np.uint8)
    letters[~long, width] = 0
    code = np.zeros(256, np.int64)
    known = np.unique(letters)
    code[known] = np.arange(len(known))
    letters = code[letters]
    lanes = -(-count // 64)

    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), lanes * 8), np.uint8)
        b = np.packbits(bits, axis=1, bitorder="little")
        out[:, :b.shape[1]] = b
        return out.view(np.uint64)

    tables: dict[int, np.ndarray] = {}

    def having(position: int, letter: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at the position."""
        if position not in tables:
            tables.pop(position - 3, None)
            tables[position] = packed(np.arange(len(known))[:, None] == letters[:, position][None, :])
        return tables[position][letter]

    of, own = np.unique(group, return_inverse=True)
    same = packed(np.arange(len(of))[:, None] == own[None, :])[own]
    shorts, longs = packed(~long[None, :])[0], packed(long[None, :])[0]
    result = np.zeros((count, lanes), np.uint64)

    q = np.flatnonzero(~long)
    if len(q):
        agree = same[q]
        replaced, inserted = np.zeros_like(agree), agree.copy()
        for i in range(width):
            c = letters[q, i]
            here = having(i, c)
            replaced = (replaced & here) | (agree & ~here)
            inserted &= having(i + 1, c)
            agree &= here
            inserted |= agree
        hits = (replaced & shorts) | (inserted & longs)
        result[q] = hits if hi == m else hits & ~agree
    tables.clear()
    q = np.flatnonzero(long)
    if len(q) and len(q) < count:
        agree = same[q]
        deleted = np.zeros_like(agree)
        for i in range(width + 1):
            c = letters[q, i]
            deleted = (deleted & having(i - 1, c) if i else deleted) | agree
            if i < width:
                agree = agree & having(i, c)
        hits = deleted & shorts
        result[q] = hits if hi == m else hits & ~agree
    near = np.bitwise_count(result).sum(axis=1).astype(np.int64)
    lane = (result != 0).argmax(axis=1)
    bits = result[np.arange(count), lane]
    lowest = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    best = np.where(near > 0, lane * 64 + lowest, -1)
    return order, near, best


def _blocks(table: pa.Table, edges: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Row ranges of whole groups of one window, some ``BLOCK`` rows each, and the group of each row."""
    m, lo, hi = (table.column(c).to_numpy() for c in ("m", "lo", "hi"))
    i = 0
    while i < len(edges) - 1:
        a = edges[i]
        j = i + 1
        while j < len(edges) - 1 and edges[j + 1] - a <= BLOCK and (m[edges[j]], lo[edges[j]], hi[edges[j]]) == (m[a], lo[a], hi[a]):
            j += 1
        yield slice(int(a), int(edges[j])), np.repeat(np.arange(i, j), np.diff(edges[i:j + 1]))
        i = j


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, form, form_n: how many of ``words`` (word: Latin-1 bytes, n) are one code point
    away, and the most frequent of them; words without near words are left out."""
    rows = _grouped(words, most).select("key", "m", "lo", "hi", "word", "n")
    sent = pa.schema([("word", pa.binary()), ("near", pa.int64()), ("best", pa.binary()), ("best_n", pa.int64())])

    def settled(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        # groups of one word have no pair
        size = np.diff(edges)
        if not (size > 1).any():
            return
        table = table.take(pa.array(np.flatnonzero(np.repeat(size > 1, size)))).combine_chunks()
        edges = np.r_[0, np.cumsum(size[size > 1])]
        word, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
        m, lo, hi = (table.column(c).to_numpy() for c in ("m", "lo", "hi"))
        for part, group in _blocks(table, edges):
            a = part.start
            own = word[part.start:part.stop]
            order, near, best = near_in_block(own, n[part], group, int(m[a]), int(lo[a]), int(hi[a]))
            at = np.flatnonzero(near)
            if len(at):
                other = pa.array(order[best[at]])
                yield pa.RecordBatch.from_arrays([own.take(pa.array(order[at])), pa.array(near[at]), own.take(other), pa.array(n[part][order[best[at]]])], schema=sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            if not len(table):
                continue
            key = table.column("key").combine_chunks()
            new = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(new) + 1]
            yield from settled(table.slice(0, edges[-1]), edges)
            rest = table.slice(edges[-1])
        if rest is not None:
            yield from settled(rest, np.array([0, len(rest)]))

    dealt = rows.repartition("key").sortWithinPartitions("key")
    found = arrow(dealt, run, "word binary, near long, best binary, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def followed(links: DataFrame) -> DataFrame:
    """word, root: the last word reached from each by ``links`` (word, form; no circles). The
    steps double each round."""
    now = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2, most: int = MOST) -> DataFrame:
    """word, form, root (strings), n, n_near, form_n for every row of ``words`` (word, n).

    The form is the near word of largest n, where that is ``ratio`` (2 or more) times the word's
    own or larger."""
    words = cut_lineage(words)
    joined = cut_lineage(words.join(near_words(words, most).withColumnsRenamed({"form": "f", "form_n": "f_n"}), "word", "left"))
    has = F.col("f_n") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("f")).alias("form"), F.when(has, F.col("f_n")).alias("form_n"))
    roots = followed(formed.where("form is not null").select("word", "form"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")
