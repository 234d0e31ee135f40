"""Line dedup: three-line windows that occurred before are removed.

Each run of ``window`` consecutive lines is hashed (96 bits). The first place
of each window in the order of documents (id, then crc32 of the text) and lines
stays; the lines of its later occurrences are covered, and covered lines are
removed: overlapping windows merge. Windows are judged on the input, not on
what is left. A window of blank lines only is no window.

Edge cases. Null text stays null, empty text stays; a text of fewer lines than
the window has none. A window that recurs in its own document counts like any
other. Rows of one id and one text are the same document listed again and get
the same answer; null ids come last. Lines end with a line feed; a text of
which all lines go becomes empty. Columns pass through; the text is replaced,
and ``n_lines`` and ``n_removed`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardbook.llm import frames, repeats, textops

NEW_LINE = np.zeros(256, bool)
NEW_LINE[0x0A] = True


def _lines(data: np.ndarray, offs: np.ndarray) -> textops.Words:
    """Lines as byte ranges, without their line feeds; each text has one line at least."""
    base = int(offs[0])
    data, offs = data[base:int(offs[-1])], offs - base
    feeds = np.flatnonzero(data == 0x0A)
    # a line starts at each text's start and behind each line feed (a feed at a text's end opens an empty line)
    start = np.concatenate([offs[:-1], feeds + 1])
    text = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, feeds, "right") - 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    first = np.searchsorted(text, np.arange(len(offs)))
    end = np.r_[start[1:] - 1, 0]
    end[first[1:] - 1] = offs[1:]
    return textops.Words(data, start, end, first)


def _window_places(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        doc, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, offs = textops.column(batch.column(2))
        for lo, hi in textops.chunks(offs):
            lines = _lines(data, offs[lo:hi + 1])
            h = lines.hashes()
            key, ok = textops.shingles(h, lines.first, window)
            check = textops.shingles(textops.mix(h ^ np.uint64(0x5851F42D4C957F2D)), lines.first, window)[0] >> np.uint64(32)
            blank = np.r_[0, np.cumsum(lines.end == lines.start)]
            at = np.flatnonzero(ok)
            at = at[blank[at + window] - blank[at] < window]
            t = lines.text[at]
            yield key[at], check[at], doc[lo + t], crc[lo + t], at - lines.first[t]

    return frames.arrow(docs, repeats.scatter(read, buckets), repeats.SENT_SQL)


def remove_covered(text: str, places: list[int], window: int) -> tuple[str, int]:
    lines = text.split("\n")
    gone = {i for p in places for i in range(p, p + window)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, ``n_lines`` (before) and ``n_removed``."""
    parts = frames.parts(docs.sparkSession)
    name = lambda c: F.col(f"`{c}`")
    own = repeats.identity(name(doc_id), name(text))
    sent = _window_places(docs.where(name(text).contains("\n")).select(*own, name(text).alias("t")), window, 4 * parts)
    later = repeats.collected(repeats.repeated(sent, parts, firsts=False), parts)
    keyed = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), *own)
    both = keyed.join(later, ["doc", "crc"], "left").select("row", "places")
    out = T.StructType([both.schema["row"].dataType[text], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, places = b.column(0), b.column(1)
            texts = row.field(at)
            new, n_lines, n_gone = texts.to_pylist(), [], []
            for i, (t, p) in enumerate(zip(new, places.to_pylist())):
                n_lines.append(t.count("\n") + 1 if t is not None else 0)
                gone = 0
                if p:
                    new[i], gone = remove_covered(t, p, window)
                n_gone.append(gone)
            yield pa.RecordBatch.from_arrays([row, pa.array(new, texts.type), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=["row", "t", "n_lines", "n_removed"])

    done = frames.arrow(both, run, T.StructType([both.schema["row"], T.StructField("t", out.fields[0].dataType), *out.fields[1:]]))
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], "n_lines", "n_removed")
