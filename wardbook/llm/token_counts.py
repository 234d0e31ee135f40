"""Token counts: a map-side lookup of pre-token lengths in two tiers.

A pre-token here is what stands between two spaces, with the space before it:
the vocabulary's own pre-tokens never reach over such a border (see ``_safe``),
so a text's number of tokens is the sum over its pre-tokens. A first pass over
all texts counts pre-tokens inside each task and sends only each task's
commonest ones (``per_task``), as counts; their merged top ``frequent`` and their
numbers of tokens make a table of bounded size, which is broadcast. The second
pass sums lengths of pre-tokens: from that table, else from the worker's own cache
of about ``cache`` entries, which the tokenizer's library fills in batches. Both
hold pre-tokens of at most ``LONGEST`` characters, so their bytes are bounded as
well; a longer one is encoded again wherever some texts are read together. No
other pre-token is shuffled, and no count is cut off: the first tier only decides
what is looked up where.

Texts with runs of spaces are divided by the vocabulary's own pattern instead.
Texts that hold an added token, or a character outside the blocks on which the
two regular-expression libraries are known to agree, go to the library whole.

Edge cases. Null or empty text: 0 bytes, 0 tokens. Texts of any length are
counted whole. Rows are independent; ties and repeated rows need no rule. All
columns pass through; ``n_bytes`` and ``n_tokens`` replace columns of that name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from wardbook.llm import frames

OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

# Pre-tokens of byte-level BPE vocabularies of this kind (a fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ASCII without odd controls, Latin, Greek, Cyrillic and common punctuation:
# here any two libraries' classes of letters, numbers and spaces agree.
PLAIN = r"[\t\n\r\x20-\x7E¡-ɏΑ-ΡΣ-ϿЀ-џ–-…]*"


LONGEST = 64  # characters of a pre-token that is kept for later texts

_PLAIN_LATIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_plain = regex.compile(PLAIN).fullmatch


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_LATIN)
    except UnicodeEncodeError:
        return _plain(text) is not None


def _safe(text: str) -> bool:
    """Whether every space ends a pre-token: none stands between two white-space characters
    (in a plain text these are tab, line feed, return and space) or at the end."""
    return not ("  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" "))


class Lengths(dict):
    """Numbers of tokens. A key w stands for the pre-token " " + w, a key NUL + p for the text p alone."""

    def __init__(self, tokenizer: str, first: dict[str, int], cache: int):
        from tokenizers import Tokenizer

        super().__init__(first)
        self.first, self.cache = first, cache
        self.tok = Tokenizer.from_file(tokenizer)
        self.split = regex.compile(PRE_TOKEN).findall
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    _here: tuple[int, "Lengths"] | None = None

    @classmethod
    def here(cls, job: int, tokenizer: str, first: dict[str, int], cache: int) -> "Lengths":
        """This worker's table for the job: later tasks find what earlier ones have learnt."""
        if cls._here is None or cls._here[0] != job:
            cls._here = job, cls(tokenizer, first, cache)
        return cls._here[1]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, met: Iterable[str]) -> None:
        alone = [x for x in met if x[:1] == "\0"]
        self.update(zip(alone, self.whole([x[1:] for x in alone])))
        words = [x for x in met if x[:1] != "\0"]
        for i in range(0, len(words), 4096):  # together in one text: each border between them holds
            some = words[i:i + 4096]
            start = np.cumsum([0] + [len(w) + 1 for w in some])
            at = np.array([a for a, _ in self.tok.encode("".join([" " + w for w in some]), add_special_tokens=False).offsets])
            n = np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(some))
            self.update(zip(some, n.tolist()))

    def keys_of(self, text: str) -> list[str] | None:
        """The keys whose lengths add up to the text's; None if only the library can tell."""
        if not _is_plain(text) or any(a in text for a in self.added):
            return None
        if not _safe(text):
            return ["\0" + p for p in self.split(text)]
        keys = text.split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    def counts(self, texts: list[str]) -> list[int]:
        out, lo = [], 0
        while lo < len(texts):  # some texts together, so that the library is called for many pre-tokens at once
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 19):
                size += len(texts[hi])
                hi += 1
            out += self._counts(texts[lo:hi])
            lo = hi
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        keys = [self.keys_of(t) for t in texts]
        if len(self) > len(self.first) + self.cache:
            self.clear()
            self.update(self.first)
        met = set().union(*(k for k in keys if k)).difference(self)
        if met:
            self.learn(met)
        out = [sum(map(self.__getitem__, k)) if k is not None else self.whole([t])[0] for k, t in zip(keys, texts)]
        for x in met:
            if len(x) > LONGEST:
                del self[x]
        return out


def frequent_pre_tokens(docs: DataFrame, text: str, frequent: int, per_task: int) -> list[str]:
    """The commonest pre-tokens (without their space) of all texts, as far as some task's
    ``per_task`` commonest show them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and _is_plain(t) and _safe(t):
                    words = t.split(" ")
                    total.update(words if max(map(len, words)) <= LONGEST else [w for w in words if len(w) <= LONGEST])
                if len(total) > 64 * per_task:  # a bounded summary: the rarest go
                    total = Counter(dict(total.most_common(16 * per_task)))
        top = [(k, n) for k, n in total.most_common(per_task) if k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    top = frames.arrow(docs.select(F.col(f"`{text}`")), run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return [r[0] for r in top.orderBy(F.desc("n"), "p").limit(frequent).collect()]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", frequent: int = 32_768, per_task: int = 4_096,
                 cache: int = 1_000_000) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``; ``tokenizer`` is the path of the
    tokenizer's .json file, readable on every worker."""
    spark = docs.sparkSession
    top = frequent_pre_tokens(docs, text, frequent, per_task)
    first = Lengths(tokenizer, {}, 0)
    first.learn(top)
    sent, job = spark.sparkContext.broadcast(dict(first)), uuid.uuid4().int

    def make():
        lengths = Lengths.here(job, tokenizer, sent.value, cache)

        def f(texts: pa.Array) -> list[pa.Array]:
            strings = [x or "" for x in texts.to_pylist()]
            return [pa.array([len(x.encode()) for x in strings], pa.int64()), pa.array(lengths.counts(strings), pa.int64())]
        return f

    return frames.map_text(docs, text, make, OUT)
