"""Language identification by a bidirectional gated recurrent network over bytes.

The network (a GRU in each direction, a softmax over both states at each byte)
is trained in numpy by backpropagation through time on a bounded sample of
labelled rows: at most ``sample`` spans of ``span`` characters in each
language, drawn by a hash of the row's text over the whole table. Then every
byte of every text is labelled; a document's probabilities are the mean over
its bytes. Texts are cut in segments of ``SEGMENT`` bytes only to be computed
side by side: each segment starts from the zero state in both directions, and
no byte is left out.

Edge cases. Null text, or a text without any letter: ``und`` with score 0.
No labelled row at all: ``und`` for all. One language only: that one, score 1.
Rows are independent of each other, so repeated rows and ties need no rule
(equal probabilities: the language that sorts first). Empty tables give empty
results. Columns pass through; ``lang_pred`` and ``score`` replace columns of
these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardbook.llm import frames, textops

SEGMENT = 128
SIDE = 2048  # segments computed together

OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5
    return a


@dataclass
class Model:
    """``p``: for each direction d in f, b and gate g in z, r, n the byte table Td_g (256, H) and
    the recurrent Ud_g (H, H); the softmax W (2H, languages) and its bias."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> "Model":
        p = {}
        for d in "fb":
            for g in "zrn":
                p[f"T{d}{g}"] = rng.normal(0, 0.3, (256, hidden))
                p[f"U{d}{g}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        p["W"] = rng.normal(0, 0.3, (2 * hidden, len(langs)))
        p["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def states(self, x: np.ndarray, d: str, keep: list | None = None, length: np.ndarray | None = None) -> np.ndarray:
        """The states (time, texts, H) after each byte of x (time, texts), in direction d;
        0 from a text's end on. ``length`` ascends; without it all texts fill x."""
        p = self.p
        tz, tr, tn, uz, ur, un = (p[f"{k}{d}{g}"] for k in "TU" for g in "zrn")
        out = np.zeros((*x.shape, uz.shape[0]), np.float32)
        zero = np.zeros(out.shape[1:], np.float32)
        ended = np.searchsorted(length, np.arange(len(x)), "right") if length is not None else np.zeros(len(x), np.int64)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a0, before = ended[t], t - 1 if d == "f" else t + 1
            h = (out[before] if 0 <= before < len(x) else zero)[a0:]
            xt = x[t, a0:]
            z, r, a = tz.take(xt, axis=0), tr.take(xt, axis=0), tn.take(xt, axis=0)
            z += h @ uz
            r += h @ ur
            _sigmoid(z)
            _sigmoid(r)
            m = h @ un
            a += r * m
            n = np.tanh(a, out=a)
            if keep is not None:
                keep.append((t, h, z, r, m, n))
            new = np.subtract(h, n, out=out[t, a0:])
            new *= z
            new += n
        return out

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(languages, time, texts)."""
        h = self.p["Ufz"].shape[0]
        s = (self.states(x, "f", None, length).reshape(-1, h) @ self.p["W"][:h]
             + self.states(x, "b", None, length).reshape(-1, h) @ self.p["W"][h:])
        s = np.ascontiguousarray((s + self.p["c"]).T)
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s.reshape(-1, *x.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of labelling every byte of x (time, texts) with its text's y, and its gradients."""
        p, hid, g = self.p, self.p["Ufz"].shape[0], {}
        kept = {d: [] for d in "fb"}
        both = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], axis=2)
        s = both @ p["W"] + p["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        at = np.arange(len(y))
        loss = -float(np.log(s[:, at, y] + 1e-9).mean())
        s[:, at, y] -= 1
        s /= x.size
        g["W"] = both.reshape(-1, 2 * hid).T @ s.reshape(-1, len(self.langs))
        g["c"] = s.sum(axis=(0, 1))
        up = s @ p["W"].T
        flat = x.astype(np.int64)
        for i, d in enumerate("fb"):
            uz, ur, un = p[f"U{d}z"], p[f"U{d}r"], p[f"U{d}n"]
            dh = np.zeros((x.shape[1], hid), np.float32)
            rows = {k: [] for k in ("t", "h", "z", "r", "n", "m")}
            for t, h, z, r, m, n in reversed(kept[d]):
                dh = dh + up[t, :, i * hid:(i + 1) * hid]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                dm = dn * r
                dh = dh * z + dz @ uz.T + dr @ ur.T + dm @ un.T
                for k, v in (("t", flat[t]), ("h", h), ("z", dz), ("r", dr), ("n", dn), ("m", dm)):
                    rows[k].append(v)
            r = {k: np.concatenate(v) for k, v in rows.items()}
            one = np.zeros((256, len(r["t"])), np.float32)
            one[r["t"], np.arange(len(r["t"]))] = 1
            for k in "zrn":
                g[f"T{d}{k}"] = one @ r[k]
                g[f"U{d}{k}"] = r["h"].T @ r["m" if k == "n" else k]
        return loss, g


def train(langs: list[str], spans: list[bytes], labels: list[int], hidden: int = 8, steps: int = 500, side: int = 192, length: int = 64, seed: int = 7) -> Model:
    """Adam on random windows of the spans (shorter spans are repeated to the length)."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(langs, hidden, rng)
    if len(langs) < 2:
        return model
    by = [[np.frombuffer(s, np.uint8) for s, y in zip(spans, labels) if y == k and s] for k in range(len(langs))]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), side)
        x = np.empty((length, side), np.uint8)
        for j, k in enumerate(y):
            s = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(s) - length + 1))
            x[:, j] = np.resize(s[at:at + length], length)
        _, g = model.gradients(x, y)
        rate = 0.02 * min(1.0, 4 * (1 - (step - 1) / steps))
        for k, v in g.items():
            v = np.clip(v, -0.1, 0.1)
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            model.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    return model


def label(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all bytes of each text (texts, languages)."""
    size = np.diff(offs)
    n = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), n)
    start = offs[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(SEGMENT, offs[1:][text] - start)
    total = np.zeros((len(size), len(model.langs)))
    order = np.argsort(length, kind="stable")  # like lengths side by side: little padding
    for lo in range(0, len(order), SIDE):
        seg = order[lo:lo + SIDE]
        at = start[seg] + np.arange(length[seg].max())[:, None]
        own = at < (start + length)[seg]
        prob = model.probabilities(data[np.minimum(at, len(data) - 1)], length[seg])
        for k in range(len(model.langs)):
            total[:, k] += np.bincount(text[seg], weights=(prob[k] * own).sum(axis=0), minlength=len(size))
    return total / np.maximum(size, 1)[:, None]


def has_letter(texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.r_[0, np.cumsum(_ASCII_LETTER[data[offs[0]:offs[-1]]])]
    out = seen[offs[1:] - offs[0]] > seen[offs[:-1] - offs[0]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = LETTER.search(texts[int(i)].as_py() or "") is not None
    return out


def fit(docs: DataFrame, where: Column | None = None, text: str = "text", lang: str = "lang", sample: int = 600, span: int = 256) -> Model:
    """Train on at most ``sample`` spans of each language from the labelled rows in ``where``."""
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return Model([], {})
    # a hash keeps about twice the wanted rows of each language, the smallest hashes of these are the sample
    keep = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * sample + 50) / n)))])
    h = F.xxhash64("t")
    rows = rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < keep[F.col("l")] * (1 << 30))
    piece = F.substring("t", (F.pmod(F.shiftright("h", 30), F.greatest(F.length("t") - span + 1, F.lit(1))) + 1).cast("int"), F.lit(span))
    got = rows.where(F.col("t").rlike(r"\p{L}")).select("l", piece.alias("s"), "h").distinct().collect()
    spans, labels = [], []
    for k, l in enumerate(langs):
        own = sorted((r for r in got if r["l"] == l), key=lambda r: (r["h"], r["s"]))[:sample]
        spans += [r["s"].encode() for r in own]
        labels += [k] * len(own)
    some = sorted(set(labels))
    return train([langs[k] for k in some], spans, [some.index(k) for k in labels])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its mean probability over all bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def f(texts: pa.Array) -> list[pa.Array]:
            data, offs = textops.column(texts)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if own.langs and len(texts):
                letter = has_letter(texts, data, offs)
                for lo, hi in textops.chunks(offs):
                    prob = label(own, data, offs[lo:hi + 1])
                    best = prob.argmax(axis=1)
                    ok = letter[lo:hi]
                    pred[lo:hi][ok] = np.array(own.langs, object)[best[ok]]
                    score[lo:hi][ok] = np.clip(prob[np.arange(hi - lo), best][ok], 0, 1)
            return [pa.array(pred, pa.string()), pa.array(score)]
        return f

    return frames.map_text(docs, text, make, OUT)
