"""Token counts, mixing, decontamination and language ID: odd rows and brute force."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardbook.llm import decontaminate, language_id
from wardbook.llm.decontaminate import contamination, hit_words
from wardbook.llm.language_id import Model, fit, identify, label, train
from wardbook.llm.mixing import mix_sources, targets
from wardbook.llm.queries import QUERIES, tokenizer_path
from wardbook.llm.token_counts import LONGEST, Lengths, frequent_pre_tokens, token_counts

SF = "/root/testdata/sf0.001"


# -- token counts -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return lambda t: len(tok.encode(t or "", add_special_tokens=False))


def test_token_counts_on_the_table(spark, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    assert got == {d: (len((t or "").encode()), library(t), library(t) > 512) for d, t in texts.items()}


def test_token_counts_of_odd_texts(spark, library):
    rng = random.Random(5)
    bits = [*"ab '\n\t\r.!1é½ß²ªºµ", " ", "   ", "\xa0", "—", "\x1c", "\x85", "​", "中", "ñ", "𝟙", "'s", "'ll", "<|endoftext|>", " word", " Word,", "\n\n "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "a" * 50_000, "word " * 30_000, " lead", "end "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(4)
    out = token_counts(df, tokenizer_path(), frequent=50, per_task=20, cache=200)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: library(t) for i, t in enumerate(texts)}
    assert token_counts(df.limit(0), tokenizer_path()).collect() == []


def test_long_pre_tokens_are_counted_but_not_kept(spark, library):
    """Texts without spaces: neither the broadcast table nor a worker's cache holds their bytes."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh", k=n)) + " the end" for n in (LONGEST - 1, LONGEST, LONGEST + 1, 20_000, 20_000) for _ in range(10)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    top = frequent_pre_tokens(df, "text", 1000, 1000)
    assert {len(w) for w in top} == {3, LONGEST - 1, LONGEST}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, tokenizer_path()).collect()} == {i: library(t) for i, t in enumerate(texts)}
    lengths = Lengths(tokenizer_path(), {}, 1000)
    assert lengths.counts(texts) == [library(t) for t in texts] and max(map(len, lengths)) <= LONGEST


# -- mixing -------------------------------------------------------------------------------

def water(sizes, weights, total, cap):
    """Targets by raising the level until all is given out."""
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(cap * s, hi * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = sorted({f"s{rng.randrange(99)}" for _ in range(rng.randint(1, 12))}) + ([None] if seed % 2 else [])
    sizes = [rng.choice([0, 1, 10, 1000, 50_000, 50_000]) for _ in names]
    rows = list(zip(names, sizes))
    rng.shuffle(rows)
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(rows, "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2.0)
    assert got == {n: pytest.approx(w, rel=1e-6, abs=1e-3) for n, w in zip(names, want)}


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", 1.0, "x") for i in range(600)] + [(None, "a b", None, None, "x"), (7, None, "s0", -1.0, "x"), (8, "", "empty", float("nan"), "x"), (9, "a b c", "s1", 0.0, "x"), (9, "a b c", "s1", 0.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double, taken string").repartition(5)
    out = mix_sources(df, quality="q")
    assert out.columns == ["doc_id", "text", "source", "q", "size", "source_size", "target", "repeats", "taken"]
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(2), quality="q").collect()))
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["repeats"] * r["size"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for s, own in by.items():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6
    assert mix_sources(df.limit(0)).collect() == []
    assert [r["target"] for r in mix_sources(df.where("source = 'empty'")).collect()] == [0.0]


def test_better_documents_are_drawn_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 2000, "one").otherwise("two").alias("source"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("q"))
    drawn = {r[0]: r[1] for r in mix_sources(df, quality="q", share=1.2).where("source = 'two'").groupBy("q").agg(F.avg("repeats")).collect()}
    assert drawn[1.0] > drawn[0.25] + 0.2


# -- decontamination ------------------------------------------------------------------------

def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def brute(docs, items, width):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(width, len(x))
            own = {tuple(x[s:s + n]) for s in range(len(x) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s:s + n]) in own:
                    hit.update(range(s, s + n))
                    if i is not None:
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination(spark, blocks):
    rng = random.Random(blocks)
    text = lambda n: " ".join(rng.choices("aa bb cc DD e-e é7 11".split(), k=n))
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(40, None), (None, text(6)), (41, "Aa, bb! cc?"), (42, "aa bb cc"), (42, "aa bb cc")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(70, None), (71, ""), (72, "Aa;BB:cc"), (73, "aa " * 20_000)]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, spans string, items int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t or "") for _, t in items)
    out = contamination(df, bench, width=5, block_words=-(-size // (2 * blocks)))
    assert out.columns == ["doc_id", "text", "n_words", "spans", "items"]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in out.withColumn("n_hit", hit_words()).collect()}
    assert got == brute(docs, items, 5)
    assert contamination(df.limit(0), bench).collect() == []
    assert {tuple(r["spans"]) for r in contamination(df, bench.limit(0)).collect()} == {()}


def test_spans_merge():
    m = decontaminate.merge_spans(np.array([0, 3, 8, 9]), np.array([2, 5, 9, 12, 20, 21]))
    assert m.tolist() == [0, 5, 8, 12, 20, 21]


# -- language ID ------------------------------------------------------------------------------

def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    model = Model.fresh(["a", "b", "c"], 3, rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(97, 101, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, g = model.gradients(x, y)
    for k, v in model.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 5)] + ([(98, 1)] if k[0] == "T" else []):
            old = v[at]
            v[at] = old + 1e-3
            up, _ = model.gradients(x, y)
            v[at] = old - 1e-3
            down, _ = model.gradients(x, y)
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3), (k, at)


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in rows if got[r[0]]["held_out"] and r[1] is not None and got[r[0]]["lang_pred"] != "und"]
    assert len(got) == len(rows) and np.mean([got[d]["lang_pred"] == l for d, l in held]) > 0.95


def test_segments_change_nothing_for_others():
    """A text's result does not depend on the texts beside it."""
    m = train(["x", "y"], [b"abc abd", b"zzy zyx"] * 3, [0, 1] * 3, steps=20)
    texts = [b"abc", b"z" * 300, b"abd zzy " * 70, b"q"]
    offs = np.cumsum([0] + [len(t) for t in texts])
    both = label(m, np.frombuffer(b"".join(texts), np.uint8), offs)
    for i, t in enumerate(texts):
        assert label(m, np.frombuffer(t, np.uint8), np.array([0, len(t)])) == pytest.approx(both[i:i + 1], abs=1e-5)
    assert both.sum(axis=1) == pytest.approx(np.ones(4), abs=1e-4)


def test_language_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "train", lambda langs, spans, labels: train(langs, spans, labels, steps=30))
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der Hund und die Katze", "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 345 !", "de", "x"), (6, "ж", None, "x"), (7, "the " * 60_000, "en", "x"), (1, "the cat and the dog", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = identify(df, fit(df))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert all(0 <= s <= 1 and p in ("en", "de", "und") for _, p, s in got)
    assert {d for d, p, _ in got if p == "und"} == {3, 4, 5} and len(got) == len(rows)
    assert {r["lang_pred"] for r in identify(df, fit(df.where(F.lit(False)))).collect()} == {"und"}
    one = identify(df, fit(df.where("lang = 'en'"))).where("lang_pred != 'und'").collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}


def test_the_tokenizers_folder_is_a_parameter(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_DIR", "/some/where")
    assert tokenizer_path() == os.path.join("/some/where", "byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5])
def test_mix_of_tied_rows(spark, ids):
    """Rows that tie in key, id and size are drawn one by one: a target is met to within half a document."""
    rows = [(ids(i), "w " * 10, "a", str(i)) for i in range(1000)] + [(i, "w " * 7, "b", "") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(6)
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    for s, size in (("a", 10), ("b", 7)):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2 and 0 < sum(r["taken"] for r in own) != 2 * own[0]["source_size"]
        assert all(0 <= r["taken"] <= 2 * size for r in own)
    again = mix_sources(df.repartition(3)).collect()
    assert sorted((r["source"], r["note"], r["taken"]) for r in out if r["source"] == "a") == sorted((r["source"], r["note"], r["taken"]) for r in again if r["source"] == "a")
