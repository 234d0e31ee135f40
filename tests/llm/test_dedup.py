"""Line and substring dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wardbook.llm.line_dedup import dedup_lines
from wardbook.llm.queries import QUERIES
from wardbook.llm.substring_dedup import dedup_substrings

SF = "/root/testdata/sf0.001"


def brute_words(docs, length):
    """docs: (doc_id, text) in order."""
    seen, out = {}, {}
    for d, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[s:s + length]), (d, s)) != (d, s):
                gone.update(range(s, s + length))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_lines(docs, window=3):
    seen, out = {}, {}
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for s in range(len(lines) - window + 1):
            k = tuple(lines[s:s + window])
            if any(k) and seen.setdefault(k, (d, s)) != (d, s):
                gone.update(range(s, s + window))
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None)
    return out


def table_rows(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_substrings_on_the_table(spark):
    want = brute_words(table_rows(spark), 20)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_dedup_substrings"](spark, SF).collect()}
    assert got == {k: (n, g, hashlib.sha256(x).hexdigest()) for k, (n, g, x) in want.items()}
    assert sum(g for _, g, _ in want.values()) > 0


def test_lines_on_the_table(spark):
    want = brute_lines(table_rows(spark))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op2_dedup_lines"](spark, SF).collect()}
    assert got == {k: (n, g, hashlib.sha256((x or "").encode()).hexdigest()) for k, (n, g, x) in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    """Few different words and lines: overlapping repeats in and between documents."""
    rng = random.Random(seed)
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "a\n" * 30), (43, "\n" * 20), (44, " ".join(["a b c d"] * 40))]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, places string, kept int").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"].encode()) for r in dedup_substrings(df, length=7, gram=3).collect()}
    assert got == brute_words(docs, 7)
    lines = dedup_lines(df)
    assert lines.columns == ["doc_id", "text", "places", "kept", "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.collect()}
    assert got == brute_lines(docs)


def test_odd_rows(spark):
    """Null ids come last, repeated rows get one answer, empty tables stay empty."""
    run = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(None, run + " x"), (3, run), (3, run), (5, run + " y")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in dedup_substrings(df).collect())
    assert got == [("3", 0), ("3", 0), ("5", 25), ("None", 25)]
    assert dedup_substrings(df.limit(0)).collect() == [] and dedup_lines(df.where(F.lit(False))).collect() == []


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(120_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50_000:50_100]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in dedup_substrings(df).collect()} == {1: 0, 2: 100}
