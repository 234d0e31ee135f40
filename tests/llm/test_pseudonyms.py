"""Pseudonyms: formats, validation, linkage, and nothing else touched."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from wardbook.llm.pseudonyms import feistel, pseudonymise
from wardbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def swap(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, found string, pii_kinds int")
    out = pseudonymise(df, key)
    assert out.columns == ["doc_id", "text", "found", "pii_kinds"]
    return [(r["text"], r["pii_kinds"]) for r in out.orderBy("doc_id").collect()]


SHAPES = [
    ("4539578763621486", "card", r"\d{16}"), ("4539 5787 6362 1486", "card", r"\d{4} \d{4} \d{4} \d{4}"), ("3782-822463-10005", "card", r"\d{4}-\d{6}-\d{5}"),
    ("+1 (743) 555-3824", "phone", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"), ("743.555.3824", "phone", r"[2-9]\d\d\.[2-9]\d\d\.\d{4}"), ("+44 (143) 055-3824", "phone", r"\+44 \(\d{3}\) \d{3}-\d{4}"),
    ("123-45-6789", "ssn", r"\d{3}-\d\d-\d{4}"), ("217.94.102.185", "ip", r"\d+\.\d+\.\d+\.\d+"), ("1987-02-28", "date", r"\d{4}-\d\d-\d\d"), ("28.02.1987", "date", r"\d\d\.\d\d\.\d{4}"),
    ("02/28/1987", "date", r"\d\d/\d\d/\d{4}"), ("hein.19@mail5.example.com", "email", r"\w+@mail5\.example\.com"), ("04dbebab91ab85687d33eeaaf9b0b3c6a43eb78a", "secret", r"[0-9a-f]{40}"),
]


def test_each_kind(spark):
    got = swap(spark, [f"x {v}, y" for v, _, _ in SHAPES])
    for (v, kind, shape), (t, kinds) in zip(SHAPES, got):
        new = re.fullmatch(f"x ({shape}), y", t)
        assert new and new[1] != v and list(kinds) == [kind], (v, t)
        if kind == "card":
            assert luhn(new[1])
        if kind == "ip":
            assert all(int(x) < 256 for x in new[1].split("."))
    days = [dt.datetime.strptime(got[i][0][2:12], f).date() for i, f in ((8, "%Y-%m-%d"), (9, "%d.%m.%Y"), (10, "%m/%d/%Y"))]
    assert len(set(days)) == 1  # one day in three notations stays one day
    assert re.sub(r"\D", "", got[0][0]) == re.sub(r"\D", "", got[1][0])


@pytest.mark.parametrize("text", ["4539578763621487", "12345678901234567890123", "999.1.1.1", "1.2.3.4.5", "000-12-3456", "1987-02-30", "31.13.1987", "0099-01-01", "v2.0.", "a1987-02-28", "deadbeef" * 5, "3.", "", None, "é" * 50, "x@", "@y.com"])
def test_left_alone(spark, text):
    assert swap(spark, [text]) == [(text, [])]


def test_links_and_keys(spark):
    v = "4539578763621486"
    (a, _), (b, kinds), (c, _) = swap(spark, [f"{v} {v}", f"(é{v}) {v}\n217.94.102.185!!", "4539578763621494"])
    assert a.split()[0] == a.split()[1] == b.split()[1] and list(kinds) == ["card", "card", "ip"] and c != a.split()[0]
    assert swap(spark, [v], key="other")[0][0] != a.split()[0]


def test_a_permutation(spark):
    df = spark.range(35 * 28).select(feistel("k", F.lit("t"), F.floor(F.col("id") / 28), F.col("id") % 28, F.lit(35), F.lit(28)).alias("s"))
    assert df.select("s.a", "s.b").distinct().where("a >= 0 AND a < 35 AND b >= 0 AND b < 28").count() == 35 * 28


def test_the_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["text"] for r in QUERIES["op7_pseudonyms"](spark, SF).collect()}
    assert set(got) == set(docs)
    side = r"(?<![0-9A-Za-z])"
    personal = lambda t: {m for m in re.findall(side + r"\d{16}(?![0-9A-Za-z])", t) if luhn(m)} | set(re.findall(side + r"\+1 \(\d{3}\) \d{3}-\d{4}", t)) | set(re.findall(r"[\w.]+@mail\d\.example\.com", t))
    found = 0
    for d, t in docs.items():
        old = personal(t or "")
        found += len(old)
        assert not any(x in got[d] for x in old)
        if not re.search(r"\d|@", t or ""):
            assert got[d] == t
    assert found
