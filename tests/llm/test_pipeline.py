"""Every pipeline stage against brute force, on the table and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_dedup import brute_lines
from tests.llm.test_jaccard_join import brute
from wardbook.llm.language_id import fit, identify
from wardbook.session import cut_lineage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, size string, places string, id string"


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]

    model = fit(docs)
    rejected = {r["doc_id"] for r in identify(docs, model).collect() if r["lang_pred"] == "und" or r["score"] < cp.LEAST_SCORE}
    one = cut_lineage(stages["language_id"](spark, docs, SF))
    assert one.columns == docs.columns and set(by_id(one)) == set(by_id(docs)) - rejected

    two = cut_lineage(stages["line_dedup"](spark, one, SF))
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    left = {d: t for d, (_, gone, t) in brute_lines(rows).items() if not gone or re.search(r"[^\x09-\x0D\x20]", t)}
    assert two.columns == docs.columns and {d: r["text"] for d, r in by_id(two).items()} == left

    three = cut_lineage(stages["near_duplicates"](spark, two, SF))
    first = {d for d, _, c in brute(sorted(left.items())) if d == c}
    assert three.columns == docs.columns and {d: r["text"] for d, r in by_id(three).items()} == {d: left[d] for d in first}

    four = cut_lineage(stages["decontamination"](spark, three, SF))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {d for d in first if not any(tuple(w[i:i + n]) in windows for w in [words(left[d])] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))}
    assert four.columns == docs.columns and set(by_id(four)) == clean and clean < first

    last = by_id(stages["mixing"](spark, four, SF))
    sizes = {d: len(left[d].encode().split()) for d in clean}
    assert all(r["size"] == sizes[d] and 0 < r["taken"] == r["size"] * r["repeats"] <= 2 * r["size"] for d, r in last.items())
    longest = max(sizes.values())
    for s in {r["source"] for r in last.values()}:
        own = [r for r in last.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= longest


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows(spark, name):
    """Nulls everywhere, empty and repeated rows, clashing names, no rows at all."""
    text = "the house of the rising sun\nis in the old town\nby the sea\n" + "and many a word more " * 5
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, text + "x", "en", None, 3), (None, "", "de", "b", 0), (3, "123 456", "en", "a", 1),
            (4, "w " * 50_000, "en", "a", 9), (5, "a", None, "b", 1), (6, "der Hund und die Katze im Haus", "de", "b", 2)]
    df = spark.createDataFrame([(*r, "r", "s", "z", "p", "i") for r in rows], SCHEMA).repartition(3)
    stage = dict(cp.STAGES)[name]
    out = stage(spark, df, SF)
    if name != "mixing":
        assert out.columns == df.columns
    got = out.collect()
    assert all(r["row"] == "r" and r["places"] == "p" for r in got)
    kept = [r["doc_id"] for r in got]
    if name == "language_id":
        assert 2 not in kept and 3 not in kept and kept.count(1) == 2 and 4 in kept
    if name == "near_duplicates":
        assert kept.count(1) == 1 and kept.count(None) == 1  # the near copy without an id goes, the empty text stays
    if name == "decontamination":
        assert len(got) == len(rows)
    assert stage(spark, df.where(F.lit(False)), SF).collect() == []


def test_rows_are_judged_by_their_own_texts(spark):
    """Different texts under one id stay, whichever of them has copies; copies go also without an id."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(7, texts["a"]), (7, texts["b"]), (3, texts["a"] + " more"), (None, texts["c"]), (None, texts["c"]), (None, texts["d"]), (9, texts["d"]), (8, texts["d"]), (8, texts["c"] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in cp.near_duplicates(spark, df, SF).collect()))
    assert got == sorted([(7, texts["b"]), (3, texts["a"] + " more"), (8, texts["d"]), (8, texts["c"] + " x")])


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns[-5:] == ["size", "source_size", "target", "repeats", "taken"] and 0 < out.count() < 200


def test_stored_rows_are_numbered_by_their_places(spark, monkeypatch):
    """near_duplicates makes no copy of a stored table; rows that are not a file's rows one by one are stored."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(7, texts["a"]), (7, texts["b"]), (3, texts["a"] + " more"), (None, texts["c"]), (None, texts["c"]), (7, texts["b"])]
    stored = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    kept, cut = [], cp.cut_lineage
    monkeypatch.setattr(cp, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    want = sorted([(0, texts["c"]), (3, texts["a"] + " more"), (7, texts["b"])])
    got = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in cp.near_duplicates(spark, df, SF).collect())
    assert got(stored) == want and all(len(c) < 3 and "__1" not in c for c in kept)
    assert cp._placed(stored.union(stored)) is None and cp._placed(stored.select("*", F.explode(F.array(F.lit(1), F.lit(2))))) is None
    assert got(stored.union(stored)) == want
