"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from wardbook.llm.jaccard_join import Join, similar_documents
from wardbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(docs, percent=75):
    """docs: (doc_id, text); (doc_id, n_shingles, component_id)."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            e, t = sets[j]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return sorted((d, len(s), top(d)) for d, s in sets)


def near_copies(rng, n, words=60, vocabulary=3000):
    base = [str(rng.randrange(vocabulary)) for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(words)] = str(rng.randrange(vocabulary))
        out.append(" ".join(x))
    return out


def test_the_table(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op1_jaccard_join"](spark, SF).collect()))
    assert got == brute(docs)
    assert any(d != c for d, _, c in got)


@pytest.mark.parametrize("block", [8192, 16])
def test_dense_groups(spark, block):
    """Near copies around the threshold, copies, short texts; also dealt out by pairs of blocks."""
    rng = random.Random(block)
    texts = near_copies(rng, 120) + near_copies(rng, 60, words=30) + near_copies(rng, 40, words=200)
    texts += [texts[3]] * 30 + ["a b", "A  b", "a", "", None, "a b c d e", "b a"] + [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(40)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, doc int, node string").repartition(6)
    assert sorted(map(tuple, similar_documents(df, block=block).collect())) == brute(docs)


def test_join_of_sets():
    """All links that join components are found, whatever the order."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 400, 40)
    sets = [np.unique(np.r_[base[rng.random(40) < 0.9], rng.integers(0, 400, 4)]).astype(np.uint64) for _ in range(150)]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    want = list(range(len(sets)))
    for x, linked in Join(sets, 75).links():
        for y in linked:
            assert 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))
            up[top(int(y))] = top(x)
    got = [top(i) for i in range(len(sets))]
    up = want
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                up[top(i)] = top(j)
    want = [top(i) for i in range(len(sets))]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got))


def test_odd_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (9, text), (9, "x y z"), (4, "x y z"), (7, None), (7, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in similar_documents(df).collect()))) == sorted(map(str, [(None, 3, None), (9, 3, 4), (9, 1, 4), (4, 1, 4), (7, 0, 7), (7, 0, 7)]))
    assert similar_documents(df.limit(0)).collect() == []


def test_texts_of_one_id_alike_in_size(spark):
    """Two texts of one id with as many shingles and the same smallest one keep the links of both."""
    import random

    from wardbook.llm import textops
    from wardbook.llm.jaccard_join import document_sets
    rng = random.Random(3)
    rows, want, extra = [], {}, 100_000
    for group in range(20):
        words = [f"g{group}w{i}" for i in range(40)]
        changed = []
        gram = None
        for i in range(4, 36, 5):  # edits that keep the smallest shingle
            w = list(words)
            w[i] = f"e{group}x{i}"
            data, offs = textops.column(__import__("pyarrow").array([" ".join(w)]))
            g, first = document_sets(data, offs, 5)
            if gram is None or int(g[0]) == gram:
                gram = int(g[0])
                changed.append(" ".join(w))
        a, b = changed[0], changed[-1]
        if a == b:
            continue
        # each of the two has a partner of its own, under another id
        for t in (a, b):
            rows.append((group, t))
            extra += 1
            rows.append((extra, t + f" tail{rng.random()}"))
            want[extra] = group
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in similar_documents(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(want) >= 20 and all(got[d] == {c} for d, c in want.items())
