"""Prefix trie, scaled sketches and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardbook.llm import prefix_trie, scaled_sketch, spelling
from wardbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_trie(convs):
    """convs: id -> turns (role, text); rows as op11 returns them."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(trie):
    nodes = trie.nodes.join(prefix_trie.joined_sha256(trie.ends, "node", "conv", span=3), "node", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    return {(r["conv"], r["depth"], r["parent_conv"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["sha256"] or none) for r in nodes}, len(nodes)


def test_trie_of_the_table(spark):
    convs, rebuilt = defaultdict(list), {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    rows = QUERIES["op11_prefix_trie"](spark, SF).collect()
    assert {tuple(r) for r in rows} == brute_trie(rebuilt) and len({(r["conv_id"], r["depth"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("head,width", [(8, 32), (2, 3), (1, 1)])
def test_tries_over_several_blocks(spark, head, width):
    """Shared starts, whole copies, prefixes of others, and conversations over several blocks."""
    rng = random.Random(head)
    convs = {c: [(rng.choice("ua"), rng.choice(["", "x", "xé"])) for _ in range(rng.choice([1, 2, 3, 9, 11]))] for c in range(40)}
    convs |= {100 + c: convs[7][:n] for c, n in enumerate([1, 5, 9, 11, 11])}
    rows = [(c, i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    coded = prefix_trie.code_turns(spark.createDataFrame(rows, TURNS).repartition(5))
    got, n = trie_rows(prefix_trie.trie_of(coded, head, width))
    assert got == brute_trie(convs) and n == len(got)


def test_odd_turns(spark):
    """Null role, text, turn and id; ties, repeated rows, empty and long texts, further columns, turnless conversations."""
    long = "w" * 300_000
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 1, "u", long), (2, 5, "u", "first"), (2, 9, "", ""), (2, 9, "", ""), (None, 0, "u", "lost"), (3, 1, "u", "b"), (3, 1, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", code int, node string")
    tied = sorted(("b", "a"), key=lambda t: hashlib.md5(f"1:u{t}".encode()).digest())
    convs = {1: [("u", "first"), ("", ""), ("u", long)], 2: [("u", "first"), ("", ""), ("", "")], 3: [("u", t) for t in tied]}
    assert trie_rows(prefix_trie.prefix_trie(df))[0] == brute_trie(convs)
    assert trie_rows(prefix_trie.prefix_trie(df.where("conv_id is null")))[0] == set()
    # 105 and 107 lose all turns of their own: their base is absent
    bare = {c: [("u", "x")] for c in range(101, 130)}
    coded = prefix_trie.code_turns(spark.createDataFrame([(c, 0, *v[0]) for c, v in bare.items()], TURNS))
    want = {c: v[zlib.crc32(str(c).encode()) % 6:] for c, v in bare.items()}
    assert trie_rows(prefix_trie.trie_of(prefix_trie.graft(coded)))[0] == brute_trie(want) and [] in want.values()


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints_of_the_table(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op12_fingerprints"](spark, SF).collect()}
    wrong, seen = [], {}
    for i, (d, t) in enumerate(docs):
        r, nxt = got[d], docs[(i + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a = shingles(t)
        if a:
            wrong += [abs(r["near_edited"] - len(a & shingles(edited)) / len(a)), abs(r["near_next"] - len(a & shingles(nxt)) / len(a))]
    assert len(got) == len(docs) and sum(wrong) / len(wrong) < 0.05


def test_sketches_hold_the_hashes_below_the_fraction(spark):
    """With scale 1 all shingles stay, so shares are exact; a larger scale keeps a part of the same hashes."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS).repartition(7)
    got = {r["id"]: r for r in scaled_sketch.sketch_edits(df, scale=1).collect()}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        a, b = shingles(t), shingles(nxt)
        assert len(got[d]["sketch"]) == 8 * len(a)
        assert got[d]["in_next"] == pytest.approx(len(a & b) / len(a) if a else float(not b))
        assert got[d]["like_next"] == pytest.approx(len(a & b) / len(a | b) if a or b else 1.0)
    parts = lambda x: {bytes(x[i:i + 8]) for i in range(0, len(x), 8)}
    all_, some = ({r["doc_id"]: parts(r["sketch"]) for r in scaled_sketch.sketch_documents(df, scale=s).collect()} for s in (1, 4))
    for d in all_:
        assert some[d] == ({h for h in all_[d] if h < (2**64 // 4).to_bytes(8, "big")} or ({min(all_[d])} if all_[d] else set()))
    merged = scaled_sketch.merge_sketches(scaled_sketch.sketch_documents(df.withColumn("g", F.col("doc_id") % 2), scale=1), "g").collect()
    assert Counter(r["g"] for r in merged) == {g: len(set().union(*(all_[d] for d in all_ if d % 2 == g))) for g in (0, 1)}


def test_odd_documents(spark):
    """Null and repeated ids, null, empty and very long texts, many copies, single and empty tables, clashing names."""
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(None, "null id comes first here"), (1, None), (1, ""), (2, long), (3, "é" * 9), (3, "é" * 9), (3, "é" * 9), (4, "last one")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS + ", sketch string, copies int").repartition(3)
    got = scaled_sketch.sketch_edits(df).collect()
    digests = Counter((r["id"], r["edited_sha256"]) for r in got)

    def edit(t, nxt):
        return hashlib.sha256((t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]).encode()).hexdigest()

    want = Counter([(None, edit(rows[0][1], "")), (1, edit("", "")), (1, edit("", "")), (2, edit(long, "é" * 9)), (3, edit("é" * 9, "é" * 9)), (3, edit("é" * 9, "é" * 9)),
                    (3, edit("é" * 9, "last one")), (4, edit("last one", rows[0][1]))])
    assert digests == want
    one = scaled_sketch.sketch_edits(df.where("doc_id = 4")).collect()
    assert [(r["id"], r["in_next"], r["n_chars"]) for r in one] == [(4, 1.0, 8)]
    assert scaled_sketch.sketch_edits(df.limit(0)).collect() == []
    assert scaled_sketch.sketch_documents(df).columns == ["doc_id", "text", "copies", "sketch"]
    many = spark.createDataFrame([(7, "same text")] * 5000 + [(8, "other text")], DOCS).repartition(6)
    got = Counter((r["id"], r["edited_sha256"]) for r in scaled_sketch.sketch_edits(many).collect())
    assert got == {(7, edit("same text", "same text")): 4999, (7, edit("same text", "other text")): 1, (8, edit("other text", "same text")): 1}


def brute_variants(counts, ratio=2):
    patterns, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for i in range(len(w)):
            patterns[w[:i], w[i + 1:]].add(w)
            less = w[:i] + w[i + 1:]
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in patterns.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(docs, least=5, every=97):
    out = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def test_variants_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_spelling_variants"](spark, SF).collect()
    want = brute_variants({w: n for w, n in counted(docs).items() if n >= 3})
    assert {tuple(r[c] for c in COLUMNS) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_dense_vocabularies(spark, most):
    """Words over few letters, of one letter up, so that groups are divided down to single letters."""
    rng = random.Random(most)
    words = {"".join(rng.choices("aabé", k=rng.randint(1, 7))): rng.randint(1, 50) for _ in range(400)} | {"ab" * 40: 3, "ab" * 39 + "b": 9}
    df = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n long").repartition(5)
    got = spelling.spelling_variants(df, most=most).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == brute_variants(words) and len(got) == len(words)


def test_odd_texts(spark):
    """Null text and id, repeated rows, letters beyond Latin-1, very long words and texts, clashing names, empty tables."""
    long = "x" * 70_000
    rows = [(None, "Hello hellö ×÷abc"), (1, None), (1, ""), (2, "naïve ÀÉÎ œuvre ŵord αβγ"), (3, f"{long} {long}y {long}"), (4, "Wörter wörter " * 20_000), (4, "same same"), (4, "same same")]
    for every in (0, 3):
        df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], DOCS + ", word string, n int").repartition(3)
        got = {r["word"].decode("latin-1"): r["n"] for r in spelling.word_counts(df, least=2, every=every).collect()}
        assert got == counted(rows, 2, every)
    words = spelling.word_counts(df, least=2)
    got = {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(words).collect()}
    assert got == brute_variants(counted(rows, 2, 0))
    assert spelling.spelling_variants(words.limit(0)).collect() == []
