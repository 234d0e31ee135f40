"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each distinct vector gets, for each of ``trees`` trees, a string of 64 sign bits
of random projections (of the vector with one more coordinate that makes all
lengths equal, so that large inner products are small angles). The rows are
dealt out to shards of at most about ``shard`` vectors; a shard keeps its trees
as sorted arrays of strings, in which all strings of a common prefix lie
together. Queries come in blocks of at most ``block``, each broadcast to all
shards, twice:

1. Descent: in each tree, the strings around a query's own place are those with
   the longest common prefixes. Their vectors give a first list, which a task merges
   over its shards, and the score of its k-th, over all shards, is a bound.
2. Ascent: all trees go up together to the level at which a vector of the
   bounding score would be missed by all trees with a chance of ``miss`` at most.
   All vectors with a common prefix of that level in some tree are scored
   exactly. Where that level would bring a quarter of all vectors, the ascent
   goes on to the root: every vector is scored.

Copies of a vector are indexed once, with their k + 1 smallest ids. No cap is
set on candidates.

Edge cases. Vectors that are null, empty or zero, or hold a null or non-finite
component, take no part, as queries or candidates; nor does a null id. Vectors of
different dimensions are not compared. Fewer than k candidates: all of them. Ties
go to the smaller id. An id is never its own neighbour; a repeated query id is
searched once, with the smallest of its vectors. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wardbook.llm import blobs, frames
from wardbook.session import cut_lineage

SHARD = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("matrix", pa.binary()), ("ids", pa.binary()), ("copies", pa.binary()), ("labels", pa.binary()), ("order", pa.binary())])
SHARD_SQL = "shard long, dim int, matrix binary, ids binary, copies binary, labels binary, order binary"
BITS = 64


def taking_part(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _projections(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, trees * BITS))


def labels(x: np.ndarray, longest: float, trees: int, seed: int, query: bool) -> np.ndarray:
    """(trees, rows): the strings as numbers whose order is that of the strings."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    p = _projections(x.shape[1], trees, seed)
    out = np.empty((trees, len(x)), np.uint64)
    for lo in range(0, len(x), 8192):
        s = slice(lo, lo + 8192)
        bits = (x[s] @ p[:-1] + extra[s, None] * p[-1]) > 0
        out[:, s] = np.packbits(bits.reshape(-1, trees, BITS), axis=2).view(">u8")[:, :, 0].T
    return out


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component after component: equal vectors score equally."""
    out = np.zeros(len(v))
    for d in range(v.shape[1]):
        out += q[d] * v[:, d]
    return out


def _build(rows: DataFrame, partitions: int, longest: float, trees: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            v, ids = b.column(1), b.column(2)
            flat, at = v.values.to_numpy(), v.offsets.to_numpy()
            own, id_at = ids.values.to_numpy(), ids.offsets.to_numpy()
            size = np.diff(at)
            for s, dim in set(zip(b.column(0).to_pylist(), size.tolist())):
                i = np.flatnonzero((b.column(0).to_numpy() == s) & (size == dim))
                held.setdefault((s, dim), []).append((flat[at[i][:, None] + np.arange(dim)], np.diff(id_at)[i], blobs.take(own, id_at[i], np.diff(id_at)[i])))
        for (s, dim), parts in held.items():
            x, n, ids = (np.concatenate(c) for c in zip(*parts))
            label = labels(x, longest, trees, seed, query=False)
            order = np.argsort(label, axis=1, kind="stable")
            yield blobs.rows([(s, dim, x.tobytes(), ids.tobytes(), n.astype(np.int32).tobytes(), np.take_along_axis(label, order, 1).tobytes(), order.astype(np.int32).tobytes())], SHARD)

    return frames.arrow(rows.repartition(partitions, "shard"), run, SHARD_SQL)


class Shard:
    def __init__(self, r: dict, trees: int):
        self.x = np.frombuffer(r["matrix"]).reshape(-1, r["dim"])
        n = np.frombuffer(r["copies"], np.int32).astype(np.int64)
        self.ids, self.copies, self.at = np.frombuffer(r["ids"], np.int64), n, np.cumsum(n) - n
        self.labels = np.frombuffer(r["labels"], np.uint64).reshape(trees, -1)
        self.order = np.frombuffer(r["order"], np.int32).reshape(trees, -1)

    def around(self, q: np.ndarray, label: np.ndarray, k: int, width: int) -> np.ndarray:
        """(queries, k): the best scores among the strings next to each query's, -inf where there are fewer."""
        n, out = len(self.x), np.full((len(q), k), -np.inf)
        for lo in range(0, len(q), 256):
            s = slice(lo, min(lo + 256, len(q)))
            place = np.stack([np.searchsorted(lab, own) for lab, own in zip(self.labels, label[:, s])], axis=1)
            near = np.clip(place[:, :, None] + np.arange(-(width // 2), width - width // 2), 0, n - 1)
            some = np.concatenate([order[p] for order, p in zip(self.order, near.transpose(1, 0, 2))], axis=1)
            some.sort(axis=1)
            score = np.einsum("qcd,qd->qc", self.x[some], q[s])
            score[:, 1:][some[:, 1:] == some[:, :-1]] = -np.inf
            top = np.sort(score, axis=1)[:, ::-1][:, :k]
            out[s, :top.shape[1]] = top
        return out

    def ranges(self, label: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): where the strings with a common prefix of each query's level lie."""
        free = (np.uint64(1) << (BITS - level).astype(np.uint64)) - np.uint64(1)
        lo = np.stack([np.searchsorted(lab, own & ~free, "left") for lab, own in zip(self.labels, label)])
        hi = np.stack([np.searchsorted(lab, own | free, "right") for lab, own in zip(self.labels, label)])
        return lo, hi

    def best(self, q: np.ndarray, own_id: int, some: np.ndarray | None, scores: np.ndarray, bound: float, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best of ``some`` (all if None), not below the bound;
        ``slack`` is what two ways to add up a product may differ by."""
        keep = np.flatnonzero(scores >= bound - slack)
        if len(keep) > k + 1:  # the query's own vector may be one
            keep = keep[scores[keep] >= np.partition(scores[keep], -(k + 1))[-(k + 1)] - slack]
        rows = keep if some is None else some[keep]
        score = np.repeat(exact_scores(q, self.x[rows]), self.copies[rows])
        ids = blobs.take(self.ids, self.at[rows], self.copies[rows])
        score, ids = score[ids != own_id], ids[ids != own_id]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def levels(bound: np.ndarray, length: np.ndarray, longest: float, trees: int, miss: float) -> np.ndarray:
    """The level to ascend to for each query; 0 is the root."""
    cos = np.clip(np.where(np.isfinite(bound), bound, -np.inf) / np.maximum(length * longest, 1e-300), -1, 1)
    agree = 1 - np.arccos(cos) / np.pi  # chance that a sign bit agrees
    in_one = 1 - miss ** (1 / trees)  # chance that one tree must hold it with
    with np.errstate(divide="ignore"):
        level = np.floor(np.log(in_one) / np.log(np.maximum(agree, 1e-12)))
    level = np.where(agree >= 1, BITS, level).clip(0, BITS)
    return np.where(1 - (1 - 0.5**level) ** trees > 0.25, 0, level).astype(np.int64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 8,
            shard: int = 8192, block: int = 32_768, width: int = 16, miss: float = 0.02, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the k nearest of ``vectors``."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, vec_id, embedding)
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = cut_lineage(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    count, longest = distinct.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    longest = float(longest or 0.0)
    shards = max(1, -(-count // shard))
    index = cut_lineage(_build(distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "ids"), min(shards, 100_000), longest, trees, seed))

    asked = taking_part(queries, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    asked = cut_lineage(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2 * blocks))).repartition(2 * blocks, "block")) if blocks > 1 else cut_lineage(asked.withColumn("block", F.lit(0)))
    found = []
    for i in range(2 * blocks if blocks > 1 else 1):
        part = asked.where(F.col("block") == i).select("id", "v").toPandas()  # about block rows, the most that is broadcast
        if len(part):
            found.append(cut_lineage(_search(spark, index, part["id"].to_numpy(np.int64), list(part["v"]), k, longest, trees, width, miss, seed)))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(spark, index: DataFrame, ids: np.ndarray, rows: list, k: int, longest: float, trees: int, width: int, miss: float, seed: int) -> DataFrame:
    by = {}
    for dim in sorted({len(v) for v in rows}):
        at = np.array([j for j, v in enumerate(rows) if len(v) == dim])
        x = np.stack([np.asarray(rows[j], np.float64) for j in at])
        by[dim] = at, x, labels(x, longest, trees, seed, query=True)
    sent = spark.sparkContext.broadcast((ids, by))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by = sent.value
        top = np.full((len(ids), k + 1), -np.inf)  # one more: the query itself may be among them
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] in by:
                    at, x, label = by[r["dim"]]
                    both = np.concatenate([top[at], Shard(r, trees).around(x, label, k + 1, width)], axis=1)
                    top[at] = np.sort(both, axis=1)[:, :-(k + 2):-1]
        n = np.isfinite(top).sum(axis=1)
        if n.any():
            to = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.ListArray.from_arrays(to, pa.array(top[np.isfinite(top)]))], names=["at", "top"])

    tops = frames.arrow(index, descend, "at long, top array<double>").select("at", F.explode("top").alias("s"))
    kth = tops.withColumn("r", F.row_number().over(W.partitionBy("at").orderBy(F.desc("s")))).where(F.col("r") == k + 1).select("at", "s").toPandas()
    bound = np.full(len(ids), -np.inf)
    bound[kth["at"].to_numpy(np.int64)] = kth["s"].to_numpy(np.float64)
    bound_sent = spark.sparkContext.broadcast(bound)

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by = sent.value
        bound = bound_sent.value
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] not in by:
                    continue
                at, x, label = by[r["dim"]]
                own, out = Shard(r, trees), []
                length = np.sqrt((x * x).sum(axis=1))
                slack = 1e-9 * length * longest
                level = levels(bound[at], length, longest, trees, miss)
                root = np.flatnonzero(level == 0)
                for lo in range(0, len(root), 256):
                    some = root[lo:lo + 256]
                    for j, scores in zip(some, x[some] @ own.x.T):
                        out.append((j, *own.best(x[j], ids[at[j]], None, scores, bound[at[j]], slack[j], k)))
                rest = np.flatnonzero(level > 0)
                lo, hi = own.ranges(label[:, rest], level[rest])
                for c, j in enumerate(rest):
                    some = np.unique(np.concatenate([o[a:z] for o, a, z in zip(own.order, lo[:, c], hi[:, c])]))
                    if len(some):
                        out.append((j, *own.best(x[j], ids[at[j]], some, own.x[some] @ x[j], bound[at[j]], slack[j], k)))
                n = [len(i) for _, i, _ in out]
                cat = lambda c: np.concatenate(c) if c else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at[[j for j, _, _ in out]]], n) if out else np.zeros(0, np.int64)), pa.array(cat([i for _, i, _ in out]).astype(np.int64)), pa.array(cat([s for _, _, s in out]))], names=["query_id", "vec_id", "score"])

    return frames.arrow(index, ascend, "query_id long, vec_id long, score double")
