"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Each source gets a share of the mix by weight, stopped at
``cap`` times its own size, the excess reshared by weight (water-filling).
A source whose target holds whole epochs takes these first; the fraction left
is drawn by Efraimidis-Spirakis sampling: each document gets the exponential
key -ln(u) / quality, u from a hash of its id, and documents are taken in
ascending order of key until the running sum of sizes meets the budget (a
document is in if at least half of it fits).

The running sum never puts a source in one task: keys fall in ``BUCKETS``
buckets that keep their order; sums per source and bucket (pre-aggregated map-
side) find the one bucket in which a source's budget ends, and only that
bucket's documents are sorted, without their texts, to find the last one in.
Whether a document is in is then a comparison with its source's last one.

Edge cases. Null text: size 0, never takes words. Null source: a source of its
own, last. Null id: hashes like an empty id. Null, non-finite or non-positive
quality: weight 1. Ties of keys go by id, then size; rows equal in these are
drawn together. Empty table, or no words at all: targets 0. Input columns pass
through; result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardbook.llm import frames
from wardbook.session import cut_lineage

BUCKETS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: sources up to this many are joined by broadcast (one small row each); more are shuffled
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sampling_key(doc_id: Column, quality: Column | None, seed: str) -> Column:
    """-ln(u) / quality with u in (0, 1) from 52 bits of an md5 hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / F.lit(float(1 << 52))
    if quality is None:
        return -F.log(u)
    q = quality.cast("double")
    return -F.log(u) / F.when((q > 0) & (q < float("inf")), q).otherwise(1.0)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1))
    s = (sizes.withColumn("weight", weight)
         .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
         .withColumn("level", F.col("limit") / F.col("weight")))
    # in ascending order of limit / weight: what is left for this source and those after it
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
         .withColumn("shares", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("full", F.col("limit") * F.col("shares") <= F.col("budget") * F.col("weight")))
    # sources before the first that stays below its limit are full; from there on the rest is shared
    s = s.withColumn("first", F.min(F.when(~F.col("full"), F.struct("level", F.col("source").isNull().alias("n"), "source", "budget", "shares"))).over(everything))
    here = F.struct("level", F.col("source").isNull().alias("n"), "source")
    open_ = F.col("first").isNotNull() & (here >= F.struct(F.col("first.level").alias("level"), F.col("first.n").alias("n"), F.col("first.source").alias("source")))
    target = F.when(open_, F.least(F.col("limit"), F.col("first.budget") * F.col("weight") / F.col("first.shares"))).otherwise(F.col("limit"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: str | None = None,
                size: str | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size`` (words; taken from the column ``size`` if named), ``source_size``,
    ``target`` (its source's), ``repeats`` (how often the mix holds the document) and
    ``taken`` (= size * repeats)."""
    name = lambda c: F.col(f"`{c}`")
    own = {"id": name(doc_id), "source": name(source), "size": name(size) if size else word_count(name(text)),
           "key": sampling_key(name(doc_id), name(quality) if quality else None, seed)}
    own = {k: v.alias(k) for k, v in own.items()}
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    narrow = docs.select(*own.values()).select("*", bucket)

    buckets = cut_lineage(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goals = goals.select(F.col("source").alias("s"), "source_size", "target",
                         F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
            .join(goals, same).where(F.col("before") < F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("bucket", "before", "rest")).alias("end")))
    ends = cut_lineage(ends.select(F.col("source").alias("s"), F.col("end.bucket").alias("last"), F.col("end.before").alias("before"), "end.rest"))
    small = ends.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else lambda x: x

    # in each source's last bucket: the last document of which at least half fits; of documents
    # in one place (equal key, id and size) as many as fit
    place = F.struct("key", F.col("id").isNotNull().alias("known"), "id", "size")
    places = (narrow.join(hint(ends), same & (F.col("bucket") == F.col("last")))
              .groupBy("source", place.alias("place"), "before", "rest").agg(F.count("*").alias("n")))
    order = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    own_size = F.col("place.size")
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * own_size).over(order), F.lit(0))
    fit = F.when(own_size > 0, F.floor((left - own_size / 2) / own_size) + 1).when(left >= 0, F.col("n")).otherwise(F.lit(0)).cast("long")
    edge = (places.withColumn("drawn", F.least("n", fit)).where("drawn > 0")
            .groupBy("source").agg(F.max(F.struct("place", "drawn", "n")).alias("edge")))
    last = ends.select(F.col("s").alias("e"), "last").join(edge, F.col("e").eqNullSafe(F.col("source")), "left").select("e", "last", "edge")
    goals = cut_lineage(goals.join(last, F.col("s").eqNullSafe(F.col("e")), "left").select("s", "source_size", "target", "epochs", "last", "edge"))

    rows = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), *own.values()).select("*", bucket).join(hint(goals), same)
    here = F.coalesce((F.col("bucket") == F.col("last")) & (place == F.col("edge.place")), F.lit(False))
    drawn = (F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & (place < F.col("edge.place"))) | (here & (F.col("edge.drawn") == F.col("edge.n")))
    rows = rows.withColumn("drawn", F.coalesce(drawn, F.lit(False)))
    if not goals.where("edge.drawn < edge.n").isEmpty():
        # only the rows of the place that is drawn in part are numbered
        turn = F.row_number().over(W.partitionBy("source").orderBy(F.xxhash64("row")))
        split = here & (F.col("edge.drawn") < F.col("edge.n"))
        rows = rows.where(~split).unionByName(rows.where(split).withColumn("drawn", turn <= F.col("edge.drawn")))
    repeats = F.col("epochs") + F.col("drawn").cast("long")
    out = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "repeats": repeats, "taken": F.col("size") * repeats}
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in out], *[v.alias(k) for k, v in out.items()])


def with_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", name: str = "__quality") -> DataFrame:
    """``docs`` with a quality weight: 1 for documents labelled good, 0.5 for bad, between
    for several labels, 0.75 for unlabelled ones."""
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label_id")).agg((0.5 + 0.5 * F.avg("quality")).alias(name))
    return docs.join(of, F.col(f"`{doc_id}`") == F.col("__label_id"), "left").withColumn(name, F.coalesce(name, F.lit(0.75))).drop("__label_id")
