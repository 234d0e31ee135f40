"""Prefix trie of conversations: every distinct sequence of first turns is a node.

Turn codes stand in positional columns, a block of them at a time, and one SQL
ROLLUP over these columns aggregates all prefixes of the block together;
``grouping_id`` tells each row's depth. Conversations longer than a block go on
in further blocks, whose rollup starts with the node that the conversation has
reached, so work grows with the number of turns and not with its square. A second
rollup, over the nodes and from the last block to the first, sums what lies below
each node; what a block's nodes hold goes to the node they hang on.

A turn's code is the MD5 of its role and text with the text's length; a node's key
is the MD5 of its path. The texts themselves are never moved.

Edge cases. Null role or text is empty. Turns stand in order of ``turn`` (null
first); ties go by the MD5 code, so repeated rows are repeated turns. Turns
without a conversation id belong to no conversation. A conversation without turns
(a row with null code in ``trie_of``) is a member of the root only. An empty table
has no node, not even a root. Only the four named columns are read, so further
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardbook.llm.frames import arrow
from wardbook.session import cut_lineage

#: key of the root
ROOT = md5(b"").digest()


@dataclass
class Trie:
    """``nodes``: node, parent (keys), depth, conv (smallest member), parent_conv, n_convs, n_children,
    n_leaves, saved; ``ends``: node, conv for every conversation and the node of its last turn."""

    nodes: DataFrame
    ends: DataFrame


def turn_code(role: Column, text: Column) -> Column:
    """20 bytes: MD5 of role and text, and the text's code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))


def _size(code: Column) -> Column:
    return F.conv(F.hex(F.substring(code, 17, 4)), 16, 10).cast("long")


def code_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (from 1, without gaps), code of every turn with a conversation id."""
    name = lambda c: F.col(f"`{c}`")
    coded = turns.where(name(conv_id).isNotNull()).select(name(conv_id).alias("conv"), name(turn).alias("turn"), turn_code(name(role), name(text)).alias("code"))
    order = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "code")
    return coded.select("conv", F.row_number().over(order).alias("at"), "code")


def _blocks(coded: DataFrame, head: int, width: int) -> DataFrame:
    """conv, block, rest (turns from the block's start on), codes of the block: ``head`` turns in the first, ``width`` in each further one."""
    of = W.partitionBy("conv")
    at = F.count("code").over(of.orderBy(F.asc_nulls_first("at"), "code").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    placed = coded.select("conv", "code", at.alias("at"), F.count("code").over(of).alias("total"))
    block = F.when(F.col("at") < head, F.lit(0)).otherwise(F.floor((F.col("at") - head) / width) + 1).cast("int")
    turn = F.when(F.col("code").isNotNull(), F.struct("at", "code"))
    rows = placed.groupBy("conv", block.alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.selectExpr("conv", "block", f"total - if(block = 0, 0, {head} + (block - 1) * {width}) AS rest", "t.code AS t")


def _key(width: int, among: str = "") -> str:
    """SQL: the key of the prefix (prev, c0, c1, ...); ``among`` limits the positions, as a condition on i."""
    codes = [f"if({among.format(i=i)}, c{i}, null)" if among else f"c{i}" for i in range(width)]
    return f"unhex(md5(concat(prev, {', '.join(f'coalesce({c}, X{chr(39) * 2})' for c in codes)})))"


def _rolled(rows: DataFrame, width: int, *sums: Column) -> DataFrame:
    """``sums`` for each prefix (prev, c0, c1, ...), by one ROLLUP; level: turns of the prefix in this block."""
    cols = [f"c{i}" for i in range(width)]
    rolled = rows.rollup("prev", *cols).agg(*sums, F.grouping_id().alias("gid"))
    level = (F.lit(width + 1) - F.length(F.bin(F.col("gid") + 1))).cast("int")
    last = F.expr(f"get(array({', '.join(cols)}), level - 1)")
    # a prefix longer than its conversation ends in null: no node
    return rolled.withColumn("level", level).withColumn("last", last).where("level = 0 or last is not null")


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """prev, c0.., level, conv, n_convs, leaf of the block's nodes (level 0: the node that the block hangs on)."""
    flat = rows.selectExpr("conv", "rest", "prev", *[f"get(t, {i}) AS c{i}" for i in range(width)])
    out = _rolled(flat, width, F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("rest").alias("longest"))
    return out.withColumn("leaf", F.col("longest") == F.col("level")).drop("gid", "longest")


def _below(nodes: DataFrame, width: int) -> DataFrame:
    """For each prefix its own node (of the nodes that start with it the one with the most members) and the sums over these nodes."""
    sums = _rolled(nodes, width, F.min("conv").alias("conv"), F.max("n_convs").alias("n_convs"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parent = f"CASE WHEN level = 1 THEN prev WHEN level > 1 THEN {_key(width, '{i} < level - 1')} END AS parent"
    return sums.where("prev is not null").selectExpr(f"if(level = 0, prev, {_key(width)}) AS node", parent, "level", "conv", "n_convs", "leaves", "saved")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trie_of(coded: DataFrame, head: int = 8, width: int = 32) -> Trie:
    """The trie of ``coded``: conv, at (any order), code; a null code only names a conversation."""
    blocks = cut_lineage(_blocks(coded, head, width))
    deepest = blocks.agg(F.max("block")).first()[0] or 0
    end = "if(size(t) = 0, prev, unhex(md5(aggregate(t, prev, (path, code) -> concat(path, code))))) AS node"
    rows, layers, ends = blocks.where("block = 0").withColumn("prev", F.lit(ROOT)), [], []
    for k in range(deepest + 1):
        w = width if k else head
        # written before the rollup, so that the blocks' wide plans are the same and compile once
        rows = cut_lineage(rows.selectExpr("conv", "rest", "prev", "t", end))
        layers.append(cut_lineage(_nodes(rows, w)))
        ends.append(rows.where(F.col("rest") <= w).select("node", "conv"))
        rows = blocks.where(F.col("block") == k + 1).join(rows.where(F.col("rest") > w).select("conv", F.col("node").alias("prev")), "conv")

    done, carry = [], None
    for k in range(deepest, -1, -1):
        w = width if k else head
        own = layers[k].withColumns({"leaves": F.col("leaf").cast("long"), "saved": (F.col("n_convs") - 1) * F.coalesce(_size(F.col("last")), F.lit(0))}).drop("leaf", "last")
        # the node that a block hangs on belongs to the block before; the root to the first
        own = own.where("level > 0") if k else own
        if carry is not None:
            own = own.withColumn("node", F.expr(f"if(level = 0, prev, {_key(w)})")).join(carry, "node", "left")
            own = own.withColumns({c: F.expr(f"{c} + coalesce(more_{c}, 0)") for c in ("leaves", "saved")})
        sums = cut_lineage(_below(own, w))
        start = head + (k - 1) * width if k else 0
        done.append((sums.where("level > 0") if k else sums).selectExpr("node", "parent", f"CAST(level + {start} AS BIGINT) AS depth", "conv", "n_convs", "leaves AS n_leaves", "saved"))
        carry = sums.where("level = 0").selectExpr("node", "leaves AS more_leaves", "saved AS more_saved")

    nodes = cut_lineage(_union(done))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    nodes = nodes.join(above, "parent", "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return Trie(nodes, _union(ends))


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Trie:
    """The trie of conversations as they stand in ``turns``."""
    return trie_of(code_turns(turns, conv_id, turn, role, text))


def graft(coded: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Rebuilds each conversation c on the first h turns of conversation c - c % ``every``
    (h: crc32 of c's decimal digits modulo ``most`` + 1), then its own turns after the first h.
    ``coded`` as ``code_turns`` gives it, read twice; every conversation is named by a row of null code."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1))
    convs = coded.where("at = 1").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    heads = coded.where((F.col("conv") % every == 0) & (F.col("at") <= most)).select(F.col("conv").alias("base"), "at", "code")
    copied = convs.join(heads, "base").where("at <= h").select("conv", "at", "code")
    own = coded.where(F.col("at") > h).select("conv", "at", "code")
    named = convs.select("conv", F.lit(None).cast("int").alias("at"), F.lit(None).cast("binary").alias("code"))
    return named.unionByName(copied).unionByName(own)


def joined_sha256(rows: DataFrame, key: str, value: str, span: int = 512) -> DataFrame:
    """``key`` and the SHA-256 (hex) of its distinct whole numbers in ascending order, comma-joined.

    Pieces of at most ``span`` numbers are joined first; a task then reads a key's pieces in
    order, one batch at a time, so its memory doesn't follow the key's size."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_set(value)), lambda x: x.cast("string")), ",")
    pieces = rows.groupBy(key, F.floor(F.col(value) / span).alias("span")).agg(piece.alias("piece"))
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, schema = None, None, None
        for b in batches:
            schema = pa.schema([b.schema.field(0), pa.field("sha256", pa.string())])
            keys, digests = [], []
            for k, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if state is not None and k == now:
                    state.update(b",")
                else:
                    if state is not None:
                        keys.append(now)
                        digests.append(state.hexdigest())
                    now, state = k, sha256()
                state.update(p.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(digests, pa.string())], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([state.hexdigest()])], schema=schema)

    ordered = pieces.select(key, "span", "piece").repartition(key).sortWithinPartitions(key, "span")
    return arrow(ordered, run, f"`{key}` {kind.simpleString()}, sha256 string")
