"""The trie of conversation prefixes, its subtree totals by parallel tree contraction.

A turn is known by hashes of its place, role and text; a prefix by the xor of its turns', twice 64
bits. Positions and prefixes come from scans over range partitions with the totals of earlier partitions
added, so one conversation may span many tasks. Subtree totals are summed by contraction: in each
iteration unary chains are compressed by pointer doubling and leaves raked into their parents; what is
left are branch nodes, at most half as many. Then the chains are expanded again, last ones first. Long
chains and bushy trees alike end after a number of joins that grows with the logarithm of the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.skew import salted_join

from .common import discard, saved

SIBLINGS = 5  # conversations c - c % 5 .. c share first turns
MOST_SHARED = 9  # a conversation takes crc32(c) % 9 turns of the first of them
_MARKS = ("a", "b")


def _laid(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows written in range partitions of ``order``, with the number of their partition."""
    spread = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return saved(spread)


def scanned(laid: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``n`` (rows of the key so far) and ``xor_a``, ``xor_b`` (of the marks so far), this row included.

    ``laid`` comes from ``_laid`` over (key, order). Windows run within a partition; the totals of a
    key's earlier partitions, one row each, are joined to it.
    """
    local = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(key, "part").agg(F.count("*").alias("n"), *[F.bit_xor(m).alias(m) for m in _MARKS])
    offsets = totals.select(
        key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
        *[F.coalesce(F.bit_xor(m).over(before), F.lit(0)).alias(f"skip_{m}") for m in _MARKS],
    )
    own = laid.select("*", F.row_number().over(local).alias("n"), *[F.bit_xor(m).over(local).alias(f"xor_{m}") for m in _MARKS])
    return own.join(offsets, [key, "part"]).select(
        *[c for c in laid.columns if c != "part"],
        (F.col("n") + F.col("skip")).alias("n"),
        *[F.col(f"xor_{m}").bitwiseXOR(F.col(f"skip_{m}")).alias(f"xor_{m}") for m in _MARKS],
    )


def _shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, a, b, bytes) for every rebuilt turn, (conv, length) for every conversation).

    ``turns`` holds conv, turn, role, bytes and the marks of role and text.
    """
    order = ["conv", "turn", "role", "a", "b"]
    laid = _laid(turns, order)
    placed = scanned(laid, "conv", order[1:]).drop("turn", "role", "xor_a", "xor_b")
    # n counts the turns of a conversation from 1
    sizes = laid.groupBy("conv").agg(F.count("*").alias("size"))
    takes = sizes.select("conv", "size", _shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % SIBLINGS).alias("first"))
    bases = sizes.select(F.col("conv").alias("first"), F.col("size").alias("first_size"))
    lengths = takes.join(bases, "first", "left").select(
        "conv", "first", "h", F.least("h", F.coalesce("first_size", F.lit(0))).alias("k"), "size"
    )
    lengths = saved(lengths.withColumn("length", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    heads = placed.where(F.col("n") < MOST_SHARED).withColumnRenamed("conv", "first")
    lead = (
        lengths.select("conv", "first", "h").join(heads, "first").where("n <= h")
        .select("conv", F.col("n").alias("depth"), *_MARKS, "bytes")
    )
    later = placed.where(F.col("n") > _shared_turns(F.col("conv")))
    own = salted_join(later, lengths.select("conv", "h", "k"), "conv", "n", measured=laid).select(
        "conv", (F.col("n") - F.col("h") + F.col("k")).alias("depth"), *_MARKS, "bytes"
    )
    return lead.unionByName(own), lengths.select("conv", "length")


def _node(depth: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((depth, "depth"), (a, "a"), (b, "b"))])


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, in order; rows are sorted by node and chunk."""
    node, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([digest.hexdigest()])], ["depth", "a", "b", "sha"])

    for batch in parts:
        for depth, a, b, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != (depth, a, b):
                if node is not None:
                    yield told()
                node, digest = (depth, a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk.encode())
    if node is not None:
        yield told()


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, sha) of the ascending ids of the conversations that end at a node.

    Ids are laid out in ranges and joined to one text for each node and range; a range is a partition,
    so thousands of equal conversations reach the task of their node as one row from each.
    """
    laid = _laid(ends, ["conv"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = laid.groupBy("depth", "a", "b", "part").agg(text.alias("chunk"))
    streamed = (
        chunks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part")
        .select("depth", "a", "b", "chunk").mapInArrow(_digests, "depth long, a long, b long, sha string")
    )
    return streamed.select(_node("depth", "a", "b").alias("node"), "sha")


def _any(df: DataFrame, condition: str) -> bool:
    return not df.where(condition).isEmpty()


def _to_the_end(chain: DataFrame) -> DataFrame:
    """Pointer doubling: each chain node (id, next, sums) gets the end of its chain and the sums up to
    there. Every round squares the reach, and next pointers are distinct, so no key is hot."""
    here = saved(chain.withColumn("moved", F.lit(True)))
    while _any(here, "moved"):
        far = here.select(F.col("id").alias("next"), F.col("next").alias("after"), *[F.col(c).alias(f"more_{c}") for c in ("leaves", "weight")])
        hopped = here.join(far, "next", "left").select(
            "id", F.coalesce("after", "next").alias("next"),
            *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "weight")],
            F.col("after").isNotNull().alias("moved"),
        )
        after = saved(hopped)
        discard(here)
        here = after
    return here.drop("moved")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(id, leaves, weight) summed over each node's subtree, itself included.

    ``nodes`` holds id and parent (null at a root) of any orderable type, and weight. A forest of any
    shape is contracted; an id whose parent is no node would be lost and must not occur.
    """
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    active = saved(
        nodes.join(parents, "id", "left").select("id", "parent", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaves"), F.col("weight").cast("long"))
    )
    chains, known = [], None
    while True:
        kids = active.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("only"))
        state = saved(active.join(kids, "id", "left"))
        discard(active)
        chain = state.where("kids = 1")
        if _any(chain, "true"):
            ended = _to_the_end(chain.select("id", F.col("only").alias("next"), "leaves", "weight"))
            chains.append(ended)
            # the top of a chain hangs from a branch node, or is a root
            below = chain.select(F.col("only").alias("id"))
            tops = (
                ended.join(below, "id", "left_anti").join(state.select("id", F.col("parent").alias("above")), "id")
                .select(F.col("next").alias("id"), "above", F.lit(True).alias("hung"), *[F.col(c).alias(f"chain_{c}") for c in ("leaves", "weight")])
            )
            rest = state.where("kids is null or kids > 1").join(tops, "id", "left")
            linked = saved(rest.select(
                "id", F.when(F.col("hung"), F.col("above")).otherwise(F.col("parent")).alias("parent"), "leaves", "weight", "kids",
                *[F.coalesce(f"chain_{c}", F.lit(0)).alias(f"chain_{c}") for c in ("leaves", "weight")],
            ))
        else:
            linked = saved(state.select("id", "parent", "leaves", "weight", "kids", F.lit(0).cast("long").alias("chain_leaves"), F.lit(0).cast("long").alias("chain_weight")))
        leaf = F.col("kids").isNull()
        final = linked.where(leaf).select("id", "leaves", "weight")
        known = final if known is None else known.unionByName(final)
        if not _any(linked, "kids > 1"):
            break
        raked = linked.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.col(f"chain_{c}") + F.when(leaf, F.col(c)).otherwise(0)).alias(f"more_{c}") for c in ("leaves", "weight")]
        )
        active = saved(linked.where("kids > 1").join(raked, "id", "left").select(
            "id", "parent", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "weight")]
        ))
        discard(state)
    for ended in reversed(chains):
        ends = known.select(F.col("id").alias("next"), *[F.col(c).alias(f"more_{c}") for c in ("leaves", "weight")])
        opened = salted_join(ended, ends, "next", "id", measured=ended).select(
            "id", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in ("leaves", "weight")]
        )
        known = known.unionByName(saved(opened))
    return known


def prefix_trie(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one
    row for each distinct prefix of the rebuilt conversations, the empty one included.

    Turns are ordered by number, null first; turns with the same number by role and then by a hash of
    the text, and repeated rows are turns of their own. Null roles and texts count as empty, rows with a
    null conversation id take no part. The first sibling of c is c - c % 5 with the remainder of SQL,
    which has the sign of c. An empty table gives no rows. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b"),
    )
    path, lengths = rebuilt(turns)
    marked = path.select(
        "conv", F.col("depth").cast("long").alias("depth"), "bytes",
        F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64("b", "a", F.lit("b"), "depth").alias("b"),
    )
    prefixes = saved(
        scanned(_laid(marked, ["conv", "depth"]), "conv", ["depth"]).select(
            "conv", "depth", "bytes", F.col("xor_a").alias("a"), F.col("xor_b").alias("b"),
            F.col("a").bitwiseXOR(F.col("xor_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("xor_b")).alias("up_b"),
        )
    )
    grouped = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("bytes", "up_a", "up_b")]
    )
    root = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    named = grouped.unionByName(root.select("*", *[zero.alias(c) for c in ("depth", "a", "b", "bytes", "up_a", "up_b")]))
    nodes = saved(
        named.select(
            _node("depth", "a", "b").alias("node"), F.struct("conv", "depth").alias("id"), "n_convs", "bytes",
            F.when(F.col("depth") > 0, _node(F.col("depth") - 1, "up_a", "up_b")).alias("up"),
        )
    )
    above = nodes.select(F.col("node").alias("up"), F.col("id").alias("parent"))
    tree = saved(salted_join(nodes, above, "up", "id", "left"))
    sums = subtree_sums(tree.select("id", "parent", ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight")))
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    shas = _end_digests(_last(prefixes, lengths))
    return (
        tree.join(sums, "id").join(kids, "id", "left").join(shas, "node", "left")
        .select(
            F.col("id.conv").alias("conv_id"), F.col("id.depth").alias("depth"), F.col("parent.conv").alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.col("weight").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def _last(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, a, b) of the node at which each conversation ends; turnless ones end at the root."""
    deepest = prefixes.groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("end")).select("conv", "end.*")
    bare = lengths.where("length = 0").select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b")])
    return deepest.unionByName(bare)
