"""The prefix trie of conversations by whole-sequence collapse, in DataFrame operations.

Each conversation is one sequence of turns. Identical sequences become one with a weight and the list of
conversations that end there. Sequences that are proper prefixes of others go by an anti-join; what is left are the
leaves, and their prefixes are all nodes. Weighted prefixes are added up per node.

A prefix is named by its length and 128 bits: the exclusive or of one hash per (place, turn). That can be added up in
parts, so long conversations are cut into blocks of places and no task needs a whole one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.tables import drop, keep

BLOCK = 4096  # places of a block
IDS = 50_000  # ids of a block of an end list
NODE = ["depth", "k1", "k2"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, chars): the turns of each conversation from 1 on, with the name and size of what is said.

    Order: turn (null first), role, then a hash of the text; null roles and texts are empty; rows without a
    conversation are left out. Sorted by range, so one conversation may lie in many partitions.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(0), role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"),
        F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"))  # splits repeated rows
    order = [F.col("turn").asc_nulls_first(), "role", "t1", "t2", "row"]
    dealt = keep(said.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    inner = Window.partitionBy("conv_id", "part").orderBy(*order)
    # a conversation that goes on in another partition: at most one row per partition
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("conv_id", "part").count().withColumn(
        "before", F.sum("count").over(before)).where("before > 0").select("conv_id", "part", "before")
    return dealt.withColumn("pos", F.row_number().over(inner)).join(carried, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "chars")


def rebuilt_turns(numbered: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns as conv_id, depth, t1, t2, chars).

    Conversation c takes the first h turns of conversation c - c % `every`, h = crc32(c) % `heads`, and then its
    own turns after its first h.
    """
    def with_head(df):
        return df.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn(
            "base", F.col("conv_id") - F.col("conv_id") % every)

    convs = keep(numbered.select("conv_id").distinct(), "conversations")
    first = numbered.where((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    borrowed = with_head(convs).join(first, "base").where("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "t1", "t2", "chars")
    sizes = first.groupBy("base").agg(F.count("*").alias("size"))
    own = with_head(numbered).where("pos > h").join(sizes, "base", "left").select(
        "conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("depth"),
        "t1", "t2", "chars")
    return convs, borrowed.unionByName(own)


def _running(df: DataFrame, key: str, columns: dict, add, backwards: bool = False) -> DataFrame:
    """Running totals of columns along `depth` per key, in blocks of places that carry their totals on.

    `columns` maps a new name to the column that is added up. Only keys of several blocks have a carry.
    """
    step = 1 if not backwards else -1
    blocks = df.withColumn("block", F.expr(f"depth div {BLOCK}"))
    inner = Window.partitionBy(key, "block").orderBy(F.col("depth") * step).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(key).orderBy(F.col("block") * step).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "block").agg(*(add(c).alias(f"_{n}") for n, c in columns.items()))
    carried = sums.select(key, "block", *(add(f"_{n}").over(outer).alias(f"_{n}") for n in columns),
                          F.count("*").over(outer).alias("_blocks")).where("_blocks > 0").drop("_blocks")
    rows = blocks.select("*", *(add(c).over(inner).alias(n) for n, c in columns.items())).join(
        carried, [key, "block"], "left")
    total = F.bit_xor if add is F.bit_xor else F.sum
    joined = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return rows.select(*df.columns, *(joined(F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in columns))


def end_lists(ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the conv_ids of each key, ascending, joined by commas.

    Lists are built in blocks wherever the range partitions cut them and then hashed block by block, so that the longest list
    needs a block of memory.
    """
    names = [*key, "first", "ids"]

    def build(batches):
        held, last = [], None

        def block():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int64()) for v in last), pa.array([held[0]], pa.int64()),
                 pa.array([",".join(map(str, held))])], names)

        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (own != last or len(held) == IDS):
                    yield block()
                    held = []
                held.append(conv)
                last = own
        if held:
            yield block()

    def digest(batches):
        state, last = None, None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*done), [pa.int64()] * len(key) + [pa.string()])], [*key, "ends_sha256"])

        for batch in batches:
            done = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own == last:
                    state.update(b",")
                else:
                    if state:
                        done.append((*last, state.hexdigest()))
                    state, last = hashlib.sha256(), own
                state.update(ids.encode())
            if done:
                yield rows()
        if state:
            done = [(*last, state.hexdigest())]
            yield rows()

    schema = ", ".join(f"{c} BIGINT" for c in key)
    ids = ends.select(*(F.col(c).cast("bigint") for c in key), "conv_id")
    blocks = ids.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(
        build, f"{schema}, first BIGINT, ids STRING")
    return blocks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{schema}, ends_sha256 STRING")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Per node of the trie of `convs` (conv_id) with `turns` (conv_id, depth from 1 without gaps, t1, t2, chars):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns end at the root. Without conversations there is no node.
    """
    placed = turns.withColumn("z1", F.xxhash64(F.lit(2), "depth", "t1", "t2")).withColumn(
        "z2", F.xxhash64(F.lit(3), "depth", "t1", "t2")).select("conv_id", "depth", "z1", "z2", "chars")
    placed = keep(placed, "placed-turns")
    sizes = placed.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.bit_xor("z1").alias("k1"), F.bit_xor("z2").alias("k2"))
    whole = keep(convs.join(sizes, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "k1", "k2"))), "sequences")
    # identical conversations become one weighted sequence, told by its smallest conversation
    sequences = keep(whole.groupBy("n", "k1", "k2").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("rep")), "weighted-sequences")
    steps = placed.withColumnRenamed("conv_id", "rep").join(sequences.select("rep", "n", "weight"), "rep")
    prefixes = _running(steps, "rep", {"k1": "z1", "k2": "z2"}, F.bit_xor).select(
        "rep", "n", "weight", *NODE, F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "chars")
    none = F.lit(0).cast("bigint")
    roots = sequences.select("rep", "n", "weight", none.cast("int").alias("depth"), none.alias("k1"), none.alias("k2"),
                             F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
                             none.alias("chars"))
    prefixes = keep(prefixes.unionByName(roots), "prefixes")
    proper = prefixes.where("depth < n").select(F.col("depth").alias("n"), "k1", "k2").distinct()
    leaves = sequences.join(proper, ["n", "k1", "k2"], "left_anti").select("rep", F.lit(1).alias("leaf"))
    prefixes_of = keep(prefixes.join(leaves, "rep", "left"), "leaf-prefixes")
    nodes = keep(prefixes_of.groupBy(*NODE, "p1", "p2", "chars").agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("rep"))).alias("owner")), "nodes")
    # every node is counted on the path of one leaf; what lies below on all paths through a node is its subtree
    values = nodes.select(F.col("owner").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("value"))
    paths = prefixes_of.where("leaf = 1").select("rep", *NODE).join(values, ["rep", "depth"], "left").fillna(0, ["value"])
    saved = _running(paths, "rep", {"below": "value"}, F.sum, backwards=True).groupBy(*NODE).agg(
        F.sum("below").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(whole.withColumnRenamed("n", "depth"), NODE)
    return (nodes.join(saved, NODE).join(children, NODE, "left").join(ends, NODE, "left")
            .join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see `prefix_trie`.

    Turns are taken by `turn`, null first; of equal turns by role and a hash of the text, repeated rows are turns of their
    own. A null role or text is empty. Rows without conv_id belong to no conversation and are left out.
    Other columns are ignored; an empty table gives no rows. Turns are equal by 128 bits of role and text.
    """
    numbered = keep(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), "numbered-turns")
    convs, turns = rebuilt_turns(numbered, every, heads)
    return prefix_trie(convs, turns)
