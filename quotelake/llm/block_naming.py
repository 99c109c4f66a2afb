"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed size. Equal blocks, and only they, get the
same integer name, by sorting the distinct ones. Then adjacent names are paired and
the pairs are named in the same way, until each text is down to one name. Texts of equal
length are equal exactly if their last names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.tables import ascii_lower, keep

BLOCK_BYTES = 8192
SEEDS = 8  # attempts at distinct keys before giving up; two texts of 128 equal bits are needed for one to fail


def _blocks(text, size: int):
    """The bytes of a text in blocks; an empty text has one empty block.

    The one-element array hands the bytes to the inner function as they are; taken from the row they'd be copied for
    every block.
    """
    def cut(raw):
        last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))

    return F.element_at(F.transform(F.array(text.cast("binary")), cut), 1)


def _key(block, seed: int):
    """128 bits under which equal blocks meet. `name_blocks` checks that different ones don't."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def _integers(distinct: DataFrame, by: list) -> DataFrame:
    """One integer per row of a table without repeated rows: its place in the sorted partitions."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_blocks(texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the keys of their blocks, names by key) of a table with the columns doc_id and text.

    Each content travels once, after its repeats in a task are merged. Occurrences carry
    the key only; a key that two contents share would show as two names, and other keys are drawn.
    """
    for seed in range(SEEDS):
        blocks = texts.select(F.explode(_blocks(F.col("text"), size)).alias("block"))
        contents = blocks.select(_key(F.col("block"), seed).alias("key"), "block").select("key.a", "key.b", "block")
        names = keep(_integers(contents.distinct(), ["a", "b", "block"]).select("a", "b", "name"), "block-names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("contents keep sharing keys")
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform(_blocks(F.col("text"), size), lambda b: _key(b, seed)).alias("keys"))
    return keep(rows, "block-keys"), names


def text_identities(docs: DataFrame, size: int = BLOCK_BYTES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_sha256, n_bytes, name): rows have equal texts exactly if n_bytes and name are equal."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows, names = name_blocks(texts, size)
    named = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "key")).select(
        "row", "n", "at", F.col("key.a").alias("a"), F.col("key.b").alias("b")).join(names, ["a", "b"])
    level = keep(named.select("row", "n", "at", "name"), "names")  # n: names left of the row
    identities = level.where("n = 1").select("row", "name")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    while longest > 1:
        # neighbours are paired, an odd last name with nothing; texts down to one name have left
        pairs = keep(level.where("n > 1").groupBy("row", "n", F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        fresh = keep(_integers(pairs.select("left", "right").distinct(), ["left", "right"]), "pair-names")
        level = keep(pairs.join(fresh, ["left", "right"]).select(
            "row", F.expr("(n + 1) div 2").cast("int").alias("n"), "at", "name"), "names")
        identities = identities.unionByName(level.where("n = 1").select("row", "name"))
        longest = -(-longest // 2)
    return rows.drop("keys").join(identities, "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row of the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. A null
    doc_id ranks below all others; of repeated rows with the largest doc_id exactly one stays. Other columns
    are ignored; an empty table gives no rows. Counts are combined before they move, and big groups
    only meet in a join that Spark can split.
    """
    rows = keep(text_identities(docs, size, id_col, text_col), "identities")
    by_id = rows.groupBy("n_bytes", "name", "doc_id").agg(F.count("*").alias("n"), F.max("row").alias("row"))
    groups = by_id.groupBy("n_bytes", "name").agg(
        F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    stays = by_id.select("n_bytes", "name", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    best = keep(groups.join(stays, (groups.n_bytes == stays.n_bytes) & (groups.name == stays.name)
                            & groups.keep_id.eqNullSafe(stays.keep_id)).select(
        groups.n_bytes, groups.name, groups.keep_id, "group_size", "keep_row"), "groups")
    return rows.join(best, ["n_bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts that of the largest id (null below all); of repeated rows one.

    A null text counts as empty, so of all null and empty texts one row stays; an empty table gives no rows. Further
    columns may have any name; of rows that share id and text but differ in them an arbitrary one stays.
    """
    def key(doc_id, sha):
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), sha)

    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    stays = exact_duplicates(docs, size, id_col, text_col).where("kept").select(
        key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    row = docs.select(F.struct(*docs.columns).alias("row"), key(F.col(id_col).cast("bigint"), sha).alias("key"))
    first = Window.partitionBy("key").orderBy("key")  # as the join has dealt and sorted the rows
    kept = row.join(stays, "key", "left_semi").withColumn("nth", F.row_number().over(first))
    return kept.where("nth = 1").select("row.*")
