"""Token ids in ORC files: sorted by document, run-length encoded, indexed, with Bloom filters on the ids of documents.

ORC keeps integers run-length encoded inside stripes; each stripe carries minima,
maxima, a row index and a Bloom filter of `doc_id`. Readers split files at stripes
and skip those that cannot hold what they look for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.llm.chunked import encoder, slices
from quotelake.session import scratch_path

SCHEMA = "block INT, doc_id BIGINT, block_start BIGINT, n_tokens BIGINT, ids ARRAY<INT>"
STRIPE_BYTES = 16 << 20
ROW_INDEX = 1000  # rows per index entry
BLOOM_FPP = 0.01


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending order of the document ids.

    A null text counts as empty (its row holds the end id alone); rows without a document
    id come first; rows of one id lie side by side in the order of a hash of their texts. Other columns
    are ignored, an empty table gives an empty store. Texts are range-partitioned before
    they are encoded, so that finding the ranges doesn't encode anything.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        block, start, tail = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(text):
                parts = [x + tail for x in encoder(tokenizer).encode(text[a:b])]
                counts = np.array([len(x) // 4 for x in parts], np.int64)
                ends = np.cumsum(counts)
                values = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, block, np.int32)), ids.slice(a, b - a), pa.array(start + ends - counts),
                     pa.array(counts), lists], ["block", "doc_id", "block_start", "n_tokens", "ids"])
                start += int(ends[-1])

    (ordered.mapInArrow(encode, SCHEMA).write.format("orc")
     .option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true")
     .option("orc.row.index.stride", ROW_INDEX).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", BLOOM_FPP).save(path))


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with `doc_ids`, only stripes whose index and Bloom filter may hold them are read."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def block_starts(rows: DataFrame) -> DataFrame:
    """(block, base): ids before each block. One row per written file, from two narrow columns."""
    sums = rows.groupBy("block").agg(F.max(F.col("block_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def token_digests(rows: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())],
                ["block", "doc_id", "block_start", "n_tokens", "ids_crc32"])

    small = rows.mapInArrow(digest, "block INT, doc_id BIGINT, block_start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    return small.join(block_starts(rows), "block").select(
        "doc_id", (F.col("base") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store under the shared folder and return the digests of what is read back from it."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, tokenizer, end_id)
    return token_digests(read_token_store(docs.sparkSession, path))
