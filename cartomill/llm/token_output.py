"""Token ids as Parquet list columns.

File format: a folder of Parquet files in ascending doc_id order. Columns doc_id, part (the file's place in the order),
start_in_part (ids of the part's documents before this one), n_tokens and ids (array<int>). Ids are dictionary-encoded,
falling back to delta bit packing; small row groups, short pages and the column index let a reader take single
documents, or the metadata without the ids.

The order comes from a range partitioning: Spark samples the keys, a shuffle brings each range of doc_ids to one task,
and that task sorts it. A doc_id that many rows share is spread by the rows' places in the input.

Edge cases: a null or empty text is the end id alone; rows that repeat are written each; null doc_ids come first, rows
of one doc_id in the order of their places in the input; a very long text is one row, whole; no documents give an empty
table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, shared_dir, text_bytes
from .tokens import encoder

END_ID = 2
#: Bytes of a row group and rows of a page.
ROW_GROUP = 8 << 20
PAGE_ROWS = 2_000

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, vocabulary: str, path: str, kind: str = "byte", end_id: int = END_ID) -> None:
    """Writes the documents' ids in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary, kind), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.packed(text_bytes(batch["text"]))]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // enc.dtype.itemsize
            flat = np.frombuffer(b"".join(ids), dtype=enc.dtype).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(at + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    # the row's place in the input spreads a doc_id that many rows share, copies of one row too
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = docs.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    options = {
        "compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true",
        "parquet.writer.version": "PARQUET_2_0", "parquet.dictionary.page.size": 1 << 20,
    }
    map_arrow(ordered, encode, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back; start counts the ids of all documents before it.

    One total for each part goes to the driver.
    """
    totals = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([n for _, n in totals])
    offsets = {part: int(end - n) for (part, n), end in zip(totals, ends)}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            base = np.fromiter((offsets[p] for p in batch["part"].to_pylist()), dtype=np.int64, count=len(sums))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base + batch["start_in_part"].to_numpy()), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tokens.select("doc_id", "part", "start_in_part", "ids"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_digests(read_tokens(spark, path))
