"""Packing by concatenate and cut.

Every document becomes its ids and an end id. Pass one encodes the documents where they lie and writes, with each
document, its place in its partition; only one total for each partition goes to the driver. The prefix sums of those
totals are the partitions' global offsets. Pass two adds the two and cuts at multiples of the sequence length; a
document over a boundary gives one boundary record for each sequence it touches. Nothing is shuffled or sorted.

Edge cases: a null or empty text is the end id alone; no documents give no pieces; repeated rows and equal doc_ids are
packed each, in no particular order among them; a very long text is encoded whole and cut like any other; other columns,
of whatever name, are ignored. The order of the documents in the sequences is that of the written partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, text_bytes, written
from .tokens import encoder

SEQUENCE = 2048
END_ID = 1

ENCODED = "doc_id long, part int, start_in_part long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded_documents(docs: DataFrame, vocabulary: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, part, start_in_part, doc_tokens, ids (packed little-endian; two bytes each where the vocabulary allows)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary, kind), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.packed(text_bytes(batch["text"]))]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // enc.dtype.itemsize
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, type=pa.binary())],
                names=["doc_id", "part", "start_in_part", "doc_tokens", "ids"],
            )
            at = int(ends[-1]) if len(ends) else at

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), encode, ENCODED)


def partition_offsets(encoded: DataFrame) -> dict[int, int]:
    """The global offset of each partition; one number for each, so its size is that of the task list."""
    totals = sorted(encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    ends = np.cumsum([n for _, n in totals])
    return {part: int(end - n) for (part, n), end in zip(totals, ends)}


def pieces(encoded: DataFrame, id_bytes: int, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the ids themselves, packed as they came."""
    offsets = partition_offsets(encoded)
    dtype = np.dtype("<u2" if id_bytes == 2 else "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, part, start, n, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "part", "start_in_part", "doc_tokens", "ids"))):
                ids, at, done = np.frombuffer(raw, dtype=dtype), offsets[part] + start, 0
                while done < n:
                    sequence_id, offset = divmod(at + done, sequence)
                    length = min(n - done, sequence - offset)
                    own = ids[done : done + length]
                    rows.append((doc_id, done, length, zlib.crc32(own.astype("<u4").tobytes()), n, sequence_id, offset) + ((own.tobytes(),) if with_ids else ()))
                    done += length
            columns = list(zip(*rows)) or [()] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns[:7]] + [pa.array(c, type=pa.binary()) for c in columns[7:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    return map_arrow(encoded, cut, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of at most `sequence` ids; only the last sequence has padding."""
    encoded = written(encoded_documents(docs, vocabulary, kind, end_id), "packing")
    return pieces(encoded, encoder(vocabulary, kind).dtype.itemsize, sequence, with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
