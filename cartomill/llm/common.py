"""Helpers that the text operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir
from ..functions.ship import ship

#: Bytes of text in one Arrow batch, so that a batch of very long documents stays small.
BATCH_BYTES = 8 << 20
#: Bytes of text that the vectorised passes work on at once.
CHUNK_BYTES = 1 << 20

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder. It is computed once and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def deleted(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared file system."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bucketed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """written(), in as many buckets as the session has shuffle partitions. Each task writes its own files, nothing is
    shuffled, and a join on `by` moves only its other side."""
    spark = df.sparkSession
    table = f"cartomill_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).bucketBy(n, *by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.written_at, out.listed_as = path, table
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables that written() and bucketed() made, once all that is derived from them is written too."""
    for df in tables:
        if getattr(df, "listed_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.listed_as}")
        deleted(df.sparkSession, df.written_at)


def shuffles_collected(spark: SparkSession) -> None:
    """Lets the driver's JVM drop the plans that nothing refers to any more; Spark then removes their shuffle files, which
    else stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes; a smaller limit that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; of a null text, nothing."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of about `most` in all; a larger item has a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_digest(column: Column | str = "text") -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def digests(data: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of the BLAKE2b of each range of data, as two columns of signed numbers: what decides that bytes are equal."""
    view, make = memoryview(data), hashlib.blake2b
    raw = b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


class PrefixHash:
    """Hashes of all substrings of a byte string at two array lookups each.

    With random odd `base` and a random 64-bit value for each byte, h(a, b) = sum of value(s[i]) * base**(i - a).
    """

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    _up = np.ones(1, dtype=np.uint64)
    _down = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        if len(PrefixHash._up) <= n:
            size = 1 << int(n + 1).bit_length()
            PrefixHash._up = _powers(self.BASE, size)
            PrefixHash._down = _powers(self.INVERSE, size)
        values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * PrefixHash._up[:n], out=self.sums[1:])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * PrefixHash._down[a] + (b - a).astype(np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: each output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least of values[i : i + width] by its upper bits; among equals the first.

    Blocks of `width` are scanned from both sides, so the work does not grow with the width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low = np.uint64((1 << 32) - 1)  # whatever the length, so that equal windows agree
    keys = np.full(len(values) + -len(values) % width, ~np.uint64(0))
    keys[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    blocks = keys.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & low).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]
