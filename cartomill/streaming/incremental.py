"""Incremental maintenance of the tables: transactions, scans that resume, locks and progress."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import change_classify, upsert


class Folder:
    """Files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._place(f"{self.path}/{name}")

    def names(self) -> list[str]:
        place = self._place(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name. The store sees to it that one of two writers wins."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self.at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class TableSet:
    """Tables that change together. A manifest names the folder of each table; a transaction writes new folders and then the
    next manifest, so that readers see all of it or nothing, and of two writers the second fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def version(self) -> int:
        return max((int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-")), default=0)

    def places(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        return json.loads(self.folder.text(f"manifest-{version}.json")) if version else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{self.places()[name]}")

    @contextmanager
    def transaction(self) -> Iterator["Transaction"]:
        """Commits at the end of the block; an error inside leaves the tables as they were."""
        own = Transaction(self, self.version())
        try:
            yield own
            if own.staged and not self.folder.create(f"manifest-{own.version + 1}.json", json.dumps(self.places(own.version) | own.staged)):
                raise RuntimeError("the tables have changed since the transaction began")
        except BaseException:
            for place in own.staged.values():
                self.folder.delete(place)
            raise


class Transaction:
    def __init__(self, tables: TableSet, version: int):
        self.tables, self.version, self.staged = tables, version, {}

    def write(self, name: str, df: DataFrame) -> None:
        place = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.tables.folder.path}/{place}")
        if old := self.staged.get(name):
            self.tables.folder.delete(old)
        self.staged[name] = place


def scan_incremental(old: DataFrame, new: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files table after a scan, and the paths that must be read again. old, new: path, hash and more."""
    status = change_classify(old, new, symbols)
    changed = status.where("status IN ('new', 'changed', 'incomplete')").select("path")
    kept = old.join(status.where("status = 'deleted'").select("path"), "path", "left_anti")
    return upsert(kept, new.join(changed, "path", "left_semi").select(*old.columns), "path"), changed


def scan_full(files: DataFrame, read: Callable[[DataFrame], DataFrame], path: str, batches: int = 8, done: Callable[[int], None] | None = None) -> DataFrame:
    """read(files) of all files (path and more), a batch at a time; a scan that was broken off goes on with the batches that
    are not there yet. Files are dealt to batches by their path. done(batch) is told of each batch that is finished."""
    folder = Folder(files.sparkSession, path)
    there = set(folder.names())
    for k in range(batches):
        if f"done-{k}" not in there:
            folder.delete(f"batch-{k}")
            read(files.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == k)).write.parquet(f"{folder.path}/batch-{k}")
            folder.create(f"done-{k}", "")
            if done:
                done(k)
    parts = [files.sparkSession.read.parquet(f"{folder.path}/batch-{k}") for k in range(batches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_stream(spark: SparkSession, folder: str, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Reads files as they appear in a folder; each batch goes to merge(batch, number), once after a restart too."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", "modificationTime", "length", F.md5("content").alias("hash"), F.col("content").cast("string").alias("text"))
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "event string, batch long, rows long"


def progress_events(query: StreamingQuery) -> DataFrame:
    """PROGRESS of a stream's batches with rows, in order, and of its end, once it has ended."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    batches = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    rows = [("scan-progress", b, n) for b, n in batches]
    if not query.isActive:
        rows.append(("scan-failed" if query.exception() else "scan-complete", len(batches), sum(n for _, n in batches)))
    return spark.createDataFrame(rows, PROGRESS)


class ScanLock:
    """One scan of a folder at a time, in any store: a file that one writer can create. A lock that has not been refreshed
    for `lease` seconds is taken over: of all that try, one can rename it away."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 600.0, clock: Callable[[], float] = time.time):
        self.folder, self.lease, self.clock, self.own = Folder(spark, path), lease, clock, uuid.uuid4().hex

    def __enter__(self) -> "ScanLock":
        if self._created():
            return self
        if self.clock() - self._held()["at"] > self.lease and self.folder.fs.rename(self.folder.at("scan.lock"), self.folder.at(f"stale-{self.own}")):
            self.folder.delete(f"stale-{self.own}")
            if self._created():
                return self
        raise RuntimeError(f"another scan holds {self.folder.path}")

    def _created(self) -> bool:
        return self.folder.create("scan.lock", json.dumps({"owner": self.own, "at": self.clock()}))

    def _held(self) -> dict:
        try:
            return json.loads(self.folder.text("scan.lock"))
        except Exception:  # being written, or just gone
            return {"owner": None, "at": self.clock()}

    def refresh(self) -> None:
        if self._held()["owner"] != self.own:
            raise RuntimeError("the lock was taken over")
        self.folder.delete("scan.lock")
        self._created()

    def __exit__(self, *_) -> None:
        if self._held()["owner"] == self.own:
            self.folder.delete("scan.lock")
