"""Cuts the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and runs in one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cartomill-"))
    return sc.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder; it outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "snappy").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that cut() made, once what is derived from them is written."""
    for df in tables:
        deleted(df.sparkSession, df.written_at)


class Rounds:
    """The rows that a loop finds, round after round: one folder of the shared file system with a part for each round, so
    that a round's plan does not grow with those before it."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.n = spark, schema, 0
        self.path = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> int:
        """Writes one more round; how many rows it has."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "snappy").parquet(f"{self.path}/round={self.n}")
        self.n += 1
        return seen.get["n"]

    def last(self) -> DataFrame:
        return self.of(self.n - 1)

    def of(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={k}")

    def all(self) -> DataFrame:
        """The rows of all rounds, with the round's number."""
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)


def bucketed(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in as many buckets as the session has shuffle partitions: joins on `by` move only their other side."""
    spark, name = df.sparkSession, f"cartomill_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    with shuffles_deleted(spark):
        df.repartition(n, *by).write.format("parquet").option("compression", "snappy").bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_at, out.written_as = path, name
    return out


def forgotten(df: DataFrame) -> None:
    """Deletes a table that bucketed() made."""
    df.sparkSession.sql(f"DROP TABLE {df.written_as}")
    deleted(df.sparkSession, df.written_at)


def spread(df: DataFrame, rows: int = 5_000) -> DataFrame:
    """df dealt evenly to tasks of so many rows, and to all cores: for small rows that each cost long work. A table's files
    and row groups say how much there is to read, not how much to do."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a column of its rows' places, from 0, in a total order. A range sort deals the rows to tasks; what meets on
    the driver is one count for each of them."""
    place = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumn("__place", place))
    sizes = rows.groupBy(F.shiftright("__place", 33).alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets += [F.lit(r["__part"]), F.lit(before)]
        before += r["n"]
    start = F.element_at(F.create_map(*offsets), F.shiftright("__place", 33)) if offsets else F.lit(0)
    out = rows.withColumn(name, start + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place")
    out.written_at = rows.written_at
    return out
