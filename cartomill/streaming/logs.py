"""Logs of calls: tails, trims and rate limits, as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CALL_LOG = "ts timestamp, tool string, args string, duration_ms double, ok boolean"
WINDOW_MS, MOST = 60_000, 10


def toolcall_log(spark: SparkSession, path: str, last: int = 100) -> DataFrame:
    """The last calls of a log of JSON lines, newest first; lines that are not JSON are left out."""
    return spark.read.schema(CALL_LOG).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("ts")).limit(last)


def toolcall_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream: each file that appears in the folder is read once."""
    return spark.readStream.schema(CALL_LOG).json(folder)


def log_trim(df: DataFrame, *newest_first, keep: int = 500) -> DataFrame:
    return df.orderBy(*newest_first).limit(keep)


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", most: int = MOST, window_ms: int = WINDOW_MS) -> DataFrame:
    """events with `in_window`, how many of the key's the window up to each holds, and `over`, whether that is more than
    allowed. Every event counts, also those over the limit; rate_limit_stream() counts only those let through."""
    at = F.col(ts).cast("timestamp").cast("double") * 1000
    w = Window.partitionBy(key).orderBy(F.round(at).cast("long")).rangeBetween(-(window_ms - 1), 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > most)


def let_through(times: list[float], held: list[float], most: int = MOST, window_ms: int = WINDOW_MS) -> tuple[list[bool], list[float]]:
    """Which of some ascending times (ms) pass, given those that passed before; and those that still count."""
    held, out = list(held), []
    for t in times:
        held = [h for h in held if h > t - window_ms]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def _limit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get[0]) if state.exists else []
    for frame in frames:
        frame = frame.sort_values("ts")
        passed, held = let_through([t.timestamp() * 1000 for t in frame["ts"]], held)
        yield pd.DataFrame({"key": str(key[0]), "ts": frame["ts"], "passed": passed})
    state.update((held,))


def rate_limit_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key, ts, passed of a stream of events: at most MOST of a key pass in any WINDOW_MS."""
    return events.groupBy(F.col(key)).applyInPandasWithState(_limit, "key string, ts timestamp, passed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limit_exact(events: DataFrame, key: str = "user_id") -> DataFrame:
    """rate_limit_stream() over a batch. Keys are independent, so groups are one key each."""
    from ..functions.ship import ship

    ship(events.sparkSession)

    def one(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        from cartomill.streaming.logs import let_through as f

        frame = frame.sort_values(["ts", "event_id"])
        return pd.DataFrame({"event_id": frame["event_id"], "passed": f([t.timestamp() * 1000 for t in frame["ts"]], [])[0]})

    return events.groupBy(key).applyInPandas(one, "event_id long, passed boolean")
