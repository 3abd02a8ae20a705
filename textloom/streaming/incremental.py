"""Incremental runs on Structured Streaming: new files only, bounded per batch, each key exactly once, retries when due.

State lives in the query's checkpoint, by key; a restart goes on from the last committed batch. Sinks write a batch into a folder of its
own, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Attempts a failing source gets, seconds between them.
ATTEMPTS, SPACING = 2, 300
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_files(spark: SparkSession, path: str, schema, most: int = 100) -> DataFrame:
    """A file stream of at most ``most`` new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Runs all that is there batch by batch and stops; gives the number of batches that had rows. A rerun resumes behind the last one."""
    done = []

    def counted(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            done.append(number)
        each(batch, number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(counted).start().awaitTermination()
    return len(set(done))


def append_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that a replay of the same batch leaves unchanged: a batch has its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def once(stream: DataFrame, key: str, at: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key over all batches and restarts.

    Without ``at`` every key ever seen is kept as state. With it (event time) state is kept for ``late`` behind
    the newest row; a key that comes again later than that counts as new."""
    return stream.dropDuplicates([key]) if at is None else stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class _Requests(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.first.get()[0] if self.first.exists() else None
        for frame in rows:
            outcomes = []
            for digest in frame["digest"]:
                if kept is None:
                    kept = digest
                    self.first.update((digest,))
                    outcomes.append("stored")
                else:
                    outcomes.append("replay" if digest == kept else "conflict")
            yield frame.assign(outcome=outcomes)

    def close(self) -> None:
        pass


def by_request(stream: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows with outcome: stored for the first of its key over all batches, replay for others of its digest, conflict for the rest.

    Rows of null key or digest are left out. Of rows of one key in one batch the first to arrive is the first. Needs the RocksDB state store (``ROCKS``)."""
    rows = stream.where(F.col(key).isNotNull() & F.col(digest).isNotNull())
    rows = rows.withColumn("digest", F.col(digest).cast("string"))
    out = T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())])
    return rows.groupBy(key).transformWithStateInPandas(_Requests(), out, "Append", "None")


class _Retries(StatefulProcessor):
    def __init__(self, attempts: int, spacing: int):
        self.attempts, self.spacing = attempts, spacing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "attempts int, due long")

    def _forget(self) -> None:
        if self.failed.exists():
            due = self.failed.get()[1]
            if due is not None:
                self.handle.deleteTimer(due)
            self.failed.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "ok"], kind="stable")  # one source's events of one batch
        for at, ok, transient in zip(events["at"], events["ok"], events["transient"]):
            tried = self.failed.get()[0] if self.failed.exists() else 0
            self._forget()
            if ok:
                continue
            tried += 1
            due = int(pd.Timestamp(at).value // 1_000_000) + 1000 * self.spacing if transient and tried < self.attempts else None
            if due is not None:
                self.handle.registerTimer(due)
            self.failed.update((tried, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        tried = self.failed.get()[0]
        self.failed.update((tried, None))
        yield pd.DataFrame({"source": [key[0]], "attempts": [tried], "due": [pd.Timestamp(due, unit="ms")]})

    def close(self) -> None:
        pass


def retries(events: DataFrame, source: str, at: str, ok: str, transient: str, attempts: int = ATTEMPTS, spacing: int = SPACING, late: str = "0 seconds") -> DataFrame:
    """source, attempts, due: the moments at which failed sources are to be tried again.

    events: a stream of attempts. A transient failure sets a timer ``spacing`` seconds behind it, up to ``attempts`` attempts; a success forgets the source, a new failure sets the timer anew.
    A row comes out once event time (the newest event less ``late``) has passed its due time. Session time zone UTC is assumed; needs ``ROCKS``."""
    rows = events.where(F.col(source).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(source).alias("source"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"), F.coalesce(F.col(transient), F.lit(False)).alias("transient"))
    out = T.StructType([rows.schema["source"], T.StructField("attempts", T.IntegerType()), T.StructField("due", T.TimestampType())])
    return rows.withWatermark("at", late).groupBy("source").transformWithStateInPandas(_Retries(attempts, spacing), out, "Append", "EventTime")


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts a window and kind, late rows beyond ``late`` dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
