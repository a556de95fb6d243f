"""Structured Streaming: watched folders, debounced events, the journal's fold, the incremental cache."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.library import journal_state
from ..sources.documents import JOURNAL_LINE


def watch(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New documents of a folder as they appear; rewrites in place are not seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).json(folder)


def debounced(events: DataFrame, ts: str = "ts", quiet: str = "150 milliseconds", late: str = "1 second") -> DataFrame:
    """One row for every burst: a session ends when nothing came for the quiet time."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(ts, quiet)).agg(F.count(F.lit(1)).alias("events")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", JOURNAL_LINE).alias("j")).select("j.*").where("original_path is not null")


def journal_fold(events: DataFrame) -> DataFrame:
    """Last move of every path of a session and whether it was taken back; update mode on a stream."""
    return journal_state(events)


def upsert(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's last row per key to a Parquet table; readers take the last row written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
        last.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Watcher:
    """Keeps a query over a folder running when the folder is replaced or the query fails.

    start() makes a query that goes on from its checkpoint, so files that were seen stay seen.
    """

    def __init__(self, folder: str, start: Callable[[], StreamingQuery]):
        self.folder, self._start, self.restarts = folder, start, 0
        self._seen, self.query = self._identity(), start()

    def _identity(self) -> tuple[int, int] | None:
        try:
            found = os.stat(self.folder)
        except FileNotFoundError:
            return None
        return found.st_dev, found.st_ino

    def check(self) -> bool:
        """Open the folder anew if another one has its name or the query failed; whether it did. A folder that is gone is waited for."""
        now = self._identity()
        if now is None or (now == self._seen and (self.query.isActive or self.query.exception() is None)):
            return False
        self.query.stop()
        self._seen, self.query = now, self._start()
        self.restarts += 1
        return True

    def stop(self) -> None:
        self.query.stop()


class Progress(StreamingQueryListener):
    """Counts of all queries, kept for whoever asks; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self._lock, self._told = threading.Lock(), {"started": 0, "ended": 0, "batches": 0, "rows": 0}

    def _add(self, **more: int) -> None:
        with self._lock:
            for k, n in more.items():
                self._told[k] += n

    def snapshot(self) -> dict[str, int]:
        with self._lock:
            return dict(self._told)

    def onQueryStarted(self, event) -> None:
        self._add(started=1)

    def onQueryProgress(self, event) -> None:
        self._add(batches=1, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(ended=1)
