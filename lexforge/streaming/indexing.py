"""Indexing as books arrive: a queue of files, resumable, and idempotent chapter by chapter; and streams of events.

The queue is a folder that Structured Streaming reads; what was done is in the stream's checkpoint, and each batch also
leaves out chapters that are already there, so a batch that runs twice adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class Progress:
    """What a run did so far, batch by batch: the latest of each book is what a listener shows."""

    batches: list[dict] = field(default_factory=list)

    def latest(self) -> dict:
        return {k: v for b in self.batches for k, v in b["books"].items()}


class IndexQueue:
    """Books that wait to be indexed, first come first served, each once."""

    def __init__(self) -> None:
        self.waiting: list[int] = []
        self.now: int | None = None
        self.paused = self.cancelled = False

    def push(self, *books: int) -> int:
        """Adds books that are neither waiting nor being indexed; how many were added. Adding starts a paused queue again."""
        new = [b for b in dict.fromkeys(books) if b not in self.waiting and b != self.now]
        self.waiting += new
        if new:
            self.paused = False
        return len(new)

    def next(self) -> int | None:
        if self.paused or not self.waiting:
            self.now = None
        else:
            self.now, self.cancelled = self.waiting.pop(0), False
        return self.now

    def done(self) -> None:
        self.now = None

    def stop(self) -> None:
        """Drops what waits, and asks what runs to end."""
        self.waiting.clear()
        self.cancelled = self.now is not None
        self.paused = True

    def forget(self, book: int) -> None:
        """A book that was removed."""
        self.waiting = [b for b in self.waiting if b != book]
        if self.now == book:
            self.cancelled = True

    def busy(self) -> bool:
        return self.now is not None or bool(self.waiting) and not self.paused


def new_rows(incoming: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys are not yet in the table at ``path`` (which may not exist), each once."""
    try:
        have = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return incoming.dropDuplicates(keys)
    return incoming.dropDuplicates(keys).join(have, keys, "left_anti")


def index_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], keys: list[str], progress: Progress | None = None, files_at_once: int = 1) -> StreamingQuery:
    """Index the files that are in ``source`` and end; run again, it takes those that came since. ``make`` turns a batch of new
    rows into the rows to add. ``keys`` tell chapters apart."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        new = new_rows(rows, session, target, keys)
        made = make(new)
        made.write.mode("append").parquet(target)
        if progress is not None:
            per = session.read.parquet(target).groupBy("book_id").agg(F.countDistinct(*keys).alias("n")).collect()  # a row for each book
            progress.batches.append({"batch": number, "books": {r["book_id"]: r["n"] for r in per}})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_positions(events: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """The last event of each key, of a stream or a table."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("e")).select(key, "e.*")


def save_positions(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "book_id", time: str = "ts") -> StreamingQuery:
    """Keeps the latest event of each key in ``target``: each batch is merged into a new version beside the old one, and a
    batch that runs twice gives the same. Of events at one time the one counts whose other columns, in order of their
    names, are largest. Two versions are kept, so whoever reads the one before is not cut off."""
    from lexforge.operators.mutations import latest
    from lexforge.sources.snapshot import Library

    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        library = Library(rows.sparkSession, target)
        both = rows if library.current() is None else rows.unionByName(library.read("positions"))
        library.write({"positions": latest(both, [key], [time, *sorted(c for c in both.columns if c not in (key, time))])})
        library.prune()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Events of a key that follow one another within ``gap`` as one, the last of them: a session window, with a watermark."""
    rest = [c for c in events.columns if c not in (key, time)]
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.max(F.struct(time, *rest)).alias("e"), F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.col("w.start").alias("session_start"), "n_events", "e.*")


def tumbling_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their values by window and type; of a stream, windows are told once the watermark has passed them."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    rows = marked.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
