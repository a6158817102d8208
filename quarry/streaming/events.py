"""File events as streams: where they come from, which pass a debounce, what is done about them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import decomposed, queued, with_priority
from ..schema import EVENT
from ..sources.files import is_indexed

DEBOUNCE_SECONDS = 2.0
#: A key that is quiet for so long is forgotten.
EVICT_SECONDS = 300


def event_files(spark: SparkSession, folder: str, source: str = "parquet") -> DataFrame:
    """A stream of events (ts, kind, path, dest) from a folder that a watcher appends files to."""
    return spark.readStream.schema(EVENT).format(source).load(folder)


def snapshot_events(found: DataFrame, registry: DataFrame, deletions: bool = False) -> DataFrame:
    """Events that lead from what the registry (file_path, modified_time) holds to what is found on disk.

    Deletions while nobody watched are only told of on request.
    """
    both = found.select("file_path", F.col("modified_time").alias("now")).join(registry.select("file_path", F.col("modified_time").alias("then")), "file_path", "full")
    kind = F.when(F.col("then").isNull(), "create").when(F.col("now").isNull(), "delete").when(F.col("now") != F.col("then"), "modify")
    events = both.select(F.current_timestamp().alias("ts"), kind.alias("kind"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("dest")).where("kind is not null")
    return events if deletions else events.where("kind != 'delete'")


def debounced_stream(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, evict: int = EVICT_SECONDS) -> DataFrame:
    """Of a stream of (ts, kind, path) the events that pass a leading-edge debounce, by kind and path.

    The first passes, and each at least so long after the last that passed; one that doesn't pass delays nothing. Rows
    of one micro-batch are taken in the order of time; a key's last time is state, dropped after `evict` quiet seconds.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([f["ts"] for f in frames]).dropna().sort_values()
        last = state.get[0] if state.exists else None
        passed = []
        for t in times:
            at = t.timestamp()
            if last is None or at - last >= seconds:
                passed.append(t)
                last = at
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(evict * 1000)
        if passed:
            yield pd.DataFrame({"ts": passed, "kind": key[0], "path": key[1]})

    keyed = events.select("ts", "kind", "path").groupBy("kind", "path")
    return keyed.applyInPandasWithState(run, "ts timestamp, kind string, path string", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_moves(events: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """(ts, kind, path, step) of events, a move as a deletion and a creation; other files' events drop out."""
    return decomposed(events, is_indexed(F.col("path"), list(extensions)))


def apply_batch(delete: Callable[[DataFrame], object], index: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch does with events (ts, kind, path): of each path the last event counts.

    Deletions go to delete(file_path); the others to index(file_path, priority), one request a path. Both have to
    bear a repetition, as a batch can come again after a failure.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("kind", F.struct("ts", F.col("kind") != "delete")).alias("kind"))
        last = with_priority(last).withColumnRenamed("path", "file_path").persist()
        try:
            delete(last.where("kind = 'delete'").select("file_path"))
            index(queued(last.where("kind != 'delete'").select("file_path", "priority")))
        finally:
            last.unpersist()

    return run


def failures(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(file_path, error, failed_at): what a later run can try again."""
    return spark.createDataFrame(rows, "file_path string, error string").withColumn("failed_at", F.current_timestamp())
