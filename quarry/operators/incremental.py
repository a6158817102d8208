"""Which documents have to be indexed, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The smaller the number, the earlier.
CREATED, MODIFIED, SCANNED = 3, 5, 8


def candidates(found: DataFrame, registry: DataFrame, path: str = "file_path", stamp: str = "modified_time") -> DataFrame:
    """Files that the registry doesn't hold with the same path and time. Neither side needs the files' contents."""
    return found.join(registry.select(path, stamp), [path, stamp], "left_anti").select(found.columns)


def changed(found: DataFrame, registry: DataFrame, path: str = "file_path", digest: str = "file_hash") -> DataFrame:
    """Files whose content the registry doesn't hold under their path."""
    return found.join(registry.select(path, digest), [path, digest], "left_anti").select(found.columns)


def unchanged(found: DataFrame, registry: DataFrame, path: str = "file_path", digest: str = "file_hash") -> DataFrame:
    return found.join(registry.select(path, digest), [path, digest], "left_semi").select(found.columns)


def vanished(found: DataFrame, registry: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths in the registry that aren't on disk any more."""
    return registry.select(path).join(found.select(path), path, "left_anti")


def newest(found: DataFrame, most: int, stamp: str = "modified_time", path: str = "file_path") -> DataFrame:
    """The latest files, for a first scan that is limited; ties by path."""
    return found.orderBy(F.desc(stamp), path).limit(most)


def queued(requests: DataFrame, path: str = "file_path", priority: str = "priority", done: DataFrame | None = None) -> DataFrame:
    """One request a path, that with the smallest priority, in the order of priority, then path.

    done: (path) of what is being processed or has been; those drop out.
    """
    if done is not None:
        requests = requests.join(done.select(path), path, "left_anti")
    return requests.groupBy(path).agg(F.min(priority).alias(priority)).orderBy(priority, path)


def queue_stats(rows: DataFrame, status: str = "status") -> DataFrame:
    """The number of rows in each state, those without rows included."""
    states = ("queued", "processing", "processed", "failed")
    return rows.agg(*(F.count_if(F.col(status) == s).alias(s) for s in states))


def with_priority(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Events routed: a deletion at once, without priority; a creation before a change before what a scan found."""
    return events.withColumn("priority", F.when(F.col(kind) == "create", CREATED).when(F.col(kind) == "modify", MODIFIED).when(F.col(kind) == "scan", SCANNED))


def decomposed(events: DataFrame, supported: Column) -> DataFrame:
    """Events (ts, kind, path, dest) with each move as a deletion and a creation.

    supported tells of `path` whether it is indexed; a move whose dest isn't gives nothing. Creations and changes of
    other files drop out, deletions stay.
    """
    step = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("path"))
    moves = F.array(step("delete", "path"), step("create", "dest"))
    kept = F.array(F.struct(F.col("kind"), F.col("path")))
    steps = events.select("ts", F.col("kind").alias("was"), F.posexplode(F.when(F.col("kind") == "move", moves).otherwise(kept)).alias("step", "s"), F.col("dest").alias("to"))
    flat = steps.select("ts", "was", "step", "s.kind", "s.path", "to")
    subject = flat.withColumn("own", F.col("path")).withColumn("path", F.coalesce("to", "path"))
    fits = F.when(F.col("was") == "delete", True).otherwise(F.coalesce(supported, F.lit(False)))
    return subject.where(fits).select("ts", "kind", F.col("own").alias("path"), "step")


def debounced(events: DataFrame, seconds: float, key: list[str], ts: str = "ts") -> DataFrame:
    """(key, ts) of the events that pass a leading-edge debounce: those at least so long after the last that passed.

    Events are gathered by key: a key's events have to fit into a task. Repeated times count once.
    """
    from ..functions.folds import leading_edge

    timed = F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(ts).alias("ts"))
    gathered = events.where(F.col(ts).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_set(timed)).alias("times"))
    passed = leading_edge(F.col("times"), seconds * 1_000_000, lambda e: e["at"])
    return gathered.select(*key, F.explode(passed).alias("e")).select(*key, F.col("e.ts").alias(ts))


def ranked_by(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with their rank."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
