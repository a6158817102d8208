"""A store of catalog and chunks over plain Parquet, with atomic commits, for any number of writers.

Every change is one numbered version: its rows, or the paths that it deletes, are written to a folder of their own, and
a commit file that appears last makes them count. The file's name is the number alone, and it appears with its content
or not at all, so of two writers that want one number one wins and the other takes the next. A change costs what it
writes, not the size of the tables. Readers list the commits once and take, of each path, the latest version.

compact() folds all versions up to one into a new folder and commits that as "all up to this version": changes that were
committed meanwhile lie above it and count as before. vacuum() deletes folders that no version needs once they are old
enough that no writer or reader can be at them.

Commits need a file system whose rename fails if the target exists, as HDFS has; local folders use a hard link.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CATALOG, CHUNKS, with_structured_columns

#: Changes after which a writer folds all versions into one.
COMPACT_AFTER = 64
_GONE = "file_path string"


@dataclass(frozen=True)
class Commit:
    """A version: where its rows are, which tables it has, and up to which version it stands for all others."""

    number: int
    folder: str
    tables: tuple[str, ...]
    through: int | None = None

    @property
    def version(self) -> int:
        """What its rows count as."""
        return self.number if self.through is None else self.through


class Store:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        self._read: dict[int, Commit] = {}  # commits don't change
        for name in ("commits", "data"):
            self._fs.mkdirs(self._path(name))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    # Versions

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("commits")))
        return sorted(int(n) for n in names if n.isdigit())

    def _commit_of(self, number: int) -> Commit:
        if number not in self._read:
            stream = self._fs.open(self._path("commits", f"{number:012d}"))
            try:
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self._read[number] = Commit(number, said["folder"], tuple(said["tables"]), said.get("through"))
        return self._read[number]

    def commits(self) -> list[Commit]:
        """The versions that count: the one that stands for most others, and those above what it stands for."""
        found = [self._commit_of(n) for n in self._numbers()]
        full = max((c for c in found if c.through is not None), key=lambda c: (c.through, c.number), default=None)
        if full is None:
            return found
        return [full, *(c for c in found if c.through is None and c.number > full.through)]

    @property
    def version(self) -> int:
        return max((c.version for c in self.commits()), default=0)

    def _publish(self, number: int, said: dict) -> bool:
        """Makes a commit file with its content; False if the number is taken."""
        name, draft = self._path("commits", f"{number:012d}"), self._path("commits", f"_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        if not self._local:
            done = not self._fs.exists(name) and self._fs.rename(draft, name)
            if not done:
                self._fs.delete(draft, False)
            return done
        try:
            os.link(draft.toUri().getPath(), name.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def _commit(self, folder: str, tables: tuple[str, ...], through: int | None = None) -> int:
        """The number that the change got: the next free one."""
        if not self._fs.exists(self._path("data", folder)):
            raise RuntimeError("the change was deleted before it was committed")
        said = {"folder": folder, "tables": list(tables)} | ({} if through is None else {"through": through})
        number = max(self._numbers(), default=0) + 1
        while not self._publish(number, said):
            number = max(number, *self._numbers()) + 1
        return number

    def _table(self, commits: list[Commit], name: str, schema: str) -> DataFrame:
        """The rows of one table in those versions, with the version that they count as: one scan."""
        own = [c for c in commits if name in c.tables]
        if not own:
            return self.spark.createDataFrame([], schema + ", _version long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{c.folder}/{name}" for c in own])
        versions = F.create_map(*[F.lit(x) for c in own for x in (c.folder, c.version)])
        folder = F.regexp_extract(F.col("_metadata.file_path"), f"/data/([^/]+)/{name}/[^/]+$", 1)
        return rows.withColumn("_version", F.element_at(versions, folder).cast("long"))

    def _latest(self, commits: list[Commit]) -> DataFrame:
        """(file_path, _version) of the documents that exist; a deletion is the latest version of what it deletes."""
        changes = self._table(commits, "catalog", CATALOG).select("file_path", "_version", F.lit(True).alias("there"))
        gone = self._table(commits, "deleted", _GONE).select("file_path", "_version", F.lit(False).alias("there"))
        last = changes.unionByName(gone).groupBy("file_path").agg(F.max(F.struct("_version", "there")).alias("s"))
        return last.where("s.there").select("file_path", "s._version")

    def _current(self, commits: list[Commit], name: str, schema: str) -> DataFrame:
        rows = self._table(commits, name, schema)
        if len(commits) > 1:
            rows = rows.join(_spread(self._latest(commits)), ["file_path", "_version"], "left_semi")
        return rows.drop("_version")

    # Reading

    def catalog(self) -> DataFrame:
        return self._current(self.commits(), "catalog", CATALOG)

    def chunks(self) -> DataFrame:
        return with_structured_columns(self._current(self.commits(), "chunks", CHUNKS))

    def registry(self) -> DataFrame:
        """(file_path, file_hash, modified_time) of all documents."""
        return self.catalog().select("file_path", "file_hash", "modified_time")

    def exists(self, path: str, file_hash: str) -> bool:
        return bool(self.catalog().where((F.col("file_path") == path) & (F.col("file_hash") == file_hash)).limit(1).count())

    # Writing

    def upsert(self, catalog: DataFrame, chunks: DataFrame, force: bool = False) -> int:
        """Puts documents with their chunks in the place of those with the same path; how many changed.

        Documents whose path and hash are there already are left out, unless forced. Both tables count at once. Of rows
        with one path the one with the greatest hash is taken. Columns that are missing are null, others don't count.
        """
        incoming = catalog.where("file_path is not null").groupBy("file_path").agg(F.max_by(F.struct(*_as(catalog, CATALOG)), F.col("file_hash")).alias("s")).select("s.*")
        if not force:
            incoming = incoming.join(_spread(self.registry().select("file_path", "file_hash")), ["file_path", "file_hash"], "left_anti").select(incoming.columns)
        folder = uuid.uuid4().hex
        incoming.write.parquet(f"{self.root}/data/{folder}/catalog")
        written = self.spark.read.schema(CATALOG).parquet(f"{self.root}/data/{folder}/catalog")
        changed = written.count()
        if not changed:
            self._fs.delete(self._path("data", folder), True)
            return 0
        own = chunks.select(*_as(chunks, CHUNKS)).join(_spread(written.select("file_path", "file_hash")), ["file_path", "file_hash"], "left_semi")
        own.write.parquet(f"{self.root}/data/{folder}/chunks")
        self._commit(folder, ("catalog", "chunks"))
        self._tidy()
        return changed

    def delete(self, paths: DataFrame | list[str]) -> int:
        """Takes documents out; how many there were."""
        if isinstance(paths, list):
            paths = self.spark.createDataFrame([(p,) for p in paths], _GONE)
        there = self._latest(self.commits()).select("file_path").join(_spread(paths.select("file_path").distinct()), "file_path", "left_semi")
        folder = uuid.uuid4().hex
        there.write.parquet(f"{self.root}/data/{folder}/deleted")
        gone = self.spark.read.schema(_GONE).parquet(f"{self.root}/data/{folder}/deleted").count()
        if not gone:
            self._fs.delete(self._path("data", folder), True)
            return 0
        self._commit(folder, ("deleted",))
        self._tidy()
        return gone

    def _tidy(self) -> None:
        if len(self.commits()) > self.compact_after:
            self.compact()

    def compact(self) -> int:
        """Folds the versions that count now into one; the version that it stands for. Older folders stay, until vacuum()."""
        commits = self.commits()
        if len(commits) < 2:
            return self.version
        folder, through = uuid.uuid4().hex, max(c.version for c in commits)
        self._current(commits, "catalog", CATALOG).write.parquet(f"{self.root}/data/{folder}/catalog")
        self._current(commits, "chunks", CHUNKS).write.parquet(f"{self.root}/data/{folder}/chunks")
        self._commit(folder, ("catalog", "chunks"), through)
        return through

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes folders that no counting version uses and that are older than so many seconds; how many.

        A change that is still being written has a folder without a commit: the age must exceed the longest write, and
        the longest read of an older version.
        """
        before, gone = time.time() - older_than, 0
        statuses = self._fs.listStatus(self._path("data"))
        used = {c.folder for c in self.commits()}  # after the list: what was committed since is used
        for s in statuses:
            if s.getPath().getName() not in used and s.getModificationTime() / 1000 <= before:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def _spread(keys: DataFrame) -> DataFrame:
    """For the other side of a join: a row a document, which is never gathered in the driver to be broadcast.

    Spark's threshold is for compressed bytes; as a hash table in the driver the same rows take many times as much.
    """
    return keys.hint("merge")


def _as(df: DataFrame, schema: str) -> list[Column]:
    """The columns of a schema from df, null where it has none."""
    return [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields]


# The same steps on DataFrames, for tables that are kept elsewhere.


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with the rows of incoming in the place of those with the same key."""
    return existing.join(incoming.select(key), key, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def without(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key), key, "left_anti").select(existing.columns)
