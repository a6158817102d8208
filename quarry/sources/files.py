"""Files as rows: scan, predicates, metadata, text."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTED = "path string, length long, modificationTime timestamp"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last extension with its dot, lower-cased; '' for none. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(name_of(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def is_supported(path: Column, extensions: Iterable[str]) -> Column:
    """Whether the lower-cased extension is one of the list, as it is spelled there."""
    return suffix_of(path).isin(list(extensions))


def is_indexed(path: Column, extensions: Iterable[str]) -> Column:
    """Supported, in no hidden folder, not hidden, not a lock or temporary file."""
    return ~path.rlike(r"(^|/)\.[^/]") & ~name_of(path).startswith("~") & is_supported(path, [e.lower() for e in extensions])


def listing(spark: SparkSession, folders: Iterable[str], extensions: Iterable[str]) -> DataFrame:
    """(path, length, modificationTime) of all indexed files below folders that the driver can list, sorted by path.

    Spark's own file source leaves out names that begin with an underscore; this doesn't. Extensions match as written.
    """
    found, wanted = {}, tuple(extensions)
    for folder in folders:
        for base, _, names in os.walk(folder):
            for name in names:
                if name.endswith(wanted):
                    p = os.path.join(base, name)
                    s = os.stat(p)
                    found[p] = (p, s.st_size, s.st_mtime)
    rows = spark.createDataFrame(list(found.values()), "path string, length long, mtime double")
    rows = rows.select("path", "length", F.timestamp_seconds("mtime").alias("modificationTime"))
    return rows.where(is_indexed(F.col("path"), extensions)).orderBy("path")


def scan(spark: SparkSession, folder: str, extensions: Iterable[str], contents: bool = True) -> DataFrame:
    """The same from any file system that Spark reads, with the contents unless told otherwise; not sorted."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows if contents else rows.select("path", "length", "modificationTime")
    return rows.dropDuplicates(["path"]).where(is_indexed(F.regexp_replace("path", "^[a-z]+:/+", "/"), extensions))


def empty_files(spark: SparkSession, folder: str, extensions: Iterable[str]) -> DataFrame:
    """The rows of files without bytes, which Spark's file source leaves out; only of folders the driver can list."""
    local = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    found = listing(spark, [local] if os.path.isdir(local) else [], [*extensions, *(e.upper() for e in extensions)])
    return found.where("length = 0").select(F.concat(F.lit("file:"), "path").alias("path"), "length", "modificationTime", F.lit(b"").alias("content"))


def within_size(rows: DataFrame, most_mb: int) -> DataFrame:
    """Without files over the limit; the filter reaches the listing, so larger ones aren't read."""
    return rows.where(F.col("length") <= most_mb * 1048576)


def iso_time(t: Column) -> Column:
    """As Python prints a naive time: microseconds only where there are any."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def metadata(rows: DataFrame) -> DataFrame:
    """rows with the catalog's columns on the file itself; its hash is of its bytes."""
    path = F.col("path")
    return rows.withColumns({"file_path": path, "file_name": name_of(path), "file_size": F.col("length"), "file_type": suffix_of(path), "modified_time": iso_time(F.col("modificationTime")), "file_hash": F.sha2("content", 256)})


def decoded(content: Column) -> Column:
    """The text of a file: UTF-8 if it is valid, else Latin-1; line ends become \\n."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def file_info(path: str) -> dict | None:
    """Size, times and type of one file; None if there is none."""
    if not os.path.exists(path):
        return None
    s = os.stat(path)
    return {"size": s.st_size, "size_mb": round(s.st_size / 1048576, 2), "modified": s.st_mtime, "created": s.st_ctime, "extension": os.path.splitext(path)[1].lower(), "mime_type": mimetypes.guess_type(path)[0]}
