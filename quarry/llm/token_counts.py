"""Token counts from flat files of ids that have no index.

Each document's ids end with an end-of-document id, and nothing else says where it lies. Files are read in blocks of
any size, raw ones by ranges of bytes. In a block all ends are found by one vectorised comparison; a prefix scan over the
blocks' summaries (ids in them, number of ends, place of the last) then gives each block what lies open before it, which
completes its first document. Only summaries go through the scan; what it finds is joined to the blocks' ends, so
that documents come out where their block is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_VALUES, materialise, text_slices

#: Ids in a block.
BLOCK_IDS = 1 << 18
_encodings: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def write_flat(docs: DataFrame, ranks: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(shard, block, payload, keys): the ids of all rows, one after the other, as little-endian unsigned 32-bit
    integers cut into blocks regardless of documents; keys names those that end in a block, beside the file.

    A shard is what one task has read, so its blocks are few. A null or empty text has its end id only.
    """
    if end_id >= 1 << 32:
        raise ValueError("ids have 32 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoding(ranks, pattern), TaskContext.get().partitionId()
        number, held, keys, have = 0, [], [], 0

        def block(ids: np.ndarray, own: list) -> pa.RecordBatch:
            nonlocal number
            row = [pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))]
            number += 1
            return pa.RecordBatch.from_arrays(row, names=["part", "number", "payload", "keys"])

        for batch in batches:
            for piece in text_slices(batch, text):
                for k, t in zip(piece.batch.column(key).to_pylist(), piece.strings, strict=True):
                    ids = np.append(np.array(enc.encode_ordinary(t), np.uint32), np.uint32(end_id))
                    while have + len(ids) >= block_ids:
                        cut = block_ids - have
                        whole = np.concatenate([*held, ids[:cut]])
                        ids = ids[cut:]
                        yield block(whole, keys if len(ids) else [*keys, k])
                        held, have, keys = [], 0, []
                        if not len(ids):
                            break
                    else:
                        held.append(ids)
                        have += len(ids)
                        keys.append(k)
        if have:
            yield block(np.concatenate(held), keys)

    named = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text))
    return named.mapInArrow(run, "part long, number int, payload binary, keys array<long>").selectExpr("part as shard", "number as block", "payload", "keys")


def read_raw(spark: SparkSession, path: str, width: int = 4, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(shard, block, payload) of raw flat files: a file is a shard, cut into blocks of so many ids.

    path: a file, a folder or a pattern, by any scheme that pyarrow opens (local files, HDFS, object stores). Tasks read
    ranges of bytes, so files may have any size. One whose size is no multiple of width is an error.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = place.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for top in found.globStatus(place) or []:
        for f in found.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                if f.getLen() % width:
                    raise ValueError(f"{f.getPath()} doesn't hold whole ids")
                files.append((f.getPath().toString(), f.getLen()))
    size = block_ids * width
    listed = spark.createDataFrame(files, "shard string, bytes long")  # names only
    blocks = listed.where("bytes > 0").select("shard", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / size))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for shard, whole, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, name = fs.FileSystem.from_uri(shard)
                with system.open_input_file(name) as f:
                    payload = f.read_at(min(size, whole - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "block", "payload"])

    return blocks.repartition("shard", "block").mapInArrow(run, "shard string, block int, payload binary")


def count_tokens(blocks: DataFrame, end_id: int, width: int = 4, names: str | None = None) -> DataFrame:
    """(shard, nth, start, n_tokens, finished[, name]) of each document in the files (shard, block, payload).

    nth counts a shard's documents from 0; start is the place of the first id; n_tokens leaves the end id out, so an
    empty document has 0. Ids after a shard's last end id are an unfinished document, given like the others but with
    finished false. Blocks of a shard follow each other by number; a missing or null payload is an empty block.
    (shard, block) is a key. names: a column of blocks that lists a name for each document that ends in the block.
    """
    kind = f"<u{width}"
    named = [] if names is None else [names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for raw in batch.column("payload").to_pylist():
                ids = np.frombuffer(raw or b"", kind)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            own = [batch.column(n) for n in ("shard", "block", *named)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["shard", "block", *named, "n", "ends"])

    shard = blocks.schema["shard"].dataType.simpleString()
    extra = "".join(f", `{n}` {blocks.schema[n].dataType.simpleString()}" for n in named)
    held = blocks.select("shard", F.col("block").cast("int").alias("block"), *named, "payload")
    found = materialise(held.mapInArrow(run, f"shard {shard}, block int{extra}, n long, ends array<long>"), "ends", "zstd")
    by_shard = Window.partitionBy("shard").orderBy("block")
    before = by_shard.rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("shard", "block", "n", F.size("ends").alias("n_ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last_end"))
    placed = summary.withColumns({"ids_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "docs_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "last": F.lead("block").over(by_shard).isNull()})
    placed = placed.withColumn("last_end", F.col("ids_before") + F.col("last_end"))
    placed = placed.withColumn("open_from", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
    total = F.col("ids_before") + F.col("n")
    tail = F.when(F.col("last") & (F.coalesce(F.col("last_end") + 1, F.col("open_from")) < total), total)
    placed = placed.select("shard", "block", "ids_before", "docs_before", "open_from", tail.alias("tail"))
    # Each end closes what is open since the end before it; the ids after a shard's last end close at its end.
    at = F.transform("ends", lambda x: x + F.col("ids_before"))
    stops = F.concat(at, F.when(F.col("tail").isNotNull(), F.array("tail")).otherwise(F.array().cast("array<long>")))

    def document(stop: Column, i: Column) -> Column:
        start = F.when(i == 0, F.col("open_from")).otherwise(F.get("ends", i - 1) + F.col("ids_before") + 1)
        own = [F.get(F.col(f"`{n}`"), i).alias("name") for n in named]
        return F.struct((F.col("docs_before") + i).alias("nth"), start.alias("start"), (stop - start).alias("n_tokens"), (i < F.size("ends")).alias("finished"), *own)

    spread = found.join(placed, ["shard", "block"]).select("shard", F.explode(F.transform(stops, document)).alias("d"))
    return spread.select("shard", "d.*")


def named_counts(docs: DataFrame, ranks: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shard, nth, start, n_tokens) of each row: writes flat files, counts in them, and names the documents.

    Null keys and repeated rows have a row each; a null or empty text has 0 tokens.
    """
    blocks = materialise(write_flat(docs, ranks, pattern, end_id, key, text), "flat", "zstd", **LARGE_VALUES)
    counts = count_tokens(blocks, end_id, names="keys")
    return counts.select(F.col("name").alias(key), "shard", "nth", "start", "n_tokens")
