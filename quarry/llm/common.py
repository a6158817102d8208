"""What the operators of this subpackage share: scratch tables, Arrow text slices, vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that numpy code works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 21

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local master, whose executors are in the driver's own process, gets a temporary one; with any
    other master that is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Writes df once to the shared folder and returns the written table: cuts lineage, survives lost executors.

    The table goes when the application's JVM ends; nothing tells earlier that no plan reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("compression", compression).options(**options).parquet(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def finished_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go as soon as it is done, where Spark otherwise keeps them for a later use."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Options for tables with large binary values: row groups that a reader can hold, and no attempt at a dictionary.
LARGE_VALUES = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


#: Keys that a broadcast of spread_join() holds at most, and the fewest rows of such a key.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined to unique, which has one row a key and says in `n` how many rows have it; n itself goes.

    total: the number of rows, or more. A key of more than total / HOT_KEYS rows (HOT_ROWS at least) is taken from a
    broadcast, which so holds HOT_KEYS keys at most; its rows stay spread, so that no task gets all of them. how is inner
    or left. Columns of both must differ but for the key. A null key joins with nothing.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    found = [c for c in unique.columns if c not in (*on, "n")]
    unique = unique.withColumn("_there", F.lit(True))
    hot = F.broadcast(unique.where(F.col("n") > limit).drop("n").withColumnsRenamed({c: f"_hot_{c}" for c in [*found, "_there"]}))
    first = rows.join(hot, on, "left")
    known = F.coalesce("_hot__there", F.lit(False))
    # Those that are served get a number for a key, which deals them out and meets nothing. A struct, as an equality with
    # a constant would be no key of the join.
    number = F.when(known, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    first = first.withColumn("_on", F.struct(number.alias("side"), *on))
    cold = unique.where(F.col("n") <= limit).dropna(subset=on).select(F.struct(F.lit(-1).cast("long").alias("side"), *on).alias("_on"), *found, "_there")
    both = first.join(cold, "_on", "left")
    if how == "inner":
        both = both.where(known | F.col("_there").isNotNull())
    return both.select(*rows.columns, *[F.when(known, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in found])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(df: DataFrame, keys: list[str], text: str, schema: str, work: Callable) -> DataFrame:
    """Runs work(TextSlice) -> list of Arrow columns over slices of df; keys pass through in front of them."""
    added = StructType.fromDDL(schema)
    # Python functions can't take columns whose names hold dots, so all go by their place.
    wanted = list(dict.fromkeys([*keys, text]))
    out = StructType([StructField(f"c{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + added.fields)
    names, held = out.names, f"c{wanted.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, held):
                cols = [part.batch.column(i) for i in range(len(keys))] + work(part)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    made = df.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(wanted)]).mapInArrow(run, out)
    return made.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"`{n}`") for n in added.names])


class TextSlice:
    """Rows of one Arrow batch whose texts fill about SLICE_BYTES; a null text counts as empty."""

    def __init__(self, batch: pa.RecordBatch, texts: pa.Array, nulls: pa.Array):
        self.batch, self.texts, self.nulls, self.rows = batch, texts, nulls, len(texts)

    @property
    def strings(self) -> list[str]:
        return self.texts.to_pylist()

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all rows and their rows + 1 offsets, without a copy."""
        return flat(self.texts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts without nulls, and their offsets."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if offsets is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def text_slices(batch: pa.RecordBatch, text: str, budget: int = SLICE_BYTES) -> Iterator[TextSlice]:
    if not batch.num_rows:
        return
    texts = batch.column(text)
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    nulls = texts.is_null()
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + budget, "right")))
        yield TextSlice(batch.slice(start, stop - start), texts.slice(start, stop - start), nulls.slice(start, stop - start))
        start = stop


#: True at the bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: True at all of ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 1024), _POWER_BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more, dtype=np.uint64)
    return _powers


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; np.unique() without further results takes a far slower way."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the rows + 1 bounds of each row's words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's start parts words too
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin, lens)
    chars = data[within + np.repeat(starts, lens)]
    table = _power_table(int(lens.max()))
    return mix(np.add.reduceat(_BYTE[chars] * table[within], begin) + lens.astype(np.uint64))


def beginning_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size the hashes of the words' first so many bytes; as word_hashes() of the shortened words."""
    lens, total, out = ends - starts, np.zeros(len(starts), np.uint64), []
    table = _power_table(max(sizes))
    for i in range(max(sizes)):
        char = data[np.minimum(starts + i, max(len(data) - 1, 0))] if len(starts) else np.empty(0, np.uint8)
        total += np.where(lens > i, _BYTE[char] * table[i], np.uint64(0))
        if i + 1 in sizes:
            out.append(mix(total + np.minimum(lens, i + 1).astype(np.uint64)))
    return out


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words, the whole sequence is one."""
    roll = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        roll = mix(roll + h[j : len(h) - k + 1 + j] * np.uint64(2 * j + 3)) if len(roll) else roll
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(distinct(roll[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = mix(np.array([whole + x * np.uint64(0xD6E8FEB86659FD93)], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out
