"""Token ids in files of canonical, length-limited Huffman codes.

A file is a row of the written table: the ids of some whole documents in ascending order, as one stream of bits,
with the offset of every BLOCK-th id, from which blocks are decoded independently of each other. The code comes from
the counts of ids in the whole corpus; its lengths are the code book, and a table over the next LONGEST bits decodes.
Ids are decoded in step over all blocks of a file, so that numpy handles thousands of them at once.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_VALUES, TextSlice, materialise, per_text
from .units import ShortKeys

LONGEST = 18
#: Ids between two recorded bit offsets.
BLOCK = 128
#: A file is closed once it holds so many ids; a document is never split.
FILE_IDS = 1 << 19
MAGIC = b"QHF2"
#: The mark, the numbers of documents, ids and bytes of bits, and the bytes of the code book.
_HEAD = struct.Struct("<4sIQQI")
_encoders: dict[str, TextEncoder] = {}


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The length of each id's code, 0 for ids without a count: package-merge, optimal among codes no longer."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([leaves, pairs])
        by = np.argsort(every, kind="stable")
        row = every[by]
        is_leaf.append(by < len(leaves))
    take, deep = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        deep[:n] += 1
        take = 2 * (take - n)
    lengths[order] = deep
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    size = lengths[order].astype(np.int64)
    # Scaled to the greatest length, each code is the sum of the shares of those before it.
    share = np.int64(1) << (LONGEST - size)
    codes[order] = ((np.cumsum(share) - share) >> (LONGEST - size)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next LONGEST bits the id and the length of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    share = np.int64(1) << (LONGEST - lengths[order].astype(np.int64))
    ids = np.zeros(1 << LONGEST, np.int32)
    ids[: int(share.sum())] = np.repeat(order, share)
    return ids, lengths[ids].astype(np.int64)


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every BLOCK-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    bits = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    word = starts >> 5
    n = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 1
    # Bits of different ids never meet, so sums of up to 32 bits are exact in doubles.
    packed = np.bincount(word, weights=(bits >> np.uint64(32)).astype(np.float64), minlength=n + 1)
    packed[1:] += np.bincount(word, weights=(bits & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n + 1)[:-1]
    return packed[:n].astype(">u4").tobytes(), starts[::BLOCK]


def unpack(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a stream; all blocks advance together, an id at a time."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    ids, lengths = table
    out = np.zeros((len(offsets), BLOCK), np.int32)
    at, last = offsets.astype(np.int64), n - (len(offsets) - 1) * BLOCK if len(offsets) else 0
    for step in range(min(BLOCK, n)):
        if step == last and len(offsets) > 1:
            at = at[:-1]  # the last block is shorter
        elif step >= last and len(offsets) == 1:
            break
        look = (window[at >> 3] >> (32 - LONGEST - (at & 7)).astype(np.uint32) & np.uint32((1 << LONGEST) - 1)).astype(np.int64)
        out[: len(at), step] = ids[look]
        at = at + lengths[look]
    return out.ravel()[:n]


def write_file(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits, offsets = pack(ids, codes, lengths)
    book = zlib.compress(lengths.astype(np.uint8).tobytes())
    null = np.array([k is None for k in keys], np.uint8)
    known = np.array([k or 0 for k in keys], "<i8")
    head = _HEAD.pack(MAGIC, len(keys), len(ids), len(bits), len(book))
    return b"".join([head, book, null.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), bits])


class FileReader:
    """Reads files, each by its own code book; the table of the last book is kept."""

    def __init__(self) -> None:
        self._book, self._table = b"", decode_table(np.zeros(1, np.uint8))

    def __call__(self, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """The keys, sizes and ids of a file's documents."""
        magic, docs, n, size, book = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = _HEAD.size
        if payload[at : at + book] != self._book:
            self._book = payload[at : at + book]
            self._table = decode_table(np.frombuffer(zlib.decompress(self._book), np.uint8))
        at += book

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        null, keys, sizes = part("u1", docs), part("<i8", docs), part("<u4", docs).astype(np.int64)
        offsets = part("<u4", -(-n // BLOCK))
        ids = unpack(payload[at : at + size], offsets, n, self._table)
        return [None if x else k for x, k in zip(null.tolist(), keys.tolist(), strict=True)], sizes, ids


# How the tokenizers prepare texts that TextEncoder has its own way for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_known(spec: dict) -> bool:
    """Whether a tokenizer prepares texts in the way that the units are made for."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    bytes_only = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    by_pattern = parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    model = spec.get("model") or {}
    plain = model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout") and not model.get("ignore_merges")
    marked = all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens") or [])
    return spec.get("normalizer") == _NORMALIZER and bytes_only and by_pattern and plain and marked and not spec.get("truncation") and not spec.get("padding") and not spec.get("post_processor")


class TextEncoder:
    """Ids of whole texts, with the library called once for each distinct unit that is remembered.

    This is for tokenizers that drop white space, so that no token spans it, as _is_known() checks. In texts of ASCII and Latin-1 letters without apostrophes
    it also parts every run of letters from what is beside it, so there runs of letters, and runs of neither letters
    nor white space, are units, in lower case as the tokenizer has them. Elsewhere units are what lies between spaces.
    A tokenizer that prepares texts in another way gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._by_units = _is_known(json.load(f))
        self.size = self._tok.get_vocab_size()
        suffix = self._tok.model.end_of_word_suffix or ""
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for w, i in self._tok.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self._keys, self._long = ShortKeys(), {}
        self._forget()

    def _forget(self) -> None:
        self._keys.clear()
        self._long.clear()
        self._flat, self._used = np.empty(1 << 20, np.int32), 0
        self._at, self._count, self._bytes = np.zeros(MOST_UNITS + 1, np.int64), 0, 0

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and units + 1 offsets."""
        flat, sizes = [], []
        texts = [u.decode() for u in units]
        for i in range(0, len(texts), 500):
            some = texts[i : i + 500]
            ids = None
            if all(map(str.isalpha, some)):
                # One word each, so their ends are the tokens that end words.
                ids = np.array(self._tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
                ends = np.flatnonzero(self._ends[ids])
                if len(ends) == len(some) and len(ids) == ends[-1] + 1:
                    flat.append(ids)
                    sizes.append(np.diff(np.r_[-1, ends]))
                    continue
            e = self._tok.encode(some, is_pretokenized=True, add_special_tokens=False)
            words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            flat.append(np.array(e.ids, np.int32))
            sizes.append(np.bincount(words[words >= 0], minlength=len(some)))
        return np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(sizes))]

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Numbers for new units, letters first."""
        units.sort(key=lambda u: not u.decode().isalpha())
        flat, at = self._encode(units)
        need = self._used + len(flat)
        if need > len(self._flat):
            self._flat = np.concatenate([self._flat[: self._used], np.empty(need, np.int32)])
        self._flat[self._used : need] = flat
        if self._count + len(units) >= len(self._at):
            self._at = np.concatenate([self._at, np.zeros(len(units), np.int64)])
        self._at[self._count : self._count + len(units) + 1] = self._used + at
        numbers = np.arange(self._count, self._count + len(units))
        self._used, self._count, self._bytes = need, self._count + len(units), self._bytes + sum(map(len, units))
        return numbers

    def __call__(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by end_id, and rows + 1 offsets."""
        if not self._by_units:
            return self._whole(data, at, end_id)
        rows = len(at) - 1
        # Rows with any byte that the finer rule isn't made for take the plain one.
        odd = _ODD[data]
        if len(data) > 1:
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            odd[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        count = np.r_[0, np.cumsum(odd)]
        plain = count[at[1:]] > count[at[:-1]]
        kind = _KIND[data]
        low = _LOWERED[data]
        if plain.any():
            within = np.repeat(plain, np.diff(at))
            low[within] = data[within]
            kind[within] = (data[within] != 0x20) & (data[within] != 0x0A)
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        change = np.r_[True, kind[1:] != kind[:-1]] if len(data) else np.empty(0, bool)
        cuts = np.flatnonzero(change | first[:-1])
        stops = np.r_[cuts[1:], len(data)]
        full = kind[cuts] > 0
        starts, lens = cuts[full], (stops - cuts)[full]
        bounds = np.searchsorted(starts, at)
        number = self._numbers(np.concatenate([low, np.zeros(16, np.uint8)]), starts, lens)
        begin = self._at[number]
        size = self._at[number + 1] - begin
        total = np.r_[0, np.cumsum(size)]
        offsets = total[bounds] + np.arange(rows + 1)
        out = np.empty(int(offsets[-1]), np.int32)
        out[offsets[1:] - 1] = end_id
        if len(number):
            row = np.repeat(np.arange(rows), np.diff(bounds))
            shift = np.repeat(begin - total[:-1], size)
            step = np.arange(int(total[-1]))
            out[step + np.repeat(row, size)] = self._flat[step + shift]
        return out, offsets

    def _whole(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found = [[*e.ids, end_id] for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if self._bytes > MOST_BYTES or self._count > MOST_UNITS // 2 and self._count + len(starts) > MOST_UNITS:
            self._forget()
        number = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(lens <= ShortKeys.LONGEST)
        low, high = ShortKeys.keys(data, starts[short], lens[short])
        number[short] = self._keys.find(low, high)
        missing = short[number[short] < 0]
        long = np.flatnonzero(lens > ShortKeys.LONGEST)
        raw = data.tobytes() if len(missing) or len(long) else b""
        for places, known in ((missing, {}), (long, self._long)):
            units = [raw[a : a + n] for a, n in zip(starts[places].tolist(), lens[places].tolist(), strict=True)]
            new = [u for u in dict.fromkeys(units) if u not in known]
            if new:
                numbers = self._learn(new)
                known.update(zip(new, numbers.tolist(), strict=True))
                if known is not self._long:
                    joined = np.frombuffer(b"".join(new) + bytes(16), np.uint8)
                    sizes = np.array([len(u) for u in new], np.int64)
                    self._keys.add(*ShortKeys.keys(joined, np.cumsum(sizes) - sizes, sizes), numbers)
            number[places] = [known[u] for u in units]
        return number


#: Units, and bytes of units, that are remembered; a single slice can go beyond.
MOST_UNITS, MOST_BYTES = 700_000, 1 << 23
_ODD = np.zeros(256, bool)
_ODD[[*range(0x00, 0x09), *range(0x0B, 0x0D), *range(0x0E, 0x20), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
# 0: white space, 1: letters, all bytes beyond ASCII among them, 2: the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_LOWERED[0x80:0x9F] += 0x20  # second bytes of the capitals from U+00C0 on; rows with the sign among them are odd


def _encoder(path: str) -> TextEncoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) of each row; ids: little-endian unsigned 16-bit integers, 32-bit for large vocabularies."""

    def work(part: TextSlice) -> list[pa.Array]:
        encode = _encoder(tokenizer)
        flat, at = encode(*part.flat(), end_id)
        kind = "<u2" if encode.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        raw = flat.astype(kind)
        offsets = pa.array((at * raw.itemsize).astype(np.int32)).buffers()[1]
        return [pa.array(np.diff(at)), pa.Array.from_buffers(pa.binary(), part.rows, [None, offsets, pa.py_buffer(raw)])]

    return per_text(docs, [key], text, "n_tokens long, ids binary", work)


def id_counts(tokens: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id occurs in all documents; each task adds up its own first."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:  # one row an id of the vocabulary at most
        counts[r["id"]] = r["n"]
    return counts


def write_files(tokens: DataFrame, lengths: np.ndarray, width: int, key: str) -> DataFrame:
    """(shard, file, base, n_tokens, payload): files in ascending order of key; base: ids before it in its shard."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes = TaskContext.get().partitionId(), canonical_codes(lengths)
        keys, raws, held, base, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, raws, held, base, number
            sizes = np.array([len(r) // width for r in raws])
            payload = write_file(keys, sizes, np.frombuffer(b"".join(raws), kind), codes, lengths)
            row = [[shard], [number], [base], [held], [payload]]
            keys, raws, base, held, number = [], [], base + held, 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "file", "base", "n_tokens", "payload"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                raws.append(raw)
                held += len(raw) // width
                if held >= FILE_IDS:
                    yield close()
        if keys:
            yield close()

    ordered = tokens.repartitionByRange(F.col(key)).sortWithinPartitions(F.col(key), F.col("n_tokens"), F.col("ids")).select(key, "ids")
    return ordered.mapInArrow(run, "shard int, file int, base long, n_tokens long, payload binary")


def read_files(files: DataFrame, key: str = "doc_id", values: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document in the files, from nothing but them."""
    spark = files.sparkSession
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row a partition
    first, rows = 0, []
    for r in totals:
        rows.append((r["shard"], first))
        first += r["n"]
    shards = F.broadcast(spark.createDataFrame(rows, "shard int, first long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_file = FileReader()
        for batch in batches:
            for base, payload in zip(batch.column("from").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                keys, sizes, ids = read_file(payload)
                ends = np.cumsum(sizes)
                wide = ids.astype("<u4")
                cuts = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                cols = [pa.array(keys, pa.int64()), pa.array(base + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(wide[a:b]) for a, b in cuts], pa.int64())]
                if values:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [key, "start", "n_tokens", "ids_crc32", *(["ids"] if values else [])]
    placed = files.join(shards, "shard").select((F.col("first") + F.col("base")).alias("from"), "payload")
    return placed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * values)


def store(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written files of all documents.

    Documents lie in ascending order of key, those with a null key first; rows with one key in the order of their
    number of ids, then of their ids. A null or empty text has only its end id. No documents give no files. Columns
    other than key and text are not read. Keys are integers.
    """
    named = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text))
    size = max(_encoder(tokenizer).size, end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = tokenise(named, tokenizer, end_id, key, text)
    tokens = materialise(tokens, "ids", "zstd")
    lengths = code_lengths(id_counts(tokens, width, size))
    return materialise(write_files(tokens, lengths, width, key), "files", "uncompressed", **LARGE_VALUES)
