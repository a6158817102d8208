"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of as many words as the item slide over the documents. A window's fingerprint has
BITS bits, each the sign of a sum over its word shingles with their multiplicity. It is looked up in a multi-index:
the fingerprints of the items of that length are cut into BLOCKS blocks, and of two that differ in at most RADIUS bits
one block at least differs in few enough bits, so all within the radius are found. Those are verified by the exact
weighted similarity: the sum of the smaller over the sum of the larger counts of all shingles of window and item.

At a similarity of 0.8 two fingerprints differ in 19 bits on average with a deviation of 4; a radius of 40 loses less
than one pair in a million. So wide a radius is 31 % of the bits: short blocks agree with almost every item (41 blocks of
3 bits with all of them, 8 blocks of 16 bits, each within 4 bits, with a third), and the blocks that a block of 64 bits
may differ in can't be listed. So the blocks are two machine words, and a block's column is compared with all items
of the length by XOR and a count of bits; one item in 400 is a candidate then.

Windows of which too few shingles occur in items of their length to reach the similarity get no fingerprint, which
loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, TextSlice, distinct, flat, materialise, mix, per_text, word_hashes, words

BITS, RADIUS = 128, 40
BLOCKS = BITS // 64
#: What the blocks may differ in: of a difference of RADIUS bits some block has no more than its share.
SHARES = tuple((RADIUS - BLOCKS + 1 + i) // BLOCKS for i in range(BLOCKS))
SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of benchmark text that a task holds, in about six times as much memory; of a larger benchmark, parts of this
#: size go over the documents in jobs of their own.
PART_BYTES = 16 << 20
#: Windows whose fingerprints are made at once, and pairs of fingerprints that are compared at once.
_WINDOWS, _PAIRS = 4096, 1 << 20
_FOUND = "array<struct<item_id:bigint,start_word:bigint,n_words:bigint,similarity:double>>"


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, letters of any script in lower case, and each text's bounds among them."""
    data, at = flat(pc.utf8_lower(texts))
    starts, ends, bounds = words(data, at, NOT_ALNUM)
    return word_hashes(data, starts, ends), bounds


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on."""
    n = max(len(h) - k + 1, 0)
    roll = np.full(n, k, np.uint64)
    for j in range(k if n else 0):
        roll = mix(roll + h[j : n + j])
    return roll


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each `size` consecutive shingles, in 64-bit words."""
    wide = np.stack([mix(shingles + np.uint64(i)) for i in range(1, BLOCKS + 1)], axis=1)
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1).view(np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags, the sum of the smaller over the sum of the larger counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


class Items:
    """Benchmark items in arrays by their number of words: ids, bags of shingles, and the columns of fingerprint blocks."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        h, bounds = _hashes(pa.array([t for _, t in items], pa.string()))
        sizes, ids = np.diff(bounds), np.array([i for i, _ in items], np.int64)
        self.ids: dict[int, np.ndarray] = {}
        self.bags: dict[int, np.ndarray] = {}
        self.blocks: dict[int, np.ndarray] = {}
        of: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n in distinct(sizes[sizes > 0]).tolist():
            rows, k = np.flatnonzero(sizes == n), min(shingle, n)
            bags = np.array([_rolled(h[bounds[i] : bounds[i] + n], k) for i in rows.tolist()])
            self.ids[n], self.bags[n] = ids[rows], bags
            self.blocks[n] = np.ascontiguousarray(np.array([fingerprints(b, len(b))[0] for b in bags]).T)
            of.setdefault(k, []).append((distinct(bags.ravel()), n))
        # Of each shingle length the shingles, sorted, and the lengths of the items that each occurs in.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, found in of.items():
            every = np.concatenate([x for x, _ in found])
            lengths = np.repeat(np.array([n for _, n in found], np.int32), [len(x) for x, _ in found])
            order = np.argsort(every, kind="stable")
            every, lengths = every[order], lengths[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            low = np.zeros(1 << max(16, len(first).bit_length() + 3), bool)
            low[(every & np.uint64(len(low) - 1)).astype(np.int64)] = True
            self.known[k] = every[first], np.r_[first, len(every)], lengths, low

    def occurs(self, roll: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the shingles that occur in an item of this shingle length, and their numbers."""
        every, _, _, low = self.known[k]
        at = np.flatnonzero(low[(roll & np.uint64(len(low) - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(every, roll[at]), len(every) - 1)
        real = every[spot] == roll[at]
        return at[real], spot[real]

    def candidates(self, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance so far) of the items of n words that agree well enough in one block at least."""
        window, item, far = [], [], []
        step = max(1, _PAIRS // len(self.ids[n]))
        for a in range(0, len(bits), step):
            apart = [np.bitwise_count(bits[a : a + step, j, None] ^ block) for j, block in enumerate(self.blocks[n])]
            w, i = np.nonzero(reduce(np.logical_or, [d <= share for d, share in zip(apart, SHARES, strict=True)]))
            window.append(w + a)
            item.append(i)
            far.append(sum(d[w, i].astype(np.int64) for d in apart))
        return tuple(np.concatenate(x) for x in (window, item, far))

    def near(self, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of n words within the radius of each fingerprint."""
        window, item, far = self.candidates(n, bits)
        return window[far <= RADIUS], item[far <= RADIUS]

    def search(self, n_words: int, rolls: dict[int, np.ndarray], hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        """The best window of one document for each item that reaches the similarity.

        A window of n words needs so many shingles of items of n words at least; only those get a fingerprint.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for k, (at, spot) in hits.items():
            if not len(at):
                continue
            _, cut, lengths, _ = self.known[k]
            many = cut[spot + 1] - cut[spot]
            place = np.repeat(at, many)
            of = lengths[np.repeat(cut[spot] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            order = np.argsort(of, kind="stable")
            place, of = place[order], of[order]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                self._search_length(int(of[a]), place[a:b], rolls[k], min(int(of[a]), n_words) - k + 1, best)
        return [{"item_id": i, "start_word": a, "n_words": n, "similarity": -s} for i, (s, a, n) in sorted(best.items())]

    def _search_length(self, n: int, places: np.ndarray, roll: np.ndarray, size: int, best: dict) -> None:
        """Windows of n words, of `size` shingles, against the items of that length."""
        k = min(self.shingle, n)
        need = self.similarity * (n - k + 1) - 1e-9
        if size < 1 or size < need or len(places) < need:
            return
        flags = np.zeros(len(roll) + 1, np.int64)
        flags[places + 1] = 1
        total = np.cumsum(flags)
        starts, done = np.flatnonzero(total[size:] - total[:-size] >= need), 0
        while done < len(starts):
            first = int(starts[done])
            stop = int(np.searchsorted(starts, first + _WINDOWS))
            own = starts[done:stop] - first
            bits = fingerprints(roll[first : first + int(own[-1]) + size], size)[own]
            done = stop
            for w, i in zip(*(x.tolist() for x in self.near(n, bits)), strict=True):
                start, item = first + int(own[w]), int(self.ids[n][i])
                s = weighted_similarity(roll[start : start + size], self.bags[n][i])
                if s >= self.similarity - 1e-9 and (-s, start) < best.get(item, (1.0, 0, 0))[:2]:
                    best[item] = (-s, start, size + k - 1)


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about PART_BYTES, the texts of one id together; a part is what a task holds."""
    part, size = [], 0
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        if size >= PART_BYTES and part[-1][0] != r["i"]:
            yield part
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += len(r["t"].encode())
    if part:
        yield part


def _found_in(docs: DataFrame, items: list[tuple[int, str]], keys: list[str], text: str, name: str, shingle: int, similarity: float) -> DataFrame:
    """keys and `name`: the items of one part that each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(items, shingle, similarity))  # made of PART_BYTES of text

    def work(part: TextSlice) -> list[pa.Array]:
        own = shared.value
        h, bounds = _hashes(part.texts)
        rolls = {k: _rolled(h, k) for k in own.known}
        hits = {k: own.occurs(r, k) for k, r in rolls.items()}
        out: list[list] = [[] for _ in range(part.rows)]
        rows = distinct(np.concatenate([np.searchsorted(bounds, at, "right") - 1 for at, _ in hits.values()] or [np.empty(0, np.int64)]))
        for row in rows.tolist():
            a, b = int(bounds[row]), int(bounds[row + 1])
            inside = {k: slice(a, max(b - k + 1, a)) for k in rolls}
            mine = {}
            for k, (at, spot) in hits.items():
                i = slice(*np.searchsorted(at, (a, inside[k].stop)))
                mine[k] = at[i] - a, spot[i]
            out[row] = own.search(b - a, {k: rolls[k][s] for k, s in inside.items()}, mine)
        return [pa.array(out, _ARROW)]

    return per_text(docs, keys, text, f"`{name}` {_FOUND}", work)


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, item_id, start_word, n_words, similarity): a row for each item that a document holds, with its best window,
    the first of equals.

    Words are runs of ASCII digits and letters and of all characters beyond ASCII, each letter in lower case. An item of
    fewer words than a shingle is one shingle, its whole sequence; one without words, or with a null, is never found.
    A document shorter than an item is one window. Items with one id count as one, those with equal texts apart. A null
    or empty text has no items, repeated rows have the same, and whole texts are searched. An empty benchmark finds
    nothing. Other columns of docs are not read. Of a benchmark beyond PART_BYTES each part goes over all documents
    before the next one does, so that tasks hold one part.
    """
    every = None
    parts = _parts(benchmark, item, item_text)
    items, following = next(parts, []), next(parts, None)
    while True:
        found = _found_in(docs, items, [key], text, "m", shingle, similarity).select(key, F.explode("m").alias("m"))
        rows = found.select(key, "m.item_id", "m.start_word", "m.n_words", "m.similarity")
        if following is None and every is None:
            return rows
        rows = materialise(rows, "matches")
        every = rows if every is None else every.union(rows)
        if following is None:
            return every
        items, following = following, next(parts, None)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; as matches() otherwise."""
    name = "found_items"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    parts, columns = _parts(benchmark, item, item_text), docs.columns
    items, following = next(parts, []), next(parts, None)
    while True:
        docs = _found_in(docs, items, columns, text, name, shingle, similarity).where(F.size(name) == 0).drop(name)
        if following is None:
            return docs
        docs, items, following = materialise(docs, "clean"), following, next(parts, None)
