"""Masked pseudo-likelihood: a bidirectional window network, with the counts of all words and word contexts.

The network predicts the class of every token from the classes on both sides of it: the neighbours' embeddings, one
table for each side, add up to a hidden layer, from which a softmax over all classes follows. The most frequent words
have a class of their own, the others share classes by a hash, and one class stands for the text's ends. It is trained
on the counts of all (left, token, right) classes of the corpus, of which there are CLASSES^3 at most.

What goes beyond those classes comes from counts that grow with the corpus and lie in partitions, by a hash:

* contexts: where a neighbour shares its class, the token's class is predicted from what stands between the same two
  words elsewhere, with the network's distribution worth PRIOR observations;
* words: a token that shares its class has its own probability within it, from the counts of all words, with a
  spelling of equally likely bytes for what is new. Its weight is the number of the class's different words.

A document's score is the sum of the log-probabilities of its tokens, each given its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TextSlice, finished_shuffles_go, materialise, mix, per_text, text_slices, word_hashes, words

CLASSES, SHARED = 160, 32
#: Class 0 is the end of a text; then the frequent words; then the shared classes.
FREQUENT = CLASSES - SHARED - 1
HIDDEN, STEPS, RATE = 32, 150, 0.03
#: Distinct words that a task holds before it passes their counts on.
_HELD = 1 << 20
#: What the network's distribution counts for in a context of words.
PRIOR = 2.0
#: Partitions of the counts, more where one would hold over 4 million tokens; bytes of text that are dealt out at once.
_BUCKETS, _BUCKET_BITS, _DEALT = 128, 22, 1 << 22
#: Rows whose parts of the score travel together.
_BLOCK_BITS = 12
_COUNTED, _ASKED = 1, 2
#: Bytes of a hash that travel; its bucket tells more of it.
_KEY_BYTES = 5


def _tokens(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of the words, and rows + 1 bounds."""
    data, at = part.flat()
    data = LOWER[data]
    starts, ends, bounds = words(data, at)
    return word_hashes(data, starts, ends), ends - starts, bounds


def _hashes(part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    h, _, bounds = _tokens(part)
    return h, bounds


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, compressed: the width, the size, the content."""
    kind = next(k for k in (np.uint8, np.uint16, np.int64) if k is np.int64 or (x.min() >= 0 and x.max() <= np.iinfo(k).max))
    raw = x.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[5:], int.from_bytes(b[1:5], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[b[0]]).astype(np.int64)


def _packed_classes(codes: np.ndarray) -> bytes:
    return _packed(np.concatenate([codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES]))


def _unpacked_classes(b: bytes) -> np.ndarray:
    left, token, right = _unpacked(b).reshape(3, -1)
    return (left * CLASSES + token) * CLASSES + right


def _short(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, _KEY_BYTES)
    return out.reshape(-1).view("<u8")


def _beside(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands left and right of each token; 0 at the ends of a text."""
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    some = bounds[:-1] < bounds[1:]
    left[bounds[:-1][some]], right[bounds[1:][some] - 1] = 0, 0
    return left, right


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the hash and the count of every word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for part in text_slices(batch, text):
                new, n = np.unique(_hashes(part)[0], return_counts=True)
                every, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
                keys = every
                if len(keys) > _HELD:
                    yield held()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield held()

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The hashes of the most frequent words of all documents; ties by hash."""
    return _most_frequent(vocabulary(docs, text))


def _most_frequent(found: DataFrame) -> np.ndarray:
    top = found.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


class Classes:
    """The class of each word hash."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.keys, self.values = frequent[order], order + 1

    def of(self, h: np.ndarray) -> np.ndarray:
        shared = CLASSES - SHARED + (h % np.uint64(SHARED)).astype(np.int64)
        if not len(self.keys):
            return shared
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], shared)

    def contexts(self, part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """left * CLASSES^2 + token * CLASSES + right for each token, and rows + 1 bounds."""
        h, bounds = _hashes(part)
        c = self.of(h)
        left, right = _beside(c, bounds)
        return (left * CLASSES + c) * CLASSES + right, bounds


def context_counts(docs: DataFrame, classes: Classes, text: str = "text") -> np.ndarray:
    """counts[left, right, token] over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in text_slices(batch, text):
                key, n = np.unique(classes.contexts(part)[0], return_counts=True)
                total[key] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["context", "n"])

    rows = docs.select(text).mapInArrow(run, "context int, n long").groupBy("context").agg(F.sum("n").alias("n")).toArrow()  # CLASSES^3 at most
    counts = np.zeros(CLASSES**3, np.float32)
    counts[rows.column("context").to_numpy()] = rows.column("n").to_numpy()
    return counts.reshape(CLASSES, CLASSES, CLASSES).transpose(0, 2, 1)


#: Rows that are multiplied at once: few enough for the library to stay on one thread, as others may need the cores.
_ROWS = 40


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.reshape(-1, _ROWS, a.shape[1]) @ b).reshape(len(a), b.shape[1])


class WindowNetwork:
    """p(token | left, right) = softmax(out @ tanh(left table + right table + shift) + bias)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"left": small(CLASSES, HIDDEN), "right": small(CLASSES, HIDDEN), "shift": small(HIDDEN), "out": small(HIDDEN, CLASSES), "bias": small(CLASSES)}

    def _forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(self.p["left"][left] + self.p["right"][right] + self.p["shift"])
        z = _product(h, self.p["out"]) + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return h, z

    def log_probabilities(self) -> np.ndarray:
        """Of every token in every context, by left, token, right."""
        left, right = np.divmod(np.arange(CLASSES**2), CLASSES)
        return np.ascontiguousarray(self._forward(left, right)[1].reshape(CLASSES, CLASSES, CLASSES).transpose(0, 2, 1))

    def fit(self, counts: np.ndarray, steps: int = STEPS) -> WindowNetwork:
        """Adam on the likelihood of all counts at once."""
        flat = counts.reshape(CLASSES**2, CLASSES)
        total = flat.sum(dtype=np.float64)
        if not total:
            return self
        y = (flat / total).astype(np.float32)
        weight = y.sum(axis=1, keepdims=True)
        left, right = np.divmod(np.arange(CLASSES**2), CLASSES)
        self.p["bias"] = np.log(y.sum(axis=0) + 1e-9).astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            h, z = self._forward(left, right)
            err = np.exp(z) * weight - y
            back = _product(err, np.ascontiguousarray(self.p["out"].T)) * (1 - h * h)
            grid = back.reshape(CLASSES, CLASSES, HIDDEN)
            g = {"out": (h.reshape(-1, _ROWS, HIDDEN).transpose(0, 2, 1) @ err.reshape(-1, _ROWS, CLASSES)).sum(axis=0), "bias": err.sum(axis=0), "shift": back.sum(axis=0), "left": grid.sum(axis=1), "right": grid.sum(axis=0)}
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self


class Model:
    """A trained network with its classes, and the documents whose words and contexts are counted where they are asked for.

    totals and kinds are the tokens and the different words of each shared class.
    """

    def __init__(self, classes: Classes, network: WindowNetwork, docs: DataFrame, totals: np.ndarray, kinds: np.ndarray):
        self.classes, self.network, self.docs, self.totals, self.kinds = classes, network, docs, totals, kinds

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = self.network.log_probabilities().ravel()
        return self._table

    def of_contexts(self, keys: np.ndarray, codes: np.ndarray, counted: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """What each asked token gains on the network; one that is counted too is left out of its own counts."""
        _, group = np.unique(keys, return_inverse=True)
        _, pair = np.unique(group * CLASSES + codes // CLASSES % CLASSES, return_inverse=True)
        all_, same = np.bincount(group, counted)[group][asked], np.bincount(pair, counted)[pair][asked]
        own, prior = counted[asked], self.table()[codes[asked]].astype(np.float64)
        return np.log(same - own + PRIOR * np.exp(prior)) - np.log(all_ - own + PRIOR) - prior

    def of_words(self, keys: np.ndarray, lengths: np.ndarray, counted: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The log-probability of each asked token within its class; likewise."""
        _, group = np.unique(keys, return_inverse=True)
        own, shared = counted[asked], (keys[asked] % np.uint64(SHARED)).astype(np.int64)
        n, weight = np.bincount(group, counted)[group][asked] - own, self.kinds[shared] + 1.0
        new = np.log(weight) + np.log(SHARED) - (lengths[asked] + 1.0) * np.log(257)
        return np.where(n > 0, np.logaddexp(np.log(np.maximum(n, 1)), new), new) - np.log(self.totals[shared] - own + weight)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("classes", "network", "totals", "kinds")}


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fits the network to all tokens of docs. Without any it stays as it was drawn."""
    with finished_shuffles_go(docs.sparkSession):
        return _train(docs.select(F.col(f"`{text}`").alias(text)), text)


def _train(named: DataFrame, text: str) -> Model:
    found = materialise(vocabulary(named, text), "words")
    frequent = _most_frequent(found)
    classes = Classes(frequent)
    counts = context_counts(named, classes, text)
    kinds = np.zeros(SHARED, np.int64)
    for r in found.groupBy(F.col("word").bitwiseAND(SHARED - 1).alias("c")).count().collect():  # one row a class
        kinds[r["c"]] = r["count"]
    kinds -= np.bincount((frequent % np.uint64(SHARED)).astype(np.int64), minlength=SHARED)
    totals = counts.sum(axis=(0, 1), dtype=np.float64)[CLASSES - SHARED :]
    return Model(classes, WindowNetwork().fit(counts), named.select(F.col(f"`{text}`").alias("_text")), totals, kinds)


def _dealt(docs: DataFrame, shared: object, buckets: int, role: int) -> DataFrame:
    """The tokens of docs (_row, _text) that need counts, packed by bucket: contexts first, then words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value.classes
        for batch in batches:
            for part in text_slices(batch, "_text", _DEALT):
                h, lengths, bounds = _tokens(part)
                c = classes.of(h)
                (lw, rw), (lc, rc) = _beside(h, bounds), _beside(c, bounds)
                row = np.repeat(part.batch.column("_row").to_numpy(), np.diff(bounds))
                rare = CLASSES - SHARED
                at = np.flatnonzero((lc >= rare) | (rc >= rare))
                contexts = (mix(mix(lw[at]) * np.uint64(3) + rw[at]), (lc * CLASSES + c)[at] * CLASSES + rc[at], row[at])
                at = np.flatnonzero(c >= rare)
                out = []
                for kind, (keys, aux, rows, packed) in enumerate(((*contexts, _packed_classes), (h[at], lengths[at], row[at], _packed))):
                    # A hash of its own, as words that share a class have their lowest bits in common.
                    bucket = (mix(keys + np.uint64(7)) % np.uint64(buckets)).astype(np.int32)
                    # Words come again within a slice, so they lie by word, which leaves little of the repeats.
                    order = np.argsort(bucket, kind="stable") if kind == 0 else np.lexsort((rows, keys, bucket))
                    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    keys, aux, rows = keys[order], aux[order], rows[order]
                    for b in np.flatnonzero(np.diff(ends)).tolist():
                        i = slice(ends[b], ends[b + 1])
                        if kind == 0:
                            least, steps, short = int(rows[i.start]), np.diff(rows[i], prepend=rows[i.start]), _short(keys[i])
                        else:
                            least = int(rows[i].min())
                            steps, short = rows[i] - least, pa.compress(_short(keys[i]), "zstd", asbytes=True)
                        out.append((kind * buckets + b, role, least, short, packed(aux[i]), _packed(steps)))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "role", "first", "keys", "aux", "steps"])

    return docs.select("_row", "_text").mapInArrow(run, "bucket int, role int, first long, keys binary, aux binary, steps binary")


def _counted_parts(dealt: DataFrame, shared: object, buckets: int) -> DataFrame:
    """(_row, part): what the counts add to the score of each row that has such tokens."""
    named = ["block", "rows", "parts"]

    def answer(group: pa.Table) -> pa.Table:
        m = shared.value
        columns = {n: group.column(n).to_pylist() for n in ("keys", "aux", "steps", "first", "role")}
        by_context = group.column("bucket")[0].as_py() < buckets
        parts = [(_unpacked_classes if by_context else _unpacked)(x) for x in columns["aux"]]
        sizes, aux = [len(x) for x in parts], np.concatenate(parts)
        raw = [x if by_context else pa.decompress(x, n * _KEY_BYTES, "zstd", asbytes=True) for x, n in zip(columns["keys"], sizes, strict=True)]
        keys = np.concatenate([_long(x) for x in raw])
        steps = [np.cumsum(x) if by_context else x for x in map(_unpacked, columns["steps"])]
        rows = np.concatenate([x + first for x, first in zip(steps, columns["first"], strict=True)])
        role = np.repeat(columns["role"], sizes)
        counted, asked = (role & _COUNTED).astype(np.float64), (role & _ASKED) > 0
        gain = (m.of_contexts if by_context else m.of_words)(keys, aux, counted, asked)
        some, back = np.unique(rows[asked], return_inverse=True)
        part, block = np.bincount(back, gain, len(some)), some >> _BLOCK_BITS
        cuts = np.r_[np.flatnonzero(np.diff(block, prepend=-1)), len(block)] if len(block) else np.zeros(1, np.int64)
        out = [(int(block[a]), _packed(some[a:b] - (some[a] >> _BLOCK_BITS << _BLOCK_BITS)), part[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=named)

    def add(group: pa.Table) -> pa.Table:
        rows = np.concatenate([_unpacked(x) for x in group.column("rows").to_pylist()]) + (group.column("block")[0].as_py() << _BLOCK_BITS)
        parts = np.concatenate([np.frombuffer(x, np.float32) for x in group.column("parts").to_pylist()]).astype(np.float64)
        order = np.lexsort((parts, rows))  # one order of adding up, however the buckets arrive
        some, back = np.unique(rows[order], return_inverse=True)
        return pa.table([pa.array(some), pa.array(np.bincount(back, parts[order]))], names=["_row", "part"])

    answers = dealt.groupBy("bucket").applyInArrow(answer, "block long, rows binary, parts binary")
    return answers.groupBy("block").applyInArrow(add, "_row long, part double")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", seen: bool = False) -> DataFrame:
    """(key, n_tokens, pseudo_log_likelihood, mean_log_probability) of each row of docs.

    Tokens are runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased; all of a text counts. A text that
    is null, empty or without tokens has a sum of 0 and a null mean. Null keys and repeated rows pass through; other
    columns are not read. seen says that docs are those of the training: then each token is left out of the counts that
    predict it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    # Written once, so that a row keeps its number.
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "rows", "zstd")

    def work(part: TextSlice) -> list[pa.Array]:
        m = shared.value
        contexts, bounds = m.classes.contexts(part)
        total = np.r_[0, np.cumsum(m.table()[contexts], dtype=np.float64)]
        return [pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]])]

    n_tokens = int(model.totals.sum())
    buckets = max(1, min(_BUCKETS, n_tokens >> 10), n_tokens >> _BUCKET_BITS)
    dealt = _dealt(rows, shared, buckets, _COUNTED | _ASKED if seen else _ASKED)
    if not seen:
        dealt = dealt.union(_dealt(model.docs.withColumn("_row", F.lit(0).cast("long")), shared, buckets, _COUNTED))
    by_network = per_text(rows, ["_row", "_key"], "_text", "n_tokens long, by_network double", work)
    whole = by_network.join(_counted_parts(dealt, shared, buckets), "_row", "left").withColumn("_sum", F.col("by_network") + F.coalesce("part", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("_sum") / F.col("n_tokens"))
    return whole.select(F.col("_key").alias(key), "n_tokens", F.col("_sum").alias("pseudo_log_likelihood"), mean.alias("mean_log_probability"))
