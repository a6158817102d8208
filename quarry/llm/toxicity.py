"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over words and word beginnings. Each model also reads the
probabilities of the categories before it. In training those are out-of-fold predictions, made by models that have not
seen the document, so that later models learn how far earlier ones can be trusted.

Labels only say toxic or not, so the categories before `toxic` come from the data: features that toxic documents have
far more often than others are markers, and the toxic documents are parted into KINDS groups by the markers that they
share, whatever language those are in. Feature counts are made in tasks; each model reads the FEATURES features of most
contrast among the documents that it may see, so that what reaches the driver is bounded. The models of one category
(one a fold and one of all) are fitted in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, TextSlice, beginning_hashes, distinct, materialise, mix, per_text, text_slices, word_hashes, words

HASH_BITS = 18
#: Beginnings of so many bytes of longer words are features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: Labelled documents that the models are fitted on at most, taken in the order of a hash of their id.
MAX_TRAINING = 8000
#: Features that a model reads at most, and the fewest documents that show one.
FEATURES, LEAST_DOCS = 2048, 3
#: Groups of toxic documents; markers of a group; the least contrast of a marker, in standard deviations.
KINDS, MARKERS, CONTRAST = 4, 256, 3.0
FOLDS, EPOCHS, BATCH, RATE, DECAY = 4, 10, 32, 0.5, 1e-4
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")


def text_features(part: TextSlice, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all rows, one row after the other, and rows + 1 offsets.

    place: the number of each feature that is wanted, -1 for the others; without it all are, under their own number.
    """
    data, at = part.flat()
    data = LOWER[data]
    starts, ends, bounds = words(data, at, NOT_ALNUM)
    row, lens, found = np.repeat(np.arange(part.rows, dtype=np.int64), np.diff(bounds)), ends - starts, []
    for n, h in zip((0, *BEGINNINGS), [word_hashes(data, starts, ends), *beginning_hashes(data, starts, ends, BEGINNINGS)], strict=True):
        own = (mix(h + np.uint64(n)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        keep = lens > n
        if place is not None:
            own = place[own].astype(np.int64)
            keep &= own >= 0
        found.append((row[keep] << HASH_BITS) | own[keep])
    key = distinct(np.concatenate(found))
    cuts = np.searchsorted(key, np.arange(part.rows + 1, dtype=np.int64) << HASH_BITS)
    return (key & ((1 << HASH_BITS) - 1)).astype(np.int32), cuts


def _taken(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, and their offsets."""
    sizes = at[rows + 1] - at[rows]
    cut = np.r_[0, np.cumsum(sizes)]
    return x[np.repeat(at[rows] - cut[:-1], sizes) + np.arange(int(cut[-1]))], cut


class Linear:
    """A logistic model over sparse binary features of unit length and a few dense ones."""

    def __init__(self, features: int, dense: int):
        self.w, self.v, self.b = np.zeros(features, np.float64), np.zeros(dense, np.float64), 0.0

    def probability(self, x: np.ndarray, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sizes = np.diff(at)
        row = np.repeat(np.arange(len(sizes)), sizes)
        own = np.bincount(row, weights=self.w[x], minlength=len(sizes)) / np.sqrt(np.maximum(sizes, 1))
        return 1 / (1 + np.exp(-np.clip(own + dense @ self.v + self.b, -30, 30)))

    def fit(self, x: np.ndarray, at: np.ndarray, dense: np.ndarray, y: np.ndarray, rows: np.ndarray, allowed: np.ndarray, seed: int) -> Linear:
        """Adagrad over small batches of rows; only the allowed features get a weight."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(rows)
            for i in range(0, len(order), BATCH):
                take = order[i : i + BATCH]
                f, cut = _taken(x, at, take)
                sizes = np.diff(cut)
                err = (self.probability(f, cut, dense[take]) - y[take]) / len(take)
                g = np.bincount(f, weights=np.repeat(err / np.sqrt(np.maximum(sizes, 1)), sizes), minlength=len(self.w)) * allowed + DECAY * self.w
                gw += g * g
                self.w -= RATE * g / np.sqrt(gw)
                g = err @ dense[take]
                gv += g * g
                self.v -= RATE * g / np.sqrt(gv)
                gb += err.sum() ** 2
                self.b -= RATE * err.sum() / np.sqrt(gb)
        return self


class Chain:
    """Models of the categories in order, the number of each feature that they read, and the threshold of the last one."""

    def __init__(self, models: list[Linear], place: np.ndarray, threshold: float):
        self.models, self.place, self.threshold = models, place, threshold

    def probabilities(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.zeros((len(at) - 1, len(self.models)))
        for j, m in enumerate(self.models):
            p[:, j] = m.probability(x, at, p[:, :j])
        return p


def contrast(toxic: np.ndarray, others: np.ndarray, n_toxic: int, n_others: int) -> np.ndarray:
    """The log odds ratio of each feature between the two sets of documents, in standard deviations."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, others + 0.5, n_others - others + 0.5
    return (np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def chosen_features(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which features a model may read, for each fold that it doesn't see, and last for that of all.

    counts: documents by fold, toxic, feature; sizes: by fold, toxic.
    """
    out = np.zeros((FOLDS + 1, counts.shape[2]), bool)
    for f in range(FOLDS + 1):
        seen = np.arange(FOLDS) != f
        c, n = counts[seen].sum(axis=0), sizes[seen].sum(axis=0)
        score = np.where(c.sum(axis=0) >= LEAST_DOCS, np.abs(contrast(c[1], c[0], n[1], n[0])), 0.0)
        best = np.argsort(-score, kind="stable")[:FEATURES]
        out[f, best[score[best] > 0]] = True
    return out


def kinds(x: np.ndarray, at: np.ndarray, toxic: np.ndarray, score: np.ndarray) -> np.ndarray:
    """A column of 0 and 1 for each of KINDS groups of toxic documents, the largest first.

    Spherical k-means over the markers; the first centre is the document with most of them, each next one the document
    that is least like the centres before it. A document without markers is in no group.
    """
    n, out = len(at) - 1, np.zeros((len(at) - 1, KINDS))
    marks = np.argsort(-score, kind="stable")[:MARKERS]
    marks = marks[score[marks] >= CONTRAST]
    where = np.full(len(score), -1)
    where[marks] = np.arange(len(marks))
    table = np.zeros((n, len(marks)))
    row, col = np.repeat(np.arange(n), np.diff(at)), where[x]
    table[row[col >= 0], col[col >= 0]] = 1.0
    rows = np.flatnonzero((toxic > 0) & (table.sum(axis=1) > 0))
    if not len(rows):
        return out
    t = table[rows] / np.linalg.norm(table[rows], axis=1, keepdims=True)
    centres = [t[int(np.argmax(table[rows].sum(axis=1)))]]
    while len(centres) < min(KINDS, len(rows)):
        centres.append(t[int(np.argmin(np.max(t @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(25):
        own = np.argmax(t @ c.T, axis=1)
        sums = np.array([t[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    order = np.argsort(-np.bincount(own, minlength=len(c)), kind="stable")
    for j, k in enumerate(order.tolist()):
        out[rows[own == k], j] = 1.0
    return out


class Training:
    """The labelled documents: features by row, folds, targets, and what each model may read."""

    def __init__(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, fold: np.ndarray, allowed: np.ndarray):
        self.x, self.at, self.y, self.fold, self.allowed = x, at, y, fold, allowed

    def fitted(self, j: int, f: int, before: np.ndarray) -> tuple[Linear, np.ndarray]:
        """The model of category j that doesn't see fold f, and what it predicts for that fold; before: the
        out-of-fold probabilities of the categories before. FOLDS stands for no fold."""
        seen, held = np.flatnonzero(self.fold != f), np.flatnonzero(self.fold == f)
        m = Linear(self.allowed.shape[1], j).fit(self.x, self.at, before, self.y[:, j], seen, self.allowed[f], f)
        return m, m.probability(*_taken(self.x, self.at, held), before[held])


def fit_chain(spark: SparkSession, data: Training, place: np.ndarray) -> Chain:
    """The chain, a category after the other; the threshold is the one with the best F1 out of fold."""
    n, k = data.y.shape
    out, models = np.zeros((n, k)), []
    shared = spark.sparkContext.broadcast(data)  # as large as what was collected
    for j in range(k):
        before = out[:, :j].copy()

        def fit(batches: Iterator[pa.RecordBatch], j: int = j, before: np.ndarray = before) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f in batch.column(0).to_pylist():
                    m, p = shared.value.fitted(j, f, before)
                    yield pa.RecordBatch.from_arrays([pa.array([f]), *(pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in (m.w, np.r_[m.v, m.b], p))], names=["fold", "w", "v", "p"])

        tasks = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "fold long, w binary, v binary, p binary")
        for r in tasks.collect():  # FOLDS + 1 rows
            w, v, p = (np.frombuffer(r[c], "<f8") for c in ("w", "v", "p"))
            if r["fold"] < FOLDS:
                out[data.fold == r["fold"], j] = p
            else:
                m = Linear(len(w), j)
                m.w, m.v, m.b = w, v[:-1], float(v[-1])
                models.append(m)
    order = np.argsort(-out[:, -1], kind="stable")
    hit = np.cumsum(data.y[order, -1])
    f1 = 2 * hit / (np.arange(1, n + 1) + max(hit[-1] if n else 0, 1e-9))
    best = int(np.argmax(f1)) if n and hit[-1] else -1
    if best < 0:
        return Chain(models, place, 2.0)
    after = out[order[best + 1], -1] if best + 1 < n else 0.0
    return Chain(models, place, float((out[order[best], -1] + after) / 2))


def _counted(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by fold, toxic and feature, and by fold and toxic; held: (fold, toxic, text)."""
    cells = FOLDS * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, 1 << HASH_BITS), np.int32)
        for batch in batches:
            for part in text_slices(batch, "text"):
                x, at = text_features(part)
                cell = part.batch.column("fold").to_numpy() * 2 + part.batch.column("toxic").to_numpy()
                np.add.at(total, (np.repeat(cell, np.diff(at)), x), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used].astype(np.int64))], names=["place", "n"])

    rows = held.select("fold", "toxic", "text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a cell and feature at most
    counts = np.zeros(cells << HASH_BITS, np.int64)
    counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    sizes = np.zeros(cells, np.int64)
    for r in held.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"] * 2 + r["toxic"]] = r["count"]
    return counts.reshape(FOLDS, 2, -1), sizes.reshape(FOLDS, 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_TRAINING) -> Chain | None:
    """The chain fitted on at most `limit` labelled documents; None if no document is labelled.

    A document with several labels counts as toxic if one says so; of rows with one id the one with the smallest hash of
    its text counts. Rows with a null id or label don't count. Whole texts are read; of each document at most
    (FOLDS + 1) * FEATURES features reach the driver, as 16-bit numbers.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # At most `limit` rows of two integers.
    held = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    held = materialise(held.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int")), "labelled")
    counts, sizes = _counted(held)
    if not sizes.sum():
        return None
    allowed = chosen_features(counts, sizes)
    used = np.flatnonzero(allowed.any(axis=0))
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = spark.sparkContext.broadcast(place)

    def work(part: TextSlice) -> list[pa.Array]:
        x, at = text_features(part, shared.value)
        cut, raw = (at * 2).tolist(), x.astype("<u2").tobytes()
        return [pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]

    rows = per_text(held, ["doc_id", "toxic", "fold"], "text", "features binary", work).toArrow().sort_by("doc_id")
    raw = rows.column("features").to_pylist()
    x, at = np.frombuffer(b"".join(raw), "<u2").astype(np.int32), np.r_[0, np.cumsum([len(r) // 2 for r in raw])].astype(np.int64)
    toxic = rows.column("toxic").to_numpy().astype(np.float64)
    (c, n), own = (counts[:, :, used].sum(axis=0), sizes.sum(axis=0)), allowed[:, used]
    y = np.column_stack([kinds(x, at, toxic, np.where(own[FOLDS], contrast(c[1], c[0], n[1], n[0]), 0.0)), toxic])
    return fit_chain(spark, Training(x, at, y, rows.column("fold").to_numpy(), own), place)


def score(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_kind_1 to p_kind_4, p_toxic, toxic) of each row of docs.

    toxic: p_toxic reaches the chain's threshold. Without a chain all probabilities are null and toxic is false. A null
    or empty text is scored by the models' constants and is never toxic, nor is one without any feature that the models
    read. Null keys and repeated rows pass through; other columns aren't read. Equal texts score alike.
    """
    if chain is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col(f"`{key}`").alias(key), *(nothing.alias(f"p_{c}") for c in CATEGORIES), F.lit(False).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2^HASH_BITS numbers, and weights of (FOLDS + 1) * FEATURES features at most

    def work(part: TextSlice) -> list[pa.Array]:
        x, at = text_features(part, shared.value.place)
        p = shared.value.probabilities(x, at)
        toxic = (p[:, -1] >= shared.value.threshold) & (np.diff(at) > 0)
        return [*(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(toxic)]

    return per_text(docs, [key], text, ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean", work)
