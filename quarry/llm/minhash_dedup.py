"""MinHash near-dedup with odd sketches.

Each document's distinct word shingles give MinHash samples. Groups of samples are the keys of bands, in which
candidates meet; parity bitmaps of all samples (odd sketches) estimate the similarity of candidates from the
population count of an XOR; what may be linked is confirmed on the full sets.

With 36 bands of 5 samples a pair at the threshold of 0.8 fails to meet with a probability below 1e-6. The sketches'
bounds lose a link only if they take one of its ends for close to the leader and the other for far from it: of a pair
at the threshold that lies as badly as the distances allow, with a probability of 1.3e-4 in each of its buckets.

Members of a band's bucket are compared with its leader first. All links of one that the sketch puts close to it lead
to members not too far from it, as Jaccard's distance is a metric: these form the leader's canopy. A leader's canopy is
the same in all bands, so it is confirmed once. Those that aren't close are then compared with each other in their
buckets. Both are done in blocks of bounded size that multiply 0/1 matrices and only give links that join components:
a group of thousands of near copies never emits its pairs, and no link that joins components is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TextSlice, materialise, mix, per_text, shingle_hashes, spread_join, word_hashes, words
from .graph import components

BANDS, ROWS, BITS = 36, 5, 512
SAMPLES = BANDS * ROWS
_rng = np.random.default_rng(99)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_ROWS_AT_ONCE = 2048
#: What is compared in one task, about: so many documents, of which one counts once more for each WEIGHT shingles; a
#: hash deals them out.
BLOCK, WEIGHT = 512, 4096
_COLUMNS = 4096


def minhash(items: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set of 64-bit hashes."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _ROWS_AT_ONCE):
        np.minimum(low, (x[i : i + _ROWS_AT_ONCE, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """For each row of samples a bitmap of BITS in which each sample turned one bit over, as 64-bit words."""
    bit = (mix(samples.astype(np.uint64) + _SALT) % np.uint64(BITS)).astype(np.int64)
    flips = np.zeros((len(samples), BITS), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """The population count of the XOR at which the estimate is this similarity."""
    return math.floor(BITS / 2 * (1 - math.exp(-(1 - similarity) * 4 * SAMPLES / BITS)))


def signatures(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_a, set_b, bands, sketch) of each row; set_a and set_b hash the whole set."""

    def work(part: TextSlice) -> list[pa.Array]:
        data, at = part.flat()
        data = LOWER[data]
        starts, ends, bounds = words(data, at)
        sets = shingle_hashes(word_hashes(data, starts, ends), bounds, shingle)
        samples = np.stack([minhash(s) for s in sets])
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + samples[:, r::ROWS].astype(np.uint64) + _SALT[:BANDS])
        sums = [[int(np.add.reduce(mix(s ^ salt)).astype(np.int64)) if len(s) else 0 for s in sets] for salt in _SALT[:2]]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists(keys), lists(odd_sketches(samples))]

    return per_text(docs, [key], text, "n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>", work)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sorted sets."""
    _, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float64)
    cuts, sides = np.r_[0, np.cumsum([len(x) for x in [*left, *right]])], []
    for n, first in ((len(left), 0), (len(right), len(left))):
        at = place[cuts[first] : cuts[first + n]]
        row = np.repeat(np.arange(n), np.diff(cuts[first : first + n + 1]))
        by = np.argsort(at, kind="stable")
        sides.append((at[by], row[by], n))
    # So many shingles at once that the matrices stay small.
    for low in range(0, int(place.max()) + 1 if len(place) else 0, _COLUMNS):
        dense = []
        for at, row, n in sides:
            a, b = np.searchsorted(at, (low, low + _COLUMNS))
            m = np.zeros((n, _COLUMNS), np.float32)
            m[row[a:b], at[a:b] - low] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _stars(pairs: np.ndarray, labels: list[int]) -> list[tuple[int, int]]:
    """(label, smallest label) of all labels that links (pairs of places) join with a smaller one."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            top[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in top]


def _linker(percent: int):
    """Labels that links join, of a group (side, label, items): among side 0, and between it and side 1."""

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        label = group.column("label").to_pylist()
        lists = group.column("items").chunk(0) if group.num_rows else pa.array([], pa.list_(pa.int64()))
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        rows = np.flatnonzero(side == 0)
        columns = np.flatnonzero(side == 1) if (side == 1).any() else rows
        n = np.diff(at).astype(np.int64)
        both = shared_counts([sets[i] for i in rows], [sets[i] for i in columns])
        good = np.argwhere(100 * both >= percent * (n[rows][:, None] + n[columns][None, :] - both))
        found = _stars(np.stack([rows[good[:, 0]], columns[good[:, 1]]], axis=1), label)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def item_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the sorted hashes of each text's distinct shingles."""

    def work(part: TextSlice) -> list[pa.Array]:
        data, at = part.flat()
        data = LOWER[data]
        starts, ends, bounds = words(data, at)
        sets = shingle_hashes(word_hashes(data, starts, ends), bounds, shingle)
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        # Sorted as the signed numbers that Arrow and Spark hold.
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.sort(s.view(np.int64)) for s in sets])))]

    return per_text(docs, ["node"], "text", "items array<long>", work)


def _meet(keyed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The canopies (leader, node, weight) of the leaders of all buckets, leaders included, and the rows (bucket, node,
    weight) of keyed (bucket, node, sketch, weight) that aren't close to their leader, so that their links may lie
    outside its canopy. Buckets of one node are left out."""
    step = 1 - percent / 100
    tight, loose = most_odd_bits(1 - 2 * step + 0.05), most_odd_bits(max(1 - 3 * step - 0.25, 0.05))
    odd = F.expr(" + ".join(f"bit_count(sketch[{i}] ^ s.sketch[{i}])" for i in range(BITS // 64)))
    leaders = keyed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "sketch")).alias("s"), F.max("node").alias("most"), F.min("node").alias("least"), F.count("*").alias("n"))
    leaders = materialise(leaders.where("least < most").select("bucket", "s", "n"), "leaders")
    rows = leaders.agg(F.sum("n")).first()[0] or 0
    met = spread_join(keyed, leaders, ["bucket"], rows)
    met = materialise(met.select("bucket", "node", "weight", F.col("s.node").alias("leader"), odd.alias("odd")), "met")
    groups = met.where(f"odd <= {loose}").select("leader", "node", "weight").distinct()  # a leader is close to itself
    return materialise(groups, "canopies"), met.where(f"odd > {tight}").select("bucket", "node", "weight")


def _refined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) after links between components."""
    if edges.isEmpty():
        return parts
    joined = materialise(components(edges), "components")
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    known = parts.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return materialise(known.union(joined.join(parts, "node", "left_anti")), "parts")


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, "node", "left").select(*rows.columns, F.coalesce("component", "node").alias("label"))


def _confirmed(groups: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """parts (node, component), with all joined that is linked within a group of groups (part, node, weight).

    A part of up to about BLOCK is compared in one task. A larger one is dealt into blocks; then what isn't in its
    largest component yet is compared with all of it, block by block.
    """
    schema = "a long, b long"
    sizes = groups.groupBy("part").agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    placed = spread_join(groups, sizes, ["part"], rows).select("part", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.lit(0).alias("side"))
    first = _labelled(placed, parts).join(sets, "node").select("part", "block", "side", "label", "items")
    parts = _refined(parts, materialise(first.groupBy("part", "block").applyInArrow(_linker(percent), schema).distinct(), "links"))
    large = materialise(_labelled(spread_join(groups, sizes.where("blocks > 1").select("part", "n"), ["part"], rows), parts), "large")
    if large.isEmpty():
        return parts
    by_label = large.groupBy("part", "label").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))
    core = by_label.groupBy("part").agg(F.max_by(F.struct("label", "weight"), F.struct("count", "label")).alias("c"), F.sum("weight").alias("all"), F.sum("count").alias("n"), F.count("*").alias("labels"))
    core = core.where("labels > 1").select("part", F.col("c.label").alias("core"), F.ceil(F.col("all") / BLOCK).alias("wide"), F.ceil((F.col("all") - F.col("c.weight")) / BLOCK).alias("high"), "n")
    known = spread_join(large, core, ["part"], rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    out = known.where("label != core").select("part", spot("high").alias("i"), every("wide").alias("j"), F.lit(0).alias("side"), "node", "label")
    whole = known.select("part", every("high").alias("i"), spot("wide").alias("j"), F.lit(1).alias("side"), "node", "label")
    second = out.union(whole).join(sets, "node").select("part", "i", "j", "side", "label", "items")
    return _refined(parts, materialise(second.groupBy("part", "i", "j").applyInArrow(_linker(percent), schema).distinct(), "links"))


def _components(keyed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The components (node, component) of what is linked among keyed (bucket, node, sketch, weight); texts: (node, text)."""
    groups, far = _meet(keyed, percent)
    wanted = groups.select("node").union(groups.select("leader")).union(far.select("node")).distinct()
    sets = materialise(item_sets(texts.where("text is not null").join(wanted, "node", "left_semi"), shingle).distinct(), "sets")
    none = keyed.sparkSession.createDataFrame([], "node long, component long")
    parts = _confirmed(groups.withColumnRenamed("leader", "part"), none, sets, percent)
    # Those far from their leader are compared with each other, in buckets where that can still join components.
    rest = materialise(_labelled(far, parts), "far")
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least < most").select("bucket", "n")
    mixed = materialise(mixed, "mixed")
    rest = materialise(spread_join(rest, mixed, ["bucket"], mixed.agg(F.sum("n")).first()[0] or 0).select(F.col("bucket").alias("part"), "node", "weight"), "far")
    return _confirmed(rest, parts, sets, percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs.

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased; a set holds the distinct
    shingles of so many words, or with fewer words the whole sequence as one. Two rows are linked if
    100 * intersection >= percent * union. component_id is the smallest key that links reach, itself included; kept
    says that it is the row's own.

    A null or empty text, or one without words, has no shingles and is linked with nothing. A row with a null key
    can't be named: it is linked with nothing, its component_id is null, and it is kept. Repeated rows fall into one
    component; kept is true for each of them if it is for one. Keys are integers. Other columns aren't read.
    """
    named = docs.select(F.col(f"`{key}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    sig = materialise(signatures(named, shingle, "node"), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    classes = sig.where("n_shingles > 0 and node is not null").groupBy(*same).agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    lead = F.col("node") == F.col("rep")
    # Only the class's first member goes on, so only its keys are kept.
    rows = materialise(
        spread_join(sig, classes, same, sig.count(), "left").select(
            "node", "n_shingles", F.when(F.col("node").isNotNull(), F.col("rep")).alias("rep"), F.when(lead, F.col("bands")).alias("bands"), F.when(lead, F.col("sketch")).alias("sketch")
        ),
        "classes",
    )
    weight = (1 + F.floor(F.col("n_shingles") / WEIGHT)).alias("weight")
    keyed = rows.where("bands is not null").select("node", "sketch", weight, F.explode("bands").alias("bucket"))
    parts = _components(keyed, named, shingle, percent).withColumnRenamed("node", "rep")
    found = rows.select("node", "n_shingles", "rep").join(parts, "rep", "left")
    component = F.coalesce("component", "rep", "node")
    return found.select(F.col("node").alias(key), "n_shingles", component.alias("component_id"), (F.col("node").isNull() | (F.col("node") == component)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs: that with the smallest key, a null key last.

    Groups are those of near_duplicates() over rows, not keys: rows with one key but different texts are told apart, of
    rows that repeat one stays, and rows with a null key count like others. Rows whose text is null, empty or without
    words all stay. Of the texts only sets travel; rows are taken out by their numbers.
    """
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    # Written once, so that a row keeps its number.
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    found = near_duplicates(numbered, shingle, percent, row, text).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    named = found.join(numbered.select(F.col(row).alias("r"), F.col(f"`{key}`").cast("long").alias("k")), "r")
    named = materialise(named, "named")
    first = named.groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("z"), "k", "r"))["r"].alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first, "first")
    gone = spread_join(named, first, ["c"], first.agg(F.sum("n")).first()[0] or 0).where("r != first").select(F.col("r").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(table: str = "documents", percent: int = 80) -> str:
    """The same for two-word shingles in DuckDB, comparing all pairs that share a shingle; doc_id is a key."""
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from {table}),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) = 1 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
link as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * common >= {percent} * (p.n + q.n - common)),
step as (select a, b from link union all select b, a from link),
reach(doc_id, top) as (select a, b from step union select reach.doc_id, step.b from reach join step on step.a = reach.top),
low as (select doc_id, least(doc_id, min(top)) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from {table} left join n using (doc_id) left join low using (doc_id)"""
