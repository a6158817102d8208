"""Quality rules with risk-controlled thresholds.

Two fixed rules reject short and repetitive texts. A third rejects a text whose badness exceeds the cutoff of its
stratum (language). The cutoff comes from the labelled documents: going down from the safest cutoff, a cutoff is
accepted while the exact (Clopper-Pearson) upper bound on the share of good documents that it would reject is at most
max_risk, and the last accepted one holds. Going in a fixed order needs no correction within a stratum; over the
strata the error level is divided by their number (Bonferroni), so with probability 1 - error no stratum loses more
than max_risk of its good documents to the third rule. The guarantee is on that rule alone: good documents that a fixed
rule rejects are neither counted nor bounded. A stratum with too few labels for that has no cutoff, and keeps its documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, TextSlice, materialise, mix, per_text, word_hashes, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
#: The rest of the languages, and null, form one stratum.
STRATA = ("en", "fr", "de", "es")
MAX_RISK, ERROR = 0.02, 0.05
#: Badness is counted in so many steps.
STEPS = 1000


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def text_features(part: TextSlice) -> dict[str, np.ndarray]:
    """The counts of each row of a slice."""
    data, at = part.flat()
    rows = part.rows
    starts, ends, bounds = words(data, at)
    inside = ~SPACE[data]
    out = {"n_words": np.diff(bounds), "word_chars": _sums(inside & ((data & 0xC0) != 0x80), at), "n_symbols": _sums(_SYMBOL[data], at)}

    # Lines with a word that equal an earlier line of the row.
    ls, le, lb = words(data, at, _NEWLINE)
    line_row = np.repeat(np.arange(rows), np.diff(lb))
    has_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=has_word[1:])
    real = has_word[le] > has_word[ls]
    line_row = line_row[real]
    key = mix(word_hashes(data, ls[real], le[real]) + mix(line_row.astype(np.uint64) + np.uint64(1)))
    first = np.unique(key, return_index=True)[1]
    lines = np.bincount(line_row, minlength=rows)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(line_row[first], minlength=rows)

    # Words in three-word windows that a row has twice or more.
    h = word_hashes(data, starts, ends)
    row_of = np.repeat(np.arange(rows), np.diff(bounds))
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = np.flatnonzero(row_of[2:] == row_of[:-2])
        window = mix(mix(mix(h[whole]) + h[whole + 1]) + h[whole + 2]) + mix(row_of[whole].astype(np.uint64) + np.uint64(1))
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = whole[times[back] > 1]
        for j in range(3):
            covered[twice + j] = True
    out["n_repeat_words"] = np.bincount(row_of[covered], minlength=rows)
    return {k: v.astype(np.int64) for k, v in out.items()}


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, keys: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and badness of each row.

    badness is in steps: the largest of the shares of symbols among characters (doubled), of repeated lines among
    lines and of repeated words among words.
    """

    def work(part: TextSlice) -> list[pa.Array]:
        f = text_features(part)
        share = lambda a, b: a / np.maximum(b, 1)
        badness = np.maximum.reduce([2 * share(f["n_symbols"], f["word_chars"]), share(f["n_dup_lines"], f["n_lines"]), share(f["n_repeat_words"], f["n_words"])])
        failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
        steps = np.minimum(np.floor(badness * STEPS), STEPS).astype(np.int32)
        return [*(pa.array(f[n]) for n in _FEATURES), pa.array(failed), pa.array(steps)]

    schema = ", ".join([*(f"{prefix}{n} long" for n in _FEATURES), f"{prefix}base_failed boolean", f"{prefix}badness int"])
    return per_text(docs, keys, text, schema, work)


def few_failures(bad: int, n: int, p: float) -> float:
    """The probability of at most `bad` failures in n trials of rate p: the regularised incomplete beta function
    I(1 - p; n - bad, bad + 1) by its continued fraction, whose steps grow with the square root of n."""
    if bad >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = float(n - bad), bad + 1.0, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total, m = d, 1
    while True:
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14 or m > 10 * math.isqrt(n) + 1000:
            break
        m += 1
    return 1 - front * total if flip else front * total


def upper_bound(bad: int, n: int, error: float) -> float:
    """The largest rate at which so few failures (bad of n) still have a probability of at least error."""
    if n == 0 or bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if few_failures(bad, n, p) > error else (low, p)
    return high


def cutoff(counts: dict[int, int], max_risk: float, error: float) -> int | None:
    """The lowest badness above which documents may go; counts: good labelled documents by badness.

    The upper bound is at most max_risk where so few rejections have a probability of at most error at that rate, which
    is asked once for each number of rejections.
    """
    n, rejected, asked, best = sum(counts.values()), 0, -1, None
    for step in range(STEPS, -1, -1):
        # Going from the cutoff `step` to the one below also rejects those at that step.
        if rejected != asked:
            if n == 0 or few_failures(rejected, n, max_risk) > error:
                break
            asked = rejected
        best = step
        rejected += counts.get(step, 0)
    return best


def cutoffs(found: DataFrame, labels: DataFrame, key: str, stratum: str, strata: tuple[str, ...], max_risk: float, error: float) -> dict[str | None, int]:
    """The cutoff of each stratum that has one; None stands for the remaining values."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct()
    # Documents that a fixed rule rejects are no evidence on the third.
    held = found.where("not base_failed").join(good, F.col(key) == F.col("good"), "left_semi")
    group = F.when(F.col(stratum).isin(*strata), F.col(stratum))
    rows = held.groupBy(group.alias("stratum"), "badness").count().collect()  # (strata + 1) x (STEPS + 1) rows at most
    counts: dict[str | None, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["badness"]] = r["count"]
    levels = {s: cutoff(c, max_risk, error / (len(strata) + 1)) for s, c in counts.items()}
    return {s: v for s, v in levels.items() if v is not None}


def _verdict(limits: dict[str | None, int], stratum: str, strata: tuple[str, ...], prefix: str = "") -> tuple[Column, Column]:
    """The cutoff of a row's stratum, and whether the row is kept."""
    limit = F.lit(limits.get(None)).cast("int")
    for s in strata:
        limit = F.when(F.col(f"`{stratum}`") == s, F.lit(limits.get(s)).cast("int")).otherwise(limit)
    return limit, ~F.col(f"{prefix}base_failed") & ~F.coalesce(F.col(f"{prefix}badness") > limit, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", strata: tuple[str, ...] = STRATA, max_risk: float = MAX_RISK, error: float = ERROR) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, badness, cutoff).

    One row a row of docs. Words are runs of bytes other than space and \\t \\n \\v \\f \\r; counts are of the whole
    text, and a null text counts as empty. base_failed: under 50 words, or over half of the words repeat. kept:
    neither base_failed nor a badness over the stratum's cutoff (null: none). labels: (doc_id, quality), of which rows with
    quality 1 count, each document once; rows with nulls don't. Empty labels give no cutoffs. Repeated rows and null
    keys pass through; a null stratum counts with those that are not in strata. Other columns are not read.
    """
    found = materialise(features(docs, [key, stratum], text), "features")
    limit, kept = _verdict(cutoffs(found, labels, key, stratum, strata, max_risk, error), stratum, strata)
    return found.select(key, *_FEATURES, "base_failed", kept.alias("kept"), "badness", limit.alias("cutoff"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", strata: tuple[str, ...] = STRATA, max_risk: float = MAX_RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    The features are counted twice, for the cutoffs and beside the rows, which costs less than to shuffle all texts.
    """
    found = materialise(features(docs, [key, stratum], text), "features")
    limits = cutoffs(found, labels, key, stratum, strata, max_risk, error)
    prefix = "quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    _, kept = _verdict(limits, stratum, strata, prefix)
    return features(docs, docs.columns, text, prefix).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(table: str = "documents") -> str:
    """judge() with its defaults in DuckDB: doc_id is a key of labels; the binomial tail is summed term by term."""
    space = "\\x20\\x09-\\x0D"
    strata = ", ".join(f"'{s}'" for s in STRATA)
    return f"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from {table}),
w as (
  select r, doc_id, lang, t, regexp_extract_all(t, '[^{space}]+') as ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{space}]')) as ls
  from d),
win as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w, lateral (select unnest(range(1, len(ws) - 1)) as i) x),
twice as (select r, g from win group by all having count(*) > 1),
covered as (select r, count(distinct i + o) as n from win join twice using (r, g), (values (0), (1), (2)) v(o) group by r),
f as (
  select w.r, doc_id, lang, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from w left join covered using (r)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, case when lang in ({strata}) then lang end as s,
    least(floor(greatest(2 * (n_symbols / greatest(word_chars, 1)), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)) * {STEPS}), {STEPS})::int as badness
  from f),
good as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
c as (select s, badness, count(*) as n from b semi join good using (doc_id) where not base_failed group by all),
total as (select s, sum(n) as n from c group by s),
steps as (
  select total.s, step, any_value(total.n) as n, coalesce(sum(c.n), 0) as rejected
  from total cross join (select unnest(range(0, {STEPS + 1})) as step) x left join c on c.s is not distinct from total.s and badness > step group by all),
tail as (
  select s, n, rejected, list_sum(list_transform(range(0, rejected::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_RISK}) + (n - i) * ln(1 - {MAX_RISK})))) as p
  from (select distinct s, n, rejected from steps) x),
cut as (
  select steps.s, min(step)::int as cutoff from steps join tail on steps.s is not distinct from tail.s and steps.rejected = tail.rejected
  where p <= {ERROR} / {len(STRATA) + 1} group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(badness > cutoff, false) as kept, badness, cutoff
from b left join cut on b.s is not distinct from cut.s"""
