import random

import brute
from conftest import words

from quarry.llm import quality_rules as q


def test_features(spark):
    r = random.Random(1)
    texts = [" ".join(words(r.randrange(120), i, 30)) for i in range(40)] + ["a\nb\na\n\n \n \nb c\n a", "x x x x x x", "# $ é& <|>", "\t\v\f\r", "\x1c one \x85 two", None, ""]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for row in q.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect():
        want = brute.quality_counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row["kept"] == (not row["base_failed"]) and row["cutoff"] is None


def test_upper_bound_is_clopper_pearson():
    # With no failures the bound is 1 - error^(1/n); else the tail at the bound is the error.
    assert abs(q.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    from math import comb

    p = q.upper_bound(3, 50, 0.01)
    assert abs(sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) - 0.01) < 1e-9
    assert q.upper_bound(5, 5, 0.1) == q.upper_bound(0, 0, 0.1) == 1.0


def test_few_failures_is_the_binomial_tail():
    from math import exp, lgamma, log, log1p

    for n in (1, 7, 230, 5000):
        for bad in {0, 1, n // 50, n // 3, n - 1, n}:
            for p in (0.0, 0.001, 0.02, 0.4, 0.97, 1.0):
                want = 1.0 if bad >= n or p == 0 else 0.0 if p == 1 else sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(bad + 1))
                assert abs(q.few_failures(bad, n, p) - want) < 1e-9, (bad, n, p)


def test_equals_sql(spark):
    import duckdb

    r = random.Random(6)
    texts = [" ".join(words(r.randrange(40, 150), i, 60)) + r.choice(["", " # $ %", "\na b\na b\nc", " x y z x y z"]) * r.randrange(9) for i in range(900)] + [None, "", "é ü\n\né ü"]
    docs = spark.createDataFrame([(i, t, r.choice(["en", "en", "fr", "xx", None])) for i, t in enumerate(texts)] + [(None, texts[0], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(850)] + [(None, 1), (3, None)], "doc_id long, quality int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness", "cutoff"]
    by = lambda x: (x[0] is not None, x)
    want = sorted((tuple(x) for x in con.sql(q.oracle_sql()).project(", ".join(cols)).fetchall()), key=by)
    got = sorted((tuple(x[c] for c in cols) for x in q.judge(docs, labels).collect()), key=by)
    assert got == want and len({x[-1] for x in got}) > 1


def test_cutoff_holds_the_risk():
    assert q.cutoff({0: 50}, 0.02, 0.01) is None  # too few labels
    level = q.cutoff({0: 970, 300: 20, 900: 10}, 0.05, 0.01)
    assert level is not None and q.upper_bound(sum(n for s, n in {0: 970, 300: 20, 900: 10}.items() if s > level), 1000, 0.01) <= 0.05
    assert q.cutoff({0: 5000}, 0.02, 0.01) == 0
    # The risk holds over many draws: of so many holdouts hardly any gives a cutoff with a true risk above the limit.
    r, broken = random.Random(5), 0
    for _ in range(60):
        counts: dict = {}
        for _ in range(600):
            step = r.randrange(q.STEPS)
            counts[step] = counts.get(step, 0) + 1
        level = q.cutoff(counts, 0.05, 0.05)
        broken += level is not None and (q.STEPS - 1 - level) / q.STEPS > 0.05
    assert broken <= 9


def test_strata_and_keep(spark):
    good, bad = [" ".join(words(80, i)) for i in range(400)], ["# " * 30 + " ".join(words(80, i)) for i in range(20)]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(good + bad)] + [(None, good[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "2 as quality_n_words")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in q.judge(df, labels, max_risk=0.05).collect()}
    assert all(out[i]["kept"] for i in range(400)) and out[401]["cutoff"] is not None and out[400]["cutoff"] is None
    assert not any(out[i]["kept"] for i in range(401, 420, 2)) and all(out[i]["kept"] for i in range(400, 420, 2))
    kept = q.keep(df, labels, max_risk=0.05)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_odd_input(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.judge(odd_docs, none).count() == odd_docs.count()
    assert {r["doc_id"] for r in q.keep(odd_docs, none).collect()} == {6, 7}
    assert q.judge(no_docs, none).collect() == []
