import re

import duckdb

from quarry.llm import license_scan as s


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in s.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    best, more = 0.0, set()
    for label, t in s.TEMPLATES:
        step = s.step_of(t)
        for b in range(0, len(w), step):
            held = set(w[b : b + 2 * step])
            body = set(t.split())
            share = len(held & body) / len(body)
            if share >= s.THRESHOLD - 1e-9:
                best, more = max(best, share), more | {label}
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if at else best


TEXTS = {
    1: "Released under the MIT License. cc by cc by", 2: "x " * 70 + s.TEMPLATES[0][1].upper() + " y" * 70, 3: None, 4: "", 5: "...", 6: "GNU general-public\nLICENSE", 7: "worK is licensed under a creative commons attribution 4 0",
    8: "İ Apache License MİT license", 9: "redistribution and use in source and binary forms, with modification, are permitted provided that the conditions are", 10: "z " * 31 + " ".join(s.TEMPLATES[5][1].split()[:28]),
    11: "apache " * 300 + "license", 12: "é licensed apache version 2 0 license",
    13: "q " * 250 + max((t for _, t in s.TEMPLATES), key=len) + " q" * 40,
}


def test_equals_plain_scan(spark):
    df = spark.createDataFrame([*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[2])], "doc_id long, text string")
    rows = s.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[2 if r["doc_id"] is None else r["doc_id"]]
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        assert got == plain(text), (r["doc_id"], got, plain(text))


def test_equals_sql(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates")
    want = sorted(con.sql(s.oracle_sql()).project(", ".join(cols)).fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in s.scan(df).collect()) == want


def test_templates_of_any_length(spark):
    long = " ".join(f"v{i}" for i in range(200))
    huge = " ".join(f"u{i}" for i in range(3000))
    texts = {1: "x " * 200 + long, 2: "x " * 131 + " ".join(f"v{i}" for i in range(30, 200)) + " y" * 99, 3: " ".join(f"v{i}" for i in range(150)), 4: "z " * 3500 + huge + " z", 5: huge[: len(huge) // 2]}
    rows = s.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), [("long", long), ("huge", huge)]).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "long", 2: "long", 3: "", 4: "huge", 5: ""}
    assert s.step_of("a") == s.step_of("a " * 32) == 32 and s.step_of("a " * 33) == 64 and s.step_of(long) == 256


def test_odd_input(odd_docs, no_docs):
    rows = s.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"]: r["n_words"] for r in rows}[6] == 60_000
    assert s.scan(no_docs).collect() == []
    assert s.scan(odd_docs, templates=[]).count() == odd_docs.count()
