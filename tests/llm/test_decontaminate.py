import random
import re
from collections import Counter

import numpy as np
from conftest import words

from quarry.llm import decontaminate as d


def bag(w, k):
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def plain(docs, items):
    """{(doc, item): (start, n, similarity)} comparing all windows with all items."""
    out = {}
    for i, t in docs.items():
        w = tokens(t)
        for item, text in items:
            own = tokens(text)
            n = len(own)
            k = min(5, n)
            if not n or len(w) < k:
                continue
            size = min(n, len(w))
            for a in range(len(w) - size + 1):
                x, y = bag(w[a : a + size], k) if size >= k else Counter(), bag(own, k)
                both = sum((x & y).values())
                s = both / (sum(x.values()) + sum(y.values()) - both)
                if s >= 0.8 - 1e-9 and s > out.get((i, item), (0, 0, -1))[2]:
                    out[i, item] = (a, size, s)
    return out


def make():
    r = random.Random(8)
    items = [(i, " ".join(words(r.randrange(14, 60), 100 + i))) for i in range(25)] + [(25, "too short"), (26, "one"), (27, ""), (28, "again and again and again and again and again and again")]
    docs = {i: " ".join(words(r.randrange(5, 200), i)) for i in range(40)}
    for i, (_, t) in enumerate(items[:25]):
        w = t.split()
        if i % 3 == 1:
            w[r.randrange(len(w))] = "changed"
        if i % 3 == 2:
            w = w[:-1]
        body = docs[i].split()
        at = r.randrange(len(body))
        docs[i] = " ".join(body[:at] + w + body[at:]).replace(" ", ",\n" if i % 2 else " ").upper()
    docs |= {50: items[3][1], 51: " ".join(items[4][1].split()[2:]), 52: None, 53: "", 54: "it was too short one", 55: "x " + items[28][1] + " y", 56: items[28][1] + " and again"}
    return docs, items


def test_equals_all_windows(spark):
    docs, items = make()
    df = spark.createDataFrame([*docs.items(), (50, docs[50])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (99, None), items[0]], "item_id long, text string")
    rows = d.matches(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"]) for r in rows}
    want = plain(docs, items)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert len(rows) == len(want) + sum(k[0] == 50 for k in want)
    clean = d.clean(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == set(docs) - {k[0] for k in want}


def test_case_of_any_script(spark):
    text = "Éai éonleeau pour ñez queê ça va über größe и так далее"
    df = spark.createDataFrame([(1, "X!! " + text.upper().replace("SS", "ß").replace(" ", "!! "))], "doc_id long, text string")
    assert [r["item_id"] for r in d.matches(df, spark.createDataFrame([(5, text)], "item_id long, text string")).collect()] == [5]


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    docs, items = make()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, d.matches(df, bench).collect()))
    monkeypatch.setattr(d, "PART_BYTES", 1500)
    assert sorted(map(tuple, d.matches(df, bench).collect())) == want


def test_clean_in_parts(spark, monkeypatch):
    docs, items = make()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(r["doc_id"] for r in d.clean(df, bench).collect())
    monkeypatch.setattr(d, "PART_BYTES", 1500)
    assert sorted(r["doc_id"] for r in d.clean(df, bench).collect()) == want


def fingerprints(items, n):
    return items.blocks[n].T.copy()


def test_all_fingerprints_within_the_radius_are_found():
    r = random.Random(2)
    items = d.Items([(i, " ".join(words(30, i))) for i in range(300)], 5, 0.8)
    every = np.unpackbits(fingerprints(items, 30).view(np.uint8), axis=1)
    for i in range(0, 300, 7):
        bits = every[i].copy()
        for b in r.sample(range(d.BITS), d.RADIUS):
            bits[b] ^= 1
        window, item = items.near(30, np.packbits(bits)[None].view(np.uint64))
        assert i in item and not window.any()
        assert item.tolist() == np.flatnonzero((every != bits).sum(axis=1) <= d.RADIUS).tolist()


def test_the_index_prunes():
    items = d.Items([(i, " ".join(words(30, i))) for i in range(2000)], 5, 0.8)
    others = d.Items([(i, " ".join(words(30, 10**6 + i))) for i in range(200)], 5, 0.8)
    window, _, _ = items.candidates(30, fingerprints(others, 30))
    assert len(window) < 0.01 * 200 * 2000
    assert sum(d.SHARES) + d.BLOCKS > d.RADIUS


def test_rolling_fingerprints_are_those_of_the_windows():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    rolled = d.fingerprints(h, 26)
    assert all((rolled[i] == d.fingerprints(h[i : i + 26], 26)[0]).all() for i in range(len(rolled)))


def test_memory_of_a_benchmark():
    import tracemalloc

    texts = [(i, " ".join(words(random.Random(i).randrange(20, 60), i, 10**6))) for i in range(5000)]
    size = sum(len(t) for _, t in texts)
    tracemalloc.start()
    items = d.Items(texts, 5, 0.8)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert items.ids and held < 8 * size


def test_odd_input(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.matches(odd_docs, bench).collect()}
    assert got == {(1, 1), (2, 1)}
    assert d.clean(odd_docs, bench).columns == odd_docs.columns
    assert d.matches(no_docs, bench).collect() == []
    none = bench.where("false")
    assert d.matches(odd_docs, none).collect() == [] and d.clean(odd_docs, none).count() == odd_docs.count()
