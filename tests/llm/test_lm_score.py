import random

import numpy as np

from quarry.llm import lm_score as m


def corpus(n):
    r = random.Random(3)
    follow = {i: [r.randrange(40) for _ in range(3)] for i in range(40)}
    out = []
    for _ in range(n):
        x, w = r.randrange(40), []
        for _ in range(80):
            w.append(f"t{x}")
            x = r.choice(follow[x])
        out.append(" ".join(w))
    return out


def test_real_order_scores_better_than_shuffled(spark):
    texts = corpus(150)
    model = m.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    r = random.Random(4)
    held = corpus(170)[150:]
    shuffled = [" ".join(r.sample(t.split(), 80)) for t in held]
    rows = m.score(spark.createDataFrame([(i, t) for i, t in enumerate(held + shuffled)], "doc_id long, text string"), model).collect()
    got = {x["doc_id"]: x["mean_log_probability"] for x in rows}
    assert all(got[i] > got[i + 20] + 1 for i in range(20))


def test_scores_are_sums_of_conditionals(spark):
    texts = ["a b c a b", "b c a", "", None, "z", "A  B\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = m.train(df)
    table = model.network.log_probabilities()
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    from quarry.llm.common import word_hashes, words

    def cls(w):
        data = np.frombuffer(w.lower().encode(), np.uint8)
        s, e, _ = words(data, np.array([0, len(data)]))
        return int(model.classes.of(word_hashes(data, s, e))[0])

    for r in m.score(df, model).collect():
        c = [0, *map(cls, (texts[r["doc_id"]] or "").split()), 0]
        want = sum(float(table[c[i - 1], c[i], c[i + 1]]) for i in range(1, len(c) - 1))
        assert r["n_tokens"] == len(c) - 2 and abs(r["pseudo_log_likelihood"] - want) < 1e-3
        assert (r["mean_log_probability"] is None) == (len(c) == 2)


def test_counts_cover_every_token(spark, odd_docs):
    classes = m.Classes(m.frequent_words(odd_docs))
    n = sum(len((r["text"] or "").encode().split()) for r in odd_docs.select("text").collect())
    assert m.context_counts(odd_docs, classes).sum() == n


def test_odd_input(odd_docs, no_docs):
    model = m.train(odd_docs)
    assert m.score(odd_docs, model).count() == odd_docs.count()
    assert m.score(no_docs, m.train(no_docs)).collect() == []


def test_words_and_contexts_beyond_the_classes_count(spark):
    r = random.Random(6)
    common = [f"w{i} " * (400 - i) for i in range(m.FREQUENT)]
    rare = [f"r{i}" for i in range(3000)]
    prose = [" ".join(r.choice(rare) for _ in range(60)) for _ in range(300)]
    odd = [" ".join(f"q{i}x{j}zzzz" for j in range(60)) for i in range(20)]
    texts = prose + common + odd + prose[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = m.train(df)
    got = {x["doc_id"]: x["mean_log_probability"] for x in m.score(df, model, seen=True).collect()}
    n = len(texts)
    # What occurs twice is predicted from its other place, and words of the corpus before words of one document.
    assert min(got[n - 20 + i] for i in range(20)) > max(got[i] for i in range(20, 300))
    assert min(got[i] for i in range(20, 300)) > max(got[n - 40 + i] for i in range(20))
    for i in range(20):
        assert got[i] == got[n - 20 + i]


def test_counts_equal_a_plain_count(spark):
    r = random.Random(7)
    texts = [" ".join(f"v{int(r.paretovariate(0.7)) % 400}" for _ in range(50)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = m.train(df)
    table = model.network.log_probabilities()
    from collections import Counter

    from quarry.llm.common import word_hashes, words

    def hashed(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return word_hashes(data, *words(data, np.array([0, len(data)]))[:2])

    every = {w for t in texts for w in t.split()}
    cls = {w: int(model.classes.of(hashed(w))[0]) for w in every} | {"": 0}
    shared = lambda w: cls[w] >= m.CLASSES - m.SHARED
    around, between, count, total, kinds = Counter(), Counter(), Counter(), Counter(), Counter(cls[w] for w in every)
    triples = [[(x[i - 1], x[i], x[i + 1]) for i in range(1, len(x) - 1)] for x in (["", *t.split(), ""] for t in texts)]
    for a, w, b in (y for x in triples for y in x):
        around[a, b] += 1
        between[a, cls[w], b] += 1
        count[w] += 1
        total[cls[w]] += 1
    for seen in (True, False):
        own = int(seen)
        for row in m.score(df, model, seen=seen).collect():
            want = 0.0
            for a, w, b in triples[row["doc_id"]]:
                p = np.exp(float(table[cls[a], cls[w], cls[b]]))
                if shared(a) or shared(b):
                    p = (between[a, cls[w], b] - own + m.PRIOR * p) / (around[a, b] - own + m.PRIOR)
                if shared(w):
                    weight = kinds[cls[w]] + 1
                    p *= (count[w] - own + weight * m.SHARED * 257.0 ** -(len(w) + 1)) / (total[cls[w]] - own + weight)
                want += np.log(p)
            assert abs(row["pseudo_log_likelihood"] - want) < 1e-3
