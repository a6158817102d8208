import random

import numpy as np
from conftest import words

from quarry.llm import toxicity as t


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        w = words(r.randrange(60, 200), (seed, i).__hash__())
        for _ in range(r.randrange(3, 7) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "trash", "pathetic", "scum", "loser"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    train, held = corpus(900, 1), corpus(300, 2)
    docs = spark.createDataFrame([(i, x) for i, x, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    chain = t.train(docs, labels)
    rows = t.score(spark.createDataFrame([(i, x) for i, x, _ in held], "doc_id long, text string"), chain).collect()
    got = {r["doc_id"]: r for r in rows}
    assert np.mean([got[i]["toxic"] == bool(y) for i, _, y in held]) > 0.95


def test_kinds_come_from_the_data(spark):
    # Two vocabularies of abuse, in no word list: they share no category.
    abuse, rows, r = (["zorb", "quix", "vlem"], ["añefó", "añeít", "ñurré"]), [], random.Random(3)
    for i in range(600):
        w, own = words(80, i), None
        if i % 5 == 0:
            own = i // 5 % 2
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(abuse[own]))
        rows.append((i, " ".join(w), own))
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(own is not None)) for i, _, own in rows], "doc_id long, toxic int")
    got = {g["doc_id"]: g for g in t.score(docs, t.train(docs, labels)).collect()}
    top = [{max(range(1, 5), key=lambda k: got[i][f"p_kind_{k}"]) for i, _, own in rows if own == side} for side in (0, 1)]
    assert not top[0] & top[1]
    assert all(got[i]["toxic"] == (own is not None) for i, _, own in rows)


def training(y, n_features=5000):
    r = np.random.default_rng(1)
    x = np.concatenate([np.sort(np.r_[int(v[0]), r.choice(np.arange(10, n_features), 6, False)]) for v in y]).astype(np.int32)
    at, allowed = np.arange(0, len(x) + 1, 7), np.ones((t.FOLDS + 1, n_features), bool)
    return t.Training(x, at, y, np.arange(len(y)) % t.FOLDS, allowed)


def test_chain_uses_earlier_categories(spark):
    # The second label equals the first, which the features show only weakly to it: with out-of-fold inputs it follows.
    y = (np.random.default_rng(0).random((600, 1)) < 0.5).astype(float) @ np.ones((1, 2))
    data = training(y)
    chain = t.fit_chain(spark, data, np.arange(5000))
    assert chain.models[1].v[0] > 0
    assert ((chain.probabilities(data.x, data.at)[:, 1] >= chain.threshold) == y[:, 1]).mean() > 0.95


def test_inputs_are_out_of_fold(spark):
    # Brute force: each fold's inputs come from a model fitted on a table that doesn't hold the fold's rows at all.
    r = np.random.default_rng(4)
    y = (r.random((120, 2)) < 0.4).astype(float)
    data = training(y, 300)
    out = np.zeros(120)
    for f in range(t.FOLDS):
        seen, held = (np.flatnonzero(data.fold != f), np.flatnonzero(data.fold == f))
        take = lambda rows: (np.concatenate([data.x[data.at[i] : data.at[i + 1]] for i in rows]), np.arange(len(rows) + 1) * 7)
        m = t.Linear(300, 0)
        # fit() draws the order from the row numbers it is given, so the same draw is made on the smaller table.
        m.fit(*take(seen), np.zeros((len(seen), 0)), y[seen, 0], np.arange(len(seen)), data.allowed[f], f)
        out[held] = m.probability(*take(held), np.zeros((len(held), 0)))
    by_hand = t.Linear(300, 1).fit(data.x, data.at, out[:, None], y[:, 1], np.arange(120), data.allowed[t.FOLDS], t.FOLDS)
    chain = t.fit_chain(spark, data, np.arange(300))
    assert np.allclose(chain.models[1].w, by_hand.w) and np.allclose(chain.models[1].v, by_hand.v)


def test_features_are_chosen_without_the_held_out_fold():
    r = np.random.default_rng(2)
    counts, sizes = r.integers(0, 50, (t.FOLDS, 2, 5000)), np.full((t.FOLDS, 2), 60)
    other = counts.copy()
    other[0] = 0
    assert (t.chosen_features(counts, sizes)[0] == t.chosen_features(other, sizes)[0]).all()


def test_repeated_ids_count_once(spark):
    rows = corpus(200, 5)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    many = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3"))
    a, b = t.train(docs, labels), t.train(many, labels)
    assert a.threshold == b.threshold and all((m.w == n.w).all() for m, n in zip(a.models, b.models, strict=True))


def test_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 0), (9, None), (None, 1), (777, 1)], "doc_id long, toxic int")
    rows = t.score(odd_docs, t.train(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count()
    assert not any(r["toxic"] for r in rows if r["doc_id"] in (3, 4, 5))
    assert t.train(odd_docs, labels.where("false")) is None and t.train(no_docs, labels) is None
    assert all(r["p_toxic"] is None and not r["toxic"] for r in t.score(odd_docs, None).collect())
    assert t.score(no_docs, None).collect() == []
