import brute
import pytest
from conftest import words

import corpus_pipeline as p
from quarry.llm import sentencepiece_bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark: clean texts, copies, near copies, junk, a benchmark passage, personal data."""
    sf = str(tmp_path_factory.mktemp("sf"))
    texts = {i: " ".join(words(120, i, 10**6)) for i in range(30)}
    texts |= {30: texts[0], 31: texts[1] + " end", 32: "short text", 33: "same words here " * 40, 34: texts[2] + " " + " ".join(words(30, 999, 10**6)) + " tail", 35: " ".join(words(60, 35, 10**6)) + " a.b@c.org", 36: None}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(None, " ".join(words(90, 77, 10**6)), None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, " ".join(words(30, 999, 10**6)))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, texts


def test_stages_equal_plain_versions(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, {i: t for i, t in texts.items()}

    docs = p.quality(spark, docs, sf)
    counts = {i: brute.quality_counts(t) for i, t in left.items()}
    left = {i: t for i, t in left.items() if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]}
    assert {r["doc_id"] for r in docs.collect()} == set(left) | {None}

    docs = p.near_dedup(spark, docs, sf)
    groups = brute.components(left, 5)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    assert {r["doc_id"] for r in docs.collect()} == set(left) | {None} and 30 not in left and 31 not in left

    docs = p.benchmark_free(spark, docs, sf)
    del left[34]
    assert {r["doc_id"] for r in docs.collect()} == set(left) | {None}

    docs = p.personal_data(spark, docs, sf)
    left[35] = left[35].replace("a.b@c.org", "[EMAIL]")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and all(rows[i]["text"] == t and rows[i]["n_chars"] == len(t) for i, t in left.items())

    library = sentencepiece_bpe.load(p.tokenizer_path("piece_bpe_32k.model")).lib
    out = {r["doc_id"]: r for r in p.encode(spark, docs, sf).collect()}
    assert all(out[i]["ids"] == library.encode(t, add_bos=True, add_eos=True) and out[i]["decoded"] == t for i, t in left.items())


def test_run_applies_all_stages(spark, folder):
    sf, _ = folder
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == set(range(30)) | {35, None}


def test_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_stay(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as found_items", "2 as quality_badness", "3 as redacted", "4 as rep", "5 as `a.b`")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-5:] == ["found_items", "quality_badness", "redacted", "rep", "a.b"]
    assert docs.count() > 0


def test_two_texts_under_one_id(spark, folder):
    sf, texts = folder
    rows = [(1, texts[1], "en", "s", 1), (1, texts[5], "en", "s", 1), (1, texts[5], "en", "s", 1), (2, texts[6], None, None, None), (2, None, None, None, None), (2, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted([(1, texts[1]), (1, texts[5]), (2, texts[6])])
    kept = p.personal_data(spark, p.benchmark_free(spark, p.near_dedup(spark, spark.createDataFrame(rows[3:], "doc_id long, text string, lang string, source string, n_chars long"), sf), sf), sf)
    assert {(r["text"], r["n_chars"]) for r in kept.collect()} == {(texts[6], len(texts[6])), (None, None), ("", 0)}
