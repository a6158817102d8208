import numpy as np
import pytest

from quarry.llm import token_counts as t


def test_ends_across_blocks(spark):
    end, rows, want = 9, [], {}
    for shard in range(3):
        ids = np.random.default_rng(shard).integers(0, 10, 500)
        cuts = np.flatnonzero(ids == end)
        starts, stops = np.r_[0, cuts + 1], np.r_[cuts, 500]
        want |= {(shard, i): (int(a), int(b - a), i < len(cuts)) for i, (a, b) in enumerate(zip(starts, stops, strict=True)) if i < len(cuts) or a < 500}
        for b in range(0, 500, 37):
            rows.append((shard, b // 37, ids[b : b + 37].astype("<u4").tobytes()))
    rows += [(0, 99, b""), (7, 0, None)]
    df = spark.createDataFrame(rows, "shard long, block int, payload binary")
    got = {(r["shard"], r["nth"]): (r["start"], r["n_tokens"], r["finished"]) for r in t.count_tokens(df, end).collect()}
    assert got == want


@pytest.mark.parametrize("block", [5, 64, 1 << 18])
def test_named_counts(odd_docs, no_docs, tok, block):
    import public_tokenizers

    ranks, pattern = tok("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = t._encoding(ranks, pattern)
    docs = odd_docs.where("doc_id is null or doc_id not in (6, 7)") if block == 5 else odd_docs
    blocks = t.write_flat(docs, ranks, pattern, 50256, block_ids=block).select("shard", "block", "payload")
    want = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted(r["n_tokens"] for r in t.count_tokens(blocks, 50256).collect()) == want
    rows = t.named_counts(docs, ranks, pattern, 50256).collect()
    by = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert len(rows) == docs.count() and all(by[r["doc_id"]] == len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert t.named_counts(no_docs, ranks, pattern, 50256).collect() == []


def test_places_of_named_counts(odd_docs, tok):
    # Brute force from the written blocks: start and nth lead to each document's own ids.
    import public_tokenizers

    ranks, pattern = tok("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = t._encoding(ranks, pattern)
    files: dict = {}
    for r in t.write_flat(odd_docs, ranks, pattern, 50256).orderBy("shard", "block").collect():
        files.setdefault(r["shard"], []).append(np.frombuffer(r["payload"], "<u4"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    rows = t.named_counts(odd_docs, ranks, pattern, 50256).collect()
    for r in rows:
        ids = np.concatenate(files[r["shard"]])
        assert ids[r["start"] : r["start"] + r["n_tokens"]].tolist() == enc.encode_ordinary(texts[r["doc_id"]])
        assert ids[r["start"] + r["n_tokens"]] == 50256 and (ids[: r["start"]] == 50256).sum() == r["nth"]


def test_raw_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 9, 4], "<u4").tofile(tmp_path / "a.bin")
    for block in (1, 2, 3, 100):
        rows = t.count_tokens(t.read_raw(spark, str(tmp_path), block_ids=block), 9).orderBy("nth").collect()
        assert [(r["start"], r["n_tokens"], r["finished"]) for r in rows] == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 1, False)]
    (tmp_path / "empty.bin").write_bytes(b"")
    np.array([9] * 5, "<u4").tofile(tmp_path / "b.bin")
    assert t.count_tokens(t.read_raw(spark, str(tmp_path), block_ids=2), 9).count() == 9
    assert t.read_raw(spark, str(tmp_path), block_ids=2).count() == 7
    (tmp_path / "torn.bin").write_bytes(b"12345")
    with pytest.raises(ValueError, match="whole ids"):
        t.read_raw(spark, str(tmp_path))
