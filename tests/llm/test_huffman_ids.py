import heapq
import random
import zlib

import numpy as np
import pytest

from quarry.llm import huffman_ids as h


def cost(counts):
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5, 1), (127, 9), (128, 9), (129, 9), (1000, 50), (40_000, 5000)])
def test_round_trip(n, kinds):
    ids = np.array([random.Random(i).randrange(kinds) for i in range(n)], np.int64)
    lengths = h.code_lengths(np.bincount(ids, minlength=6000))
    bits, offsets = h.pack(ids, h.canonical_codes(lengths), lengths)
    assert (h.unpack(bits, offsets, n, h.decode_table(lengths)) == ids).all()


def test_lengths_are_optimal_and_limited():
    flat = np.array([random.Random(i).randrange(1, 100) for i in range(300)])
    assert (flat * h.code_lengths(flat)).sum() == cost(flat)
    steep = np.array([1 << i for i in range(40)])
    lengths = h.code_lengths(steep, 8).astype(float)
    assert lengths.max() <= 8 and (2.0 ** -lengths).sum() == 1


def test_files_hold_what_the_library_gives(spark, odd_docs, no_docs, tok):
    from tokenizers import Tokenizer

    path = tok("word_bpe_49k.json")
    rows = h.read_files(h.store(odd_docs, path, 1), values=True).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want = sorted(((r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), x[1]))
    assert [(r["doc_id"], r["ids"]) for r in rows] == want
    starts = np.r_[0, np.cumsum([len(x) for _, x in want])]
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert h.read_files(h.store(no_docs, path, 1)).collect() == []


def test_a_file_is_read_alone():
    ids = np.array([5, 5, 7, 5, 9, 9, 5] * 50, np.int64)
    lengths = h.code_lengths(np.bincount(ids, minlength=30))
    payload = h.write_file([3, None], np.array([100, 250]), ids, h.canonical_codes(lengths), lengths)
    other = h.code_lengths(np.bincount(ids + 1, minlength=30))
    second = h.write_file([4], np.array([350]), ids + 1, h.canonical_codes(other), other)
    read = h.FileReader()
    for p, keys, want in ((payload, [3, None], ids), (second, [4], ids + 1), (payload, [3, None], ids)):
        got = read(p)
        assert got[0] == keys and (got[2] == want).all()


def test_a_tokenizer_of_another_kind_gets_whole_texts(spark, odd_docs, tok):
    from tokenizers import Tokenizer

    path = tok("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = h.read_files(h.store(odd_docs, path, 50256), values=True).collect()
    want = sorted(((r["doc_id"] or 0), t.encode(r["text"] or "", add_special_tokens=False).ids + [50256]) for r in odd_docs.collect())
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in rows) == want


def test_long_units_are_not_kept(tok, monkeypatch):
    monkeypatch.setattr(h, "MOST_BYTES", 5000)
    e = h.TextEncoder(tok("word_bpe_49k.json"))
    assert e._by_units
    for i in range(6):
        text = (chr(97 + i) * 3000).encode()
        got, at = e(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)
        assert got[:-1].tolist() == e._tok.encode(text.decode(), add_special_tokens=False).ids and at[-1] == len(got)
    assert e._bytes <= 9000
