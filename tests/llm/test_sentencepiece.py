import hashlib
import random

import numpy as np
import pytest

from quarry.llm import sentencepiece_bpe as s


@pytest.fixture(scope="module")
def model(tok):
    return s.load(tok("piece_bpe_32k.model"))


def ids(model, texts):
    flat, at = model.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_equals_the_library(model):
    r = random.Random(3)
    pieces = [model.lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["", " ", "  a  b ", "\n\n x", "日本語 😀😀", "▁▁ab ▁", "a" * 999, "abababab aba " * 9, "\x00\t\r\n", "<s> </s> <0x41> <unk>", "a" + " " * 50 + "b", "=" * 77]
    texts += ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(r.choice("abnanestho ") for _ in range(300)) for _ in range(200)]
    want = model.lib.encode(texts, add_bos=True, add_eos=True)
    assert ids(model, texts) == want
    assert model.decode(want) == [model.lib.decode(x) for x in want]


def test_long_units_equal_the_library(model):
    import string

    r, code = random.Random(9), string.ascii_letters + string.digits + "+/"
    texts = ["".join(r.choice(code) for _ in range(n)) for n in (255, 256, 257, 1000, 60_000)]
    texts += ["ab" * 700, "a" * 5001, "a" * 400 + "b" * 300, " " * 900 + "x" + " " * 300, "=" * 1000 + "-" * 333]
    texts += ["".join(chr(r.randrange(0x4E00, 0x4F00)) for _ in range(700)), "é" * 600 + "ßü" * 300]
    for _ in range(150):
        own = r.choice([["a", "b"], ["t", "h", "e", "i", "n"], ["the", "ing", "tion", "é", "0", "00", "==", "--", "_", "er"]])
        texts.append("".join(r.choice(own) for _ in range(r.randrange(250, 700))))
    texts.append(" ".join(texts[:4]) + " and " + texts[5])
    assert ids(model, texts) == model.lib.encode(texts, add_bos=True, add_eos=True)
    assert ids(model, texts[4:5]) == model.lib.encode(texts[4:5], add_bos=True, add_eos=True)


def test_long_units_are_not_kept(model, monkeypatch):
    from quarry.llm import units

    monkeypatch.setattr(units, "CACHE_CHARS", 1000)
    for i in range(5):
        model.encode([f"{i}" * 900])
    assert model.units._chars <= 2 * 901


def test_a_full_memory_starts_anew(model, monkeypatch):
    from quarry.llm import units

    monkeypatch.setattr(units, "CACHE_UNITS", 10)
    texts = [" ".join(f"q{i}{j}" for j in range(9)) for i in range(20)]
    assert [x for t in texts for x in ids(model, [t])] == model.lib.encode(texts, add_bos=True, add_eos=True)


def test_odd_input(odd_docs, no_docs, tok):
    path = tok("piece_bpe_32k.model")
    rows = s.encode_decode(odd_docs, path).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["ids"] == by[4]["ids"] == [1, 2] and by[3]["decoded"] == ""
    assert by[10]["ids_sha256"] == hashlib.sha256(np.array(by[10]["ids"], "<u4").tobytes()).hexdigest()
    assert by[6]["n_tokens"] == len(by[6]["ids"])
    assert s.encode_decode(no_docs, path).collect() == []
