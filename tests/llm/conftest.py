import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def tok():
    pt = pytest.importorskip("public_tokenizers")
    return pt.path


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, found_items int, `a.b` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeats, ties, a long text, and names that clash with results."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    texts = {
        1: "One two three four five six seven.", 2: "one two three four five six seven.", 3: None, 4: "", 5: " \n\t ", 6: long, 7: long + " more", 8: "single", 9: "Mail me: a.b@c.org or +1 (222) 333-4444 now",
        10: "ünïcødé 日本語 \x00 text \x85 with ​ odd spaces", 11: "<|endoftext|> </s> <s>",
    }
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 3, 4) for i, t in texts.items()]
    rows += [(None, "a null key", None, None, None, None, None, None, None), (1, texts[1], None, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(n, seed, vocabulary=4000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
