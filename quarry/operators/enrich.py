"""Pluggable models: tokenizer, embedder, language model; each has a default that needs no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, SUMMARY_CHARS, _keywords

SUMMARY_INPUT, KEYWORD_INPUT, EMBEDDING_INPUT = 8000, 4000, 1000


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...


class WordTokenizer:
    """Counts runs of word characters and single other characters; not a byte-pair encoding."""

    _token = re.compile(r"\w+|[^\w\s]")

    def count(self, text: str) -> int:
        return sum(1 for _ in self._token.finditer(text))


class BytePairTokenizer:
    """Counts the ids of a rank file of the tiktoken library."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def count(self, text: str) -> int:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text))

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words, scaled to unit length; equal texts have equal vectors, an empty one zeros."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out


class LanguageModel(Protocol):
    """What a summariser needs; available() is asked once a worker."""

    def available(self) -> bool: ...

    def summarise(self, text: str, most: int) -> str: ...

    def keywords(self, text: str, most: int) -> str: ...


def embedding(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """The vector of a text, zeros for a null or empty one; the model gets so many texts at once."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            every = [t or "" for t in texts.to_pylist()]
            out = np.zeros((len(every), embedder.dim), np.float32)
            full = [i for i, t in enumerate(every) if t]
            for i in range(0, len(full), batch):
                part = full[i : i + batch]
                out[part] = embedder.embed([every[j] for j in part])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, embedder.dim, dtype=np.int32)), pa.array(out.ravel()))

    return run(text)


def plain_summary(text: str, most: int = SUMMARY_CHARS) -> str:
    """functions.text.fallback_summary() for one text, where a model has failed."""
    if len(text) < most:
        return (text + ". ").strip()
    at = text[: most + 1].rfind(". ")
    return (text[:most] if at < 0 else text[: at + 2]).strip()


def shortened(summary: str, most: int) -> str:
    """Cut at the last space before the limit."""
    if len(summary) <= most:
        return summary
    return summary[:most].rsplit(" ", 1)[0] + "..."


def listed_keywords(answer: str, most: int) -> list[str]:
    """A model's comma-separated answer, without parts of two characters and less or fifty and more."""
    return [k for k in (x.strip() for x in answer.split(",")) if 2 < len(k) < 50][:most]


def _summary(model: LanguageModel, usable: bool, text: str, most: int) -> str:
    if not usable:
        return plain_summary(text, most)
    cut = text[:SUMMARY_INPUT] + "..." if len(text) > SUMMARY_INPUT else text
    try:
        return shortened(model.summarise(cut, most).strip(), most)
    except Exception:  # a model may fail in any way; the document still gets a summary
        return plain_summary(cut, most)


def _model_keywords(model: LanguageModel, usable: bool, text: str, most: int) -> list[str]:
    if not usable:
        return _keywords(text, most)
    cut = text[:KEYWORD_INPUT]
    try:
        return listed_keywords(model.keywords(cut, most), most)
    except Exception:  # as above
        return _keywords(cut, most)


def describe(docs: DataFrame, model: LanguageModel, text: str = "text", most: int = SUMMARY_CHARS, words: int = KEYWORDS) -> DataFrame:
    """docs with summary, keywords and embedding_text from a language model.

    A model that isn't available is replaced by the native fallbacks' results; one that fails, for that text alone.
    """

    @F.arrow_udf("struct<summary:string,keywords:array<string>,embedding_text:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        usable = None
        kind = pa.struct([("summary", pa.string()), ("keywords", pa.list_(pa.string())), ("embedding_text", pa.string())])
        for texts in batches:
            if usable is None:
                usable = model.available()
            out = []
            for t in texts.to_pylist():
                if not t:
                    out.append({"summary": "Empty document", "keywords": [], "embedding_text": ""})
                    continue
                s, k = _summary(model, usable, t, most), _model_keywords(model, usable, t, words)
                out.append({"summary": s, "keywords": k, "embedding_text": f"{s} Keywords: {', '.join(k)}"})
            yield pa.array(out, kind)

    return docs.withColumn("_made", run(F.col(text))).select(*docs.columns, "_made.*")


class FunctionModel:
    """A language model made of one function prompt -> answer; unavailable without one."""

    def __init__(self, generate: Callable[[str], str] | None = None, name: str = "", listed: Callable[[], list[str]] | None = None):
        self._generate, self.name, self._listed = generate, name, listed

    def available(self) -> bool:
        """Whether a listed model has this name, up to the tag; any error says no."""
        if self._generate is None:
            return False
        if self._listed is None:
            return True
        try:
            base = self.name.split(":")[0]
            return any(base in m for m in self._listed())
        except Exception:
            return False

    def generate(self, prompt: str) -> str:
        if not self.available():
            return f"[no model] {prompt[:100]}"
        return self._generate(prompt)

    def summarise(self, text: str, most: int) -> str:
        return self._generate(f"Summarise in at most {most} characters:\n\n{text}")

    def keywords(self, text: str, most: int) -> str:
        return self._generate(f"List {most} keywords, separated by commas:\n\n{text}")

    def embedding_input(self, text: str) -> str:
        """A text fit for embedding; its beginning where no model answers."""
        try:
            return self._generate(f"Describe for search:\n\n{text[:3000]}") if self.available() else text[:EMBEDDING_INPUT]
        except Exception:
            return text[:EMBEDDING_INPUT]
