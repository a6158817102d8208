"""The whole way from files to the store, and searches on it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.folds import input_text, split_description
from ..functions.text import described, or_else, page_number, wants_vision
from ..operators.chunk import chunk_elements, chunk_text
from ..operators.enrich import Embedder, HashingEmbedder, LanguageModel, Tokenizer, WordTokenizer, describe, embedding
from ..operators.incremental import candidates, changed, vanished
from ..operators.store import Store
from ..schema import CHUNKS
from ..session import written
from ..sources.files import empty_files, iso_time, metadata, scan, suffix_of, within_size
from ..sources.parse import parse
from ..sources.pdf import ElementParser, Ocr, by_size, described_pages, pages_of


@dataclass
class Indexer:
    """Indexes files into a store; models default to those that need no network."""

    spark: SparkSession
    store: Store
    config: Config = Config()
    embedder: Embedder = HashingEmbedder()
    tokenizer: Tokenizer = WordTokenizer()
    model: LanguageModel | None = None
    ocr: Ocr | None = None
    layout: ElementParser = by_size
    vision: Callable[[bytes], str] | None = None

    def documents(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(catalog, chunks, failures) of files (path, length, modificationTime, content).

        Files are read and parsed once, chunks cut and embedded once: both are written to the scratch folder, from which
        all three tables follow. The catalog is a plan still, which its one reader computes.
        """
        hashed = files if "file_hash" in files.columns else metadata(files)
        parsed = written(parse(hashed, self.config.use_structured_parsing, self.ocr if self.config.enable_ocr else None, self.layout), "parsed")
        if self.config.enable_vision_enhancement and self.vision is not None:
            parsed = written(self._seen(hashed, parsed), "seen")
        failures = parsed.where("error is not null").select("file_path", "error", F.current_timestamp().alias("failed_at"))
        good = parsed.where("error is null")
        keys = ["file_path", "file_hash"]
        packed = good.withColumn("_key", F.struct(*keys))
        c = self.config
        flat = chunk_text(packed.where("size(elements) = 0"), c.chunk_size, c.chunk_overlap, "stop", "_key", "text", self.tokenizer)
        typed = chunk_elements(packed.where("size(elements) > 0"), c.max_chunk_tokens, "_key", "title", "elements", self.tokenizer)
        chunks = flat.unionByName(typed, allowMissingColumns=True).withColumnRenamed("text", "chunk_text")
        vector = embedding(or_else(F.col("embedding_text"), F.col("chunk_text")), self.embedder)
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        chunks = chunks.select("_key.*", *[x for x in chunks.columns if x != "_key"]).withColumn("embedding", vector)
        filled = [F.coalesce(F.col(n), F.lit("")).alias(n) if n in ("element_type", "section_path", "page_or_sheet", "embedding_text", "html_or_markdown", "extracted_by") else F.col(n).cast("long").alias(n) if n in ("chunk_id", "start_pos", "end_pos", "char_count", "token_count") else F.col(n) for n in names]
        chunks = written(chunks.select(*filled), "chunks")
        totals = chunks.groupBy("file_path").agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.min_by("chunk_text", "chunk_id").alias("_first"))
        told = describe(good, self.model) if self.model is not None else good.withColumn("_d", described(F.coalesce("text", F.lit("")))).select(*good.columns, "_d.*")
        catalog = told.join(totals, "file_path", "left")
        catalog = catalog.select(
            "file_path", "file_name", "file_hash", "file_size", "file_type", "modified_time", iso_time(F.localtimestamp()).alias("indexed_time"), "summary", "keywords",
            F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.length("text").cast("long").alias("total_chars"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            embedding(input_text(F.col("embedding_text"), F.col("summary"), F.col("_first")), self.embedder).alias("embedding"),
        )
        return catalog, chunks, failures

    def _seen(self, files: DataFrame, parsed: DataFrame) -> DataFrame:
        """parsed with descriptions of those PDF pages that the settings choose, each behind its page's elements."""
        keys, c = ["file_path", "file_hash"], self.config
        pages = pages_of(files.where(suffix_of(F.col("file_name")) == ".pdf"), keys)
        chosen = pages.where(wants_vision(c.vision_mode, F.col("words"), F.col("width"), F.col("height"), c.vision_word_threshold))
        told = described_pages(chosen, keys, self.vision).select(*keys, "page", F.posexplode(split_description(F.col("description"), F.col("page"))).alias("part", "e"))
        fields = [f.name for f in parsed.schema["elements"].dataType.elementType.fields]
        values = {"element_type": F.lit("vision_description"), "extracted_by": F.lit("vision"), **{n: F.col(f"e.{n}") for n in ("text", "section_path", "page_or_sheet")}}
        element = F.struct(*[values.get(n, F.lit("")).alias(n) for n in fields])
        seen = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "part", element.alias("e")))).alias("_seen"))
        place = lambda rank: lambda e, i: F.struct(page_number(e["page_or_sheet"]).alias("p"), F.lit(rank).alias("r"), i.alias("i"), e.alias("e"))
        both = F.array_sort(F.concat(F.transform("elements", place(0)), F.transform(F.transform("_seen", lambda x: x["e"]), place(1))))
        merged = F.when(F.col("_seen").isNull(), F.col("elements")).otherwise(F.transform(both, lambda x: x["e"]))
        return parsed.join(seen, keys, "left").withColumn("elements", merged).select(parsed.columns)

    def index(self, folder: str, force: bool = False, deletions: bool = False) -> dict:
        """Indexes what is new or changed below a folder: first by path and time, without contents, then by hash.

        deletions: also take out documents below the folder whose files are gone.
        """
        extensions = self.config.file_extensions
        empty = empty_files(self.spark, folder, extensions)
        listed = within_size(scan(self.spark, folder, extensions, contents=False).unionByName(empty.drop("content")), self.config.max_file_size_mb)
        listed = listed.withColumns({"file_path": F.col("path"), "modified_time": iso_time(F.col("modificationTime"))})
        registry = self.store.registry()
        wanted = listed if force else candidates(listed, registry)
        files = within_size(scan(self.spark, folder, extensions).unionByName(empty), self.config.max_file_size_mb).join(wanted.select("path"), "path", "left_semi")
        if not force:
            files = changed(metadata(files), registry)
        catalog, chunks, failures = self.documents(files)
        done = self.store.upsert(catalog, chunks, force)
        gone = 0
        if deletions:
            root = re.sub(r"^[a-z]+:/+", "/", folder).rstrip("/") + "/"  # paths come with one slash after their scheme
            below = registry.where(F.col("file_path").contains(root))
            gone = self.store.delete(vanished(listed, below))
        return {"indexed": done, "deleted": gone, "failed": failures.count()}

    def reindex(self, path: str, force: bool = False) -> dict | None:
        """One file; None if it is known with this content and not forced."""
        files = self.spark.read.format("binaryFile").load(path)
        catalog, chunks, failures = self.documents(files)
        bad = failures.first()
        if bad is not None:
            raise ValueError(bad["error"])
        if not self.store.upsert(catalog, chunks, force):
            return None
        # What the store has, as the plan would run the models again.
        return self.store.catalog().where(F.col("file_path") == files.select("path").first()["path"]).select("summary", "keywords").first().asDict()
