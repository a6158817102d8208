"""The registered queries on the engine's operators, each with the same in DuckDB's SQL where SQL has a form for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, sheets, text
from ..operators import catalog, chunk, elements, incremental, knn, store
from ..session import scratch, written
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Nearest neighbours

_PROBE, _K = 7, 10


def _nearest(spark: SparkSession, sf_dir: str, metric: str, k: int = _K) -> DataFrame:
    corpus = _t(spark, sf_dir, "embeddings")
    probe = corpus.where(F.col("vec_id") == _PROBE).select("embedding").first()
    if probe is None:
        return corpus.limit(0).withColumn("distance", F.lit(0.0))
    return knn.nearest(corpus, probe["embedding"], k, metric)


def _nearest_sql(d: str) -> str:
    return f"""with q as (select embedding::double[] as e from embeddings where vec_id = {_PROBE}),
    d as (select vec_id, label, {d} as d from embeddings, q)
    select vec_id, label, round(d, 6) as distance from d order by d, vec_id limit {_K}"""




def _rounded() -> Column:
    return F.round("distance", 6).alias("distance")


_SQL_L2 = "list_distance(embedding::double[], e) ** 2"


@_query(_nearest_sql(_SQL_L2))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "l2").select("vec_id", "label", _rounded())


@_query(_nearest_sql("1 - list_cosine_similarity(embedding::double[], e)"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine").select("vec_id", "label", _rounded())


@_query(_nearest_sql("-list_dot_product(embedding::double[], e)"))
def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "dot").select("vec_id", "label", _rounded())


@_query(f"""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0),
    d as (select query_id, vec_id, {_SQL_L2} as d from embeddings, q),
    r as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from d)
    select query_id, vec_id, rank::int as rank, round(d, 6) as distance from r where rank <= 5""")
def knn_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _t(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.nearest_batch(corpus, queries, 5).select("query_id", "vec_id", "rank", _rounded())


def _batched_sql(d: str) -> str:
    return f"""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0),
    d as (select query_id, vec_id, {d} as d from embeddings, q),
    r as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from d)
    select query_id, vec_id, rank::int as rank, round(d, 6) as distance from r where rank <= 5"""


def _batched(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    corpus = _t(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.nearest_batch(corpus, queries, 5, metric).select("query_id", "vec_id", "rank", _rounded())


@_query(_batched_sql("1 - list_cosine_similarity(embedding::double[], e)"))
def knn_batched_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir, "cosine")


@_query(_batched_sql("-list_dot_product(embedding::double[], e)"))
def knn_batched_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir, "dot")


@_query(f"""with q as (select embedding::double[] as e from embeddings where vec_id = {_PROBE}),
    r as (select vec_id, label, {_SQL_L2} as d, row_number() over (partition by label order by {_SQL_L2}, vec_id) as rank from embeddings, q)
    select label, vec_id, rank::int as rank, round(d, 6) as distance from r where rank <= 3""")
def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _t(spark, sf_dir, "embeddings")
    probe = corpus.where(F.col("vec_id") == _PROBE).select(F.col("embedding").alias("q")).limit(1)
    near = corpus.crossJoin(F.broadcast(probe)).withColumn("distance", knn.distance(F.col("embedding"), F.col("q")))  # one row
    return incremental.ranked_by(near, "label", [F.col("distance"), F.col("vec_id")], 3).select("label", "vec_id", "rank", _rounded())


@_query(f"""with q as (select embedding::double[] as e from embeddings where vec_id = {_PROBE}),
    d as (select vec_id, label, {_SQL_L2} as d from embeddings, q order by d, vec_id limit 40),
    r as (select *, row_number() over (order by d, vec_id) as n from d)
    select label, min(n)::int as first_rank, count(*) as hits, string_agg(vec_id::varchar, ',' order by n) as items from r group by label""")
def hits_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, "l2", 40)
    grouped = knn.grouped_hits(hits, "label", ["distance", "vec_id"], F.col("vec_id").cast("string"))
    return grouped.withColumn("items", F.array_join("items", ","))


# Catalog

_CATALOG_SQL = """select doc_id::varchar as file_path, 'doc-' || doc_id || '.txt' as file_name, sha256(text) as file_hash, octet_length(encode(text)) as file_size,
    source as file_type, lpad(n_chars::varchar, 9, '0') as indexed_time, length(text) as total_chars, lang from documents"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string")
    return docs.select(
        path.alias("file_path"), F.concat(F.lit("doc-"), path, F.lit(".txt")).alias("file_name"), F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"),
        F.col("source").alias("file_type"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("indexed_time"), F.length("text").cast("long").alias("total_chars"), "lang", "text",
    )


@_query(_CATALOG_SQL)
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).drop("text")


@_query(f"select file_path, indexed_time, file_type from ({_CATALOG_SQL}) order by indexed_time desc, file_path limit 15 offset 20")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(_catalog(spark, sf_dir), 20, 15).select("file_path", "indexed_time", "file_type")


@_query(f"""select file_path, file_name, case when coalesce(text, '') = '' then 'No summary' else left(text, 200) end as summary,
    array_to_string(string_split(text, ' ')[1:5], ' ') as keywords, file_type, file_size, length(text) - length(replace(text, chr(10), '')) as total_chunks, indexed_time
    from ({_CATALOG_SQL.replace(", lang from", ", lang, text from")})""")
def catalog_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long")
    rows = _catalog(spark, sf_dir).withColumns({"summary": F.col("text"), "keywords": F.split("text", " "), "total_chunks": lines})
    return catalog.listed(rows).withColumn("keywords", F.array_join("keywords", " "))


@_query("""select doc_id::varchar as file_path, coalesce(n, 0) as actual_chunks, round_even(n_chars / 1048576.0, 2) as file_size_mb
    from documents left join (select conv_id, count(*) as n from conversations group by conv_id) c on c.conv_id = doc_id""")
def info_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "n_chars")
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"))
    return catalog.chunk_counts(docs, turns).select("file_path", "actual_chunks", text.megabytes(F.col("n_chars")).alias("file_size_mb"))


@_query("""select count(*) as total_documents, sum(octet_length(encode(text)))::bigint as file_size, sum(length(text))::bigint as total_chars, sum(n_chars)::bigint as total_tokens,
    (select count(*) from conversations) as total_chunks from documents""")
def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("file_size"), F.length("text").cast("long").alias("total_chars"), F.col("n_chars").alias("total_tokens"))
    return catalog.statistics(docs, _t(spark, sf_dir, "conversations"))


@_query("select 0::bigint as total_documents, 0::bigint as file_size, 0::bigint as total_chars, 0::bigint as total_tokens, 0::bigint as total_chunks")
def stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("false").select(F.col("n_chars").alias("file_size"), F.col("n_chars").alias("total_chars"), F.col("n_chars").alias("total_tokens"))
    return catalog.statistics(docs, docs)


@_query("select source as file_type, count(*) as n from documents where source is not null group by source")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.value_counts(_t(spark, sf_dir, "documents").withColumnRenamed("source", "file_type"), "file_type")


@_query("select conv_id as file_path, role as element_type, count(*) as n, sum(length(text)) // count(*) as mean_tokens from conversations group by conv_id, role")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_path"), F.col("role").alias("element_type"), F.length("text").alias("token_count"))
    return elements.type_breakdown(turns)


@_query("select event_type as extracted_by, count(*) as n from events group by event_type")
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.extraction_counts(_t(spark, sf_dir, "events").select(F.col("event_type").alias("extracted_by")))


# Summaries, keywords, texts to embed

_SUMMARY_SQL = f"""piece as (select doc_id, unnest(string_split(text, '. ')) as s, generate_subscripts(string_split(text, '. '), 1) as i from documents),
    ends as (select doc_id, i, s, sum(length(s)) over (partition by doc_id order by i) + 2 * (i - 1) as e from piece),
    kept as (select doc_id, string_agg(s || '. ', '' order by i) as s from ends where e < {text.SUMMARY_CHARS} group by doc_id),
    summed as (select doc_id, text, regexp_replace(coalesce(s, left(text, {text.SUMMARY_CHARS})), '^\\s+|\\s+$', '', 'g') as summary from documents left join kept using (doc_id))"""

_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS))
_KEYWORD_SQL = f"""token as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), 1) as i from documents),
    counted as (select doc_id, w, count(*) as n, min(i) as first from token where regexp_full_match(w, '[a-z]+') and length(w) > 3 and w not in ({_STOP}) group by doc_id, w),
    ranked as (select *, row_number() over (partition by doc_id order by n desc, first) as r from counted),
    worded as (select doc_id, string_agg(w, ', ' order by r) as words from ranked where r <= {text.KEYWORDS} group by doc_id)"""


@_query(f"with {_SUMMARY_SQL} select doc_id, summary from summed")
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.fallback_summary(F.col("text")).alias("summary"))


@_query(f"with {_KEYWORD_SQL} select doc_id, coalesce(words, '') as keywords from documents left join worded using (doc_id)")
def keywords_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), ", ").alias("keywords"))


@_query(f"""with {_SUMMARY_SQL}, {_KEYWORD_SQL} select doc_id,
    case when text = '' then '' else summary || ' Keywords: ' || coalesce(words, '') end as embedding_text,
    case when text = '' then 'Empty document' else summary end as summary from summed left join worded using (doc_id)""")
def doc_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.described(F.col("text")).alias("d"))
    return docs.select("doc_id", "d.embedding_text", "d.summary")


@_query("""select doc_id, sha256(case when source <> '' then 'Document: ' || source || ' | ' else '' end || 'Section: ' || lang || ' | Type: table | Summary: ' || n_chars || ' | ' || left(text, 2000)) as digest,
    coalesce(nullif(case when lang = 'en' then '' else lang end, ''), nullif(source, ''), text, '') as input from documents""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.concat(F.lit("Summary: "), F.col("n_chars").cast("string"))
    rich = text.embedding_text(F.col("source"), F.col("lang"), F.col("text"), F.lit("table"), extra)
    first = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(rich, 256).alias("digest"), folds.input_text(first, F.col("source"), F.col("text")).alias("input"))


@_query("""select conv_id, turn, i - 1 as pos, s as sentence from (select conv_id, turn, unnest(x) as s, generate_subscripts(x, 1) as i
    from (select conv_id, turn, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as x from conversations))""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@_query("""select doc_id, '["' || source || '","' || lang || '"]' as encoded, lang as second from documents""")
def keywords_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = text.keywords_json(F.array("source", "lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", encoded.alias("encoded"), text.keywords_from_json(encoded)[1].alias("second"))


@_query("""select conv_id, turn, coalesce('Description: ' || nullif(case when turn = 1 then '' else role end, '') || chr(10), '') || 'Caption: ' || text as figure,
    case when turn = 0 then '[Visual element — ' || role || ']' else 'Text in image: ' || role end as other from conversations""")
def figure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, role = F.lit(""), F.col("role")
    first = text.figure_text(none, F.when(F.col("turn") == 1, "").otherwise(role), F.col("text"), none, none)
    other = text.figure_text(none, none, none, F.when(F.col("turn") == 0, "").otherwise(role), role)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", first.alias("figure"), other.alias("other"))


# Chunks


def _windows_sql(size: int, overlap: int, stop: bool) -> str:
    found = "case " + " ".join(f"when strpos(w, {p}) > 0 then lo + length(w) - strpos(reverse(w), {r}) - {len_ - 1} + {len_ if after else 0}" for p, r, len_, after in (("chr(10) || chr(10)", "chr(10) || chr(10)", 2, False), ("'. '", "' .'", 2, True), ("'! '", "' !'", 2, True), ("'? '", "' ?'", 2, True), ("chr(10)", "chr(10)", 1, True))) + " else e0 end"
    return f"""with recursive d as (select doc_id, text, length(text) as n from documents where text <> ''),
    step(doc_id, s, e) as (
      select doc_id, -1, 0 from d
      union all
      select doc_id, s1, case when e0 < n then {found} else e0 end from (
        select *, case when e0 < n then substring(text, lo + 1, e0 - lo) else '' end as w from (
          select *, s1 + {max(size // 2, 1)} as lo from (
            select d.doc_id, d.text, d.n, x.s1, least(x.s1 + {size}, d.n) as e0
            from (select doc_id, s as s0, e as e_, case when s < 0 then 0 else greatest(e - {overlap}, s + 1) end as s1 from step) x join d using (doc_id)
            where x.s1 < d.n {f"and (x.s0 < 0 or x.e_ < d.n)" if stop else ""})))),
    kept as (select doc_id, s, e, regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') as t from step join d using (doc_id) where s >= 0)
    select doc_id, row_number() over (partition by doc_id order by s)::int - 1 as chunk_id, s::int as start_pos, e::int as end_pos, length(t)::int as char_count, md5(t) as digest from kept where t <> ''"""


def _windows(spark: SparkSession, sf_dir: str, tail: str) -> DataFrame:
    found = chunk.chunk_text(_t(spark, sf_dir, "documents"), 500, 100, tail)
    return found.select("doc_id", "chunk_id", "start_pos", "end_pos", "char_count", F.md5("text").alias("digest"))


@_query(_windows_sql(500, 100, False))
def chunk_char_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "reference")


@_query(_windows_sql(500, 100, True))
def chunk_char_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "stop")


def _style() -> Column:
    return F.when(F.col("turn") == 0, "Title").when(F.col("role") == "user", "Heading 1").when(F.length("text") % 3 == 0, "heading 2").otherwise("Normal")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: their turns, in order, are elements of several kinds."""
    t = _t(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == 0, "title").when(F.col("role") == "user", "heading_1").when(F.length("text") % 5 == 0, "table").when(F.length("text") % 3 == 0, "list_item").otherwise("paragraph")
    t = t.withColumns({"element_type": kind, "style": _style(), "section_path": F.col("role"), "page_or_sheet": F.col("turn").cast("string"), "html_or_markdown": F.lit(""), "summary": F.lit(""), "extracted_by": F.when(F.col("role") == "user", "docling").otherwise("easyocr")})
    return elements.ordered_array(t, "conv_id", ["turn", "text"], ["element_type", "style", "text", "section_path", "page_or_sheet", "html_or_markdown", "summary", "extracted_by"])


@_query()
def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _turns(spark, sf_dir).withColumn("title", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    return chunk.chunk_elements(docs, 120, "conv_id")


@_query("""with recursive e as (select conv_id, row_number() over (partition by conv_id order by turn, text) as i,
      case when turn = 0 then 0 when role = 'user' then 1 when length(text) % 3 = 0 then 2 end as level, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations),
    f(conv_id, i, stack) as (
      select conv_id, 0::bigint, []::varchar[] from (select distinct conv_id from e)
      union all
      select e.conv_id, e.i, case when level = 0 then [t] when level > 0 then list_concat(stack[1 : level - 1], [t]) else stack end from f join e on e.conv_id = f.conv_id and e.i = f.i + 1)
    select conv_id, i - 1 as pos, sha256(array_to_string(stack, ' > ')) as path from f where i > 0""")
def breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _turns(spark, sf_dir)
    styles = F.transform("elements", lambda e: e["style"])
    texts = F.transform("elements", lambda e: text.strip(e["text"]))
    return docs.select("conv_id", F.posexplode(folds.breadcrumbs(styles, texts)).alias("pos", "path")).withColumns({"pos": F.col("pos").cast("long"), "path": F.sha2("path", 256)})


@_query("""select conv_id, string_agg(x, ',' order by first) as extracted_by from (
    select conv_id, case when role = 'user' then 'docling' else 'easyocr' end as x, min(turn) as first from conversations group by all) group by conv_id""")
def extractors_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", folds.joined_sources(F.transform("elements", lambda e: e["extracted_by"])).alias("extracted_by"))


@_query()
def vision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of several paragraphs, made of the documents' sentences."""
    docs = _t(spark, sf_dir, "documents")
    said = F.regexp_replace("text", r"\.\s+", ".\n\n")
    parts = folds.split_description(said, F.col("doc_id"))
    return docs.select("doc_id", F.posexplode(parts).alias("part", "e")).select("doc_id", "part", "e.text", "e.section_path", "e.page_or_sheet")


# Which documents are indexed

_KNOWN_SQL = "known as (select doc_id, n_chars + case when quality = 1 then 0 else 1 end as stamp from documents join labels using (doc_id))"


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("stamp"))
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs, docs.join(labels, "doc_id").select("doc_id", (F.col("stamp") + F.when(F.col("quality") == 1, 0).otherwise(1)).alias("stamp"))


@_query(f"with {_KNOWN_SQL} select doc_id, n_chars as stamp from documents d where not exists (select 1 from known k where k.doc_id = d.doc_id and k.stamp = d.n_chars)")
def incremental_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.candidates(*_known(spark, sf_dir), "doc_id", "stamp")


@_query(f"with {_KNOWN_SQL} select doc_id, n_chars as stamp from documents d where exists (select 1 from known k where k.doc_id = d.doc_id and k.stamp = d.n_chars)")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.unchanged(*_known(spark, sf_dir), "doc_id", "stamp")


@_query("""select d.doc_id::varchar as file_path, sha256(text) as file_hash from documents d left join labels l using (doc_id) where l.doc_id is null or quality = 0""")
def changed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the hash of the whole text; of documents with a quality of 0 another text was registered."""
    docs = _t(spark, sf_dir, "documents").withColumn("file_path", F.col("doc_id").cast("string"))
    before = docs.join(_t(spark, sf_dir, "labels"), "doc_id").select("file_path", F.sha2(F.concat("text", F.when(F.col("quality") == 1, "").otherwise("!")), 256).alias("file_hash"))
    return incremental.changed(docs.select("file_path", F.sha2("text", 256).alias("file_hash")), before)


@_query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def vanished_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.vanished(_t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents"), "doc_id")


@_query("select doc_id, lang, n_chars from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'new' as lang, quality::bigint as n_chars from labels")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = _t(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("lang"), F.col("quality").cast("long").alias("n_chars"))
    return store.upserted(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), incoming, "doc_id")


_STORED_SQL = """changed as (select d.doc_id, text, coalesce(quality, 1) = 0 as again, coalesce(toxic, 0) = 1 as gone from documents d left join labels l using (doc_id)),
    stored as (select doc_id::varchar as file_path, sha256(text || case when again then '!' else '' end) as file_hash, case when again then 'second' else 'first' end as summary,
      case when again then 2 else 1 end::bigint as n_chunks, gone from changed)"""


def _stored(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store with all documents, of which those with a quality of 0 were changed later and the others sent again."""
    made = store.Store(spark, scratch(spark, "store"))
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").hint("merge"), "doc_id", "left")
    docs = written(docs.select("doc_id", "text", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("again")), "documents")  # joined once
    path = F.col("doc_id").cast("string").alias("file_path")
    first = docs.select(path, F.sha2("text", 256).alias("file_hash"), F.lit("first").alias("summary"), F.col("text").alias("chunk_text"), "again")
    made.upsert(first, first.withColumn("chunk_id", F.lit(0)))
    marked = F.concat("text", F.when(F.col("again"), "!").otherwise(""))
    later = docs.select(path, F.sha2(marked, 256).alias("file_hash"), F.when(F.col("again"), "second").otherwise("unchanged").alias("summary"), marked.alias("chunk_text"))
    made.upsert(later, later.withColumn("chunk_id", F.explode(F.array(F.lit(0), F.lit(1)))))
    return made


def _held(made: store.Store) -> DataFrame:
    counts = made.chunks().groupBy("file_path", "file_hash").agg(F.count("*").alias("n_chunks"))
    return made.catalog().join(counts.hint("merge"), ["file_path", "file_hash"]).select("file_path", "file_hash", "summary", "n_chunks")


@_query(f"with {_STORED_SQL} select file_path, file_hash, summary, n_chunks from stored")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(_stored(spark, sf_dir))


@_query(f"with {_STORED_SQL} select file_path, file_hash, summary, n_chunks from stored where not gone")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a deletion and a compaction."""
    made = _stored(spark, sf_dir)
    made.delete(_t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("file_path")))
    made.compact()
    return _held(made)


@_query("""select '/docs/' || source || '/' || doc_id || case when lang = 'en' then '.TXT' else '' end as file_path, doc_id || case when lang = 'en' then '.TXT' else '' end as file_name, n_chars as file_size,
    case when lang = 'en' then '.txt' else '' end as file_type, strftime(make_timestamp(doc_id * 1500000), '%Y-%m-%dT%H:%M:%S') || case when doc_id % 2 = 1 then '.500000' else '' end as modified_time, sha256(text) as file_hash from documents""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".TXT").otherwise(""))
    rows = _t(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("length"), F.timestamp_micros(F.col("doc_id") * 1_500_000).alias("modificationTime"), F.col("text").cast("binary").alias("content"))
    return files.metadata(rows).select("file_path", "file_name", "file_size", "file_type", "modified_time", "file_hash")


@_query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@_query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.uncovered(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), ["doc_id"])


@_query("""select page_or_sheet, source_rank::int as source_rank, seq from (
    select turn::varchar as page_or_sheet, 0 as source_rank, conv_id as seq from conversations
    union all select case when page_id % 2 = 0 then ' ' || page_id || ' ' else url end, 1, page_id from pages)
    order by coalesce(try_cast(trim(page_or_sheet) as int), 0), source_rank, seq, page_or_sheet""")
def merge_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the merged order."""
    first = _t(spark, sf_dir, "conversations").select(F.col("turn").cast("string").alias("page_or_sheet"), F.col("conv_id").alias("seq"))
    label = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" "))).otherwise(F.col("url"))
    second = _t(spark, sf_dir, "pages").select(label.alias("page_or_sheet"), F.col("page_id").alias("seq"))
    return elements.merged(first, second).select("page_or_sheet", "source_rank", "seq")


def _event_kind() -> Column:
    return F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "error", "delete").otherwise("scan")
_KIND_SQL = "case event_type when 'click' then 'create' when 'view' then 'modify' when 'error' then 'delete' else 'scan' end"
_PRIORITY_SQL = f"case {_KIND_SQL} when 'create' then 3 when 'modify' then 5 when 'scan' then 8 end"


@_query("select event_id, user_id, ts from events order by ts desc, event_id limit 25")
def newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.newest(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 25, "ts", "event_id")


@_query(f"select event_id, {_PRIORITY_SQL} as priority from events")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.with_priority(_t(spark, sf_dir, "events").withColumn("kind", _event_kind())).select("event_id", "priority")


@_query(f"""select user_id as file_path, min(p) as priority from (select user_id, {_PRIORITY_SQL} as p from events where {_KIND_SQL} <> 'delete')
    where user_id not in (select user_id from events where {_KIND_SQL} = 'delete' and value > 200) group by user_id""")
def queue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = incremental.with_priority(_t(spark, sf_dir, "events").withColumn("kind", _event_kind())).withColumnRenamed("user_id", "file_path")
    done = routed.where("kind = 'delete' and value > 200")
    return incremental.queued(routed.where("kind != 'delete'").select("file_path", "priority"), done=done)


@_query("""select count(*) filter (value < 10) as queued, count(*) filter (value >= 10 and value < 30) as processing,
    count(*) filter (value >= 30 and value < 90) as processed, count(*) filter (value >= 90) as failed from events""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 10, "queued").when(F.col("value") < 30, "processing").when(F.col("value") < 90, "processed").otherwise("failed")
    return incremental.queue_stats(_t(spark, sf_dir, "events").select(status.alias("status")))


_GAP = 21_600


@_query(f"""with recursive e as (select user_id, event_type, epoch_us(ts) as t, ts, row_number() over (partition by user_id, event_type order by ts) as i from (select distinct user_id, event_type, ts from events)),
    f(user_id, event_type, i, last, passed) as (
      select user_id, event_type, i, t, true from e where i = 1
      union all
      select e.user_id, e.event_type, e.i, case when e.t - f.last >= {_GAP}000000 then e.t else f.last end, e.t - f.last >= {_GAP}000000
      from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.i = f.i + 1)
    select user_id, event_type, ts from f join e using (user_id, event_type, i) where passed""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.debounced(_t(spark, sf_dir, "events"), _GAP, ["user_id", "event_type"])


@_query("""with x as (select ts, case event_type when 'click' then 'move' when 'view' then 'create' when 'error' then 'delete' else 'modify' end as was, user_id || '.txt' as a,
      case when event_type <> 'click' then null when event_id % 3 = 0 then user_id || '.bin' else user_id || '.md' end as b from events),
    y as (select ts, was, 'delete' as kind, a as path, 0 as step, b as fit from x where was = 'move' union all select ts, was, 'create', b, 1, b from x where was = 'move'
      union all select ts, was, was, a, 0, a from x where was <> 'move')
    select ts, kind, path, step::int as step from y where was = 'delete' or regexp_matches(fit, '\\.(txt|md)$')""")
def move_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "move").when(F.col("event_type") == "view", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    user = F.col("user_id").cast("string")
    dest = F.when(F.col("event_type") == "click", F.concat(user, F.when(F.col("event_id") % 3 == 0, ".bin").otherwise(".md")))
    rows = e.select("ts", kind.alias("kind"), F.concat(user, F.lit(".txt")).alias("path"), dest.alias("dest"))
    return incremental.decomposed(rows, files.is_indexed(F.col("path"), (".txt", ".md"))).select("ts", "kind", "path", "step")


# Sheets, captions, files

_CELL = {0: "p_name", 1: "cast(p_size as string)", 2: "concat('$', cast(p_size as string), ',000')", 3: "concat(' ', cast(p_size as string), '% ')", 4: "'nan'", 5: "''", 6: "'1e5'", 7: "'1_000'", 8: "'1__0'", 9: "'£-3.'"}


def _part_cell(dialect: str) -> str:
    parts = " ".join(f"when p_partkey % 10 = {i} then {x}" for i, x in _CELL.items())
    return f"case {parts} end".replace("string)", "varchar)" if dialect == "duckdb" else "string)")


@_query(f"""select p_partkey, try_cast(replace(regexp_replace(trim(c), '[,%$£]', '', 'g'), '1_000', '1000') as double) is not null as is_numeric from (select p_partkey, {_part_cell("duckdb")} as c from part)""")
def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", sheets.is_numeric(F.expr(_part_cell("spark"))).alias("is_numeric"))


@_query("""select p_partkey, case when p_partkey <= 0 then 'A' else
    (case when p_partkey > 702 then chr(65 + (((p_partkey - 703) // 676) % 26)::int) else '' end) || (case when p_partkey > 26 then chr(65 + (((p_partkey - 27) // 26) % 26)::int) else '' end)
    || chr(65 + ((p_partkey - 1) % 26)::int) end as letter from part where p_partkey <= 18278""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", sheets.column_letter(F.col("p_partkey")).alias("letter"))


@_query("""with s as (select p_brand, count(*) + 1 as n, string_agg(p_name || ' | ' || p_type || ' | ' || p_size, chr(10) order by p_partkey) as body,
      string_agg('| ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |', chr(10) order by p_partkey) as md from part group by p_brand)
    select p_brand as section_path, 'A1:C' || n as source_range, 'Sheet ''' || p_brand || ''': ' || (n - 1) || ' data rows, columns: name|x, type, size' as summary,
    sha256('Sheet: ' || p_brand || chr(10) || 'Sheet ''' || p_brand || ''': ' || (n - 1) || ' data rows, columns: name|x, type, size' || chr(10) || chr(10) || 'name|x | type | size' || chr(10) || body) as text_digest,
    sha256('| name\\|x | type | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || md) as markdown_digest from s""")
def sheet_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"), F.lit(" "))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))), lambda x: x["c"])
    rows = _t(spark, sf_dir, "part").groupBy("p_brand").agg(packed.alias("rows"))
    head, blank = F.array(F.array(F.lit("name|x"), F.lit("type"), F.lit("size"))), F.array(F.array(F.lit(""), F.lit(" ")))
    made = rows.select(sheets.sheet_element(F.col("p_brand"), F.concat(head, F.col("rows"), blank)).alias("e"))
    return made.select("e.section_path", "e.source_range", "e.summary", F.sha2("e.text", 256).alias("text_digest"), F.sha2("e.html_or_markdown", 256).alias("markdown_digest"))


_LABELS = ("Figure ", "fig", "CHART 1", "Image\t", "The figure ", "diagram a.", "  Plate ", "Photos ", "Exhibit-")


def _caption(dialect: str) -> str:
    parts = " ".join(f"when p_partkey % {len(_LABELS)} = {i} then '{x}'" for i, x in enumerate(_LABELS))
    size = "cast(p_size as varchar)" if dialect == "duckdb" else "cast(p_size as string)"
    return f"concat(case {parts} end, {size}, case when p_size % 3 = 0 then ' : ' when p_size % 3 = 1 then '–' else ' ' end, p_name)"


@_query(f"""select p_partkey, regexp_matches(trim({_caption("duckdb")}), '(?i)^(fig(ure)?|chart|diagram|image|plate|exhibit|photo|illustration)\\s*[0-9A-Za-z.]+\\s*[:–-]') as is_caption,
    case when lower(p_type) = 'title' then 0 else nullif(regexp_extract('heading ' || p_size, '^heading\\s*([0-9])', 1), '')::int end as level from part""")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = text.heading_level(F.concat(F.lit(" Heading "), F.col("p_size").cast("string"), F.lit(" ")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.is_caption(F.expr(_caption("spark"))).alias("is_caption"), level.alias("level"))


_PATHS = ("/data/", "/data/.git/", "/data/~", "/data/_", "/data/a.b/.")
_ENDS = (".txt", ".TXT", ".pdf", ".bin", "")


def _path(dialect: str) -> str:
    heads = " ".join(f"when p_partkey % {len(_PATHS)} = {i} then '{x}'" for i, x in enumerate(_PATHS))
    ends = " ".join(f"when p_size % {len(_ENDS)} = {i} then '{x}'" for i, x in enumerate(_ENDS))
    key = "cast(p_partkey as varchar)" if dialect == "duckdb" else "cast(p_partkey as string)"
    return f"concat(case {heads} end, 'f', {key}, case {ends} end)"


@_query(f"""select p_partkey, not regexp_matches(p, '(^|/)\\.') and not regexp_matches(p, '/~[^/]*$') and regexp_matches(lower(p), '\\.(txt|pdf)$') as indexed,
    lower(regexp_extract(regexp_extract(p, '[^/]*$'), '.(\\.[^.]+)$', 1)) as suffix from (select p_partkey, {_path("duckdb")} as p from part)""")
def path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(_path("spark"))
    return _t(spark, sf_dir, "part").select("p_partkey", files.is_indexed(p, (".txt", ".pdf")).alias("indexed"), files.suffix_of(p).alias("suffix"))


@_query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') end as modified_time from events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", files.iso_time(F.col("ts")).alias("modified_time"))


@_query("""select page_id, length(t) as n_chars, sha256(t) as digest, sha256(html) as file_hash from (select page_id, html, replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from pages)""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content: Column = F.col("html").cast("binary")
    t = files.decoded(content)
    return _t(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("digest"), F.sha2(content, 256).alias("file_hash"))


@_query("""select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::int as words, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) < 50 as threshold,
    n_chars > 2000 as landscape from documents""")
def vision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, width = text.word_count(F.col("text")), F.col("n_chars")
    return _t(spark, sf_dir, "documents").select("doc_id", words.alias("words"), text.wants_vision("threshold", words, width, F.lit(2000)).alias("threshold"), text.wants_vision("landscape", words, width, F.lit(2000)).alias("landscape"))
