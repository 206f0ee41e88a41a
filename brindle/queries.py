"""The driver queries of the engine, and DuckDB SQL for those that SQL expresses.

The driver's tables play a knowledge base: ``documents`` are uploads in order of id, keyed by their source, with
metadata built from them and ``labels``; ``embeddings`` belong to the documents of the same number; ``benchmark``
holds questions.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.functions import citations, text
from brindle.functions.filters import compile_filter
from brindle.operators import chunk, embed, evaluate, ingest, ocr, rerank, search, versions
from brindle.plans.recovery import checkpoint, delete, shared_path
from brindle.plans.store import Store
from brindle.plans.tables import table
from brindle.sources import loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime.date(2024, 9, 1)


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# ---- the driver's tables as a knowledge base


def metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its metadata as JSON; unlabelled documents lack the label keys."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    stats = F.struct("n_chars", F.col("lang").alias("lang"))
    tags = F.array("lang", "source")
    return joined.withColumn("metadata", F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic", tags.alias("tags"), stats.alias("stats"))))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploads in order of id, with validity dates."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return table(spark, sf, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.col("doc_id").alias("seq"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("source").alias("doc_key"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(False).alias("replace"), start.alias("valid_from"), F.when(F.col("doc_id") % 3 != 0, F.date_add(start, 200)).alias("valid_until"),
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table after all uploads."""
    fresh = versions.mark_duplicates(uploads(spark, sf)).filter("duplicate_of IS NULL")
    made = F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60)
    return versions.assign_versions(fresh).withColumn("created_at", made).withColumn("superseded_at", F.when(~F.col("is_current"), F.timestamp_seconds(F.lit(1735689600))))


UPLOADS_SQL = """
up AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, doc_id AS seq, doc_id || '.txt' AS filename, source AS doc_key, sha256(text) AS content_hash,
  CAST(strlen(text) AS BIGINT) AS size_bytes, DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS valid_from,
  CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 400 + 200 AS INTEGER) END AS valid_until FROM documents)"""
STORED_SQL = f"""{UPLOADS_SQL},
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS nth FROM up) WHERE nth = 1),
stored AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS version, lag(id) OVER w AS superseded_id, lead(id) OVER w IS NULL AS is_current FROM fresh WINDOW w AS (PARTITION BY doc_key ORDER BY seq))"""


# ---- filters


def _filter(name: str, filters: dict, where: str) -> None:
    @query(name, f"SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return metadata_rows(spark, sf).filter(compile_filter(filters, F.col("metadata"))).select("doc_id")


_filter("filter_eq", {"lang": "en"}, "lang = 'en'")
_filter("filter_implicit_and", {"lang": "en", "source": "src1"}, "lang = 'en' AND source = 'src1'")
_filter("filter_ne", {"quality": {"$ne": 1}}, "quality IS DISTINCT FROM 1")
_filter("filter_in", {"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')")
_filter("filter_nin", {"quality": {"$nin": [0, 5]}}, "quality IS NULL OR quality NOT IN (0, 5)")
_filter("filter_range", {"n_chars": {"$gte": 500, "$lt": 2000}}, "n_chars >= 500 AND n_chars < 2000")
_filter("filter_string_range", {"source": {"$gt": "src15", "$lte": "src3"}}, "source > 'src15' AND source <= 'src3'")
_filter("filter_exists", {"toxic": {"$exists": True}}, "toxic IS NOT NULL")
_filter("filter_not_exists", {"toxic": {"$exists": False}}, "toxic IS NULL")
_filter("filter_not_range_missing", {"$not": {"quality": {"$gte": 1}}}, "NOT (quality >= 1)")
_filter("filter_not_range_type", {"$not": {"lang": {"$gte": 5}}}, "true")
_filter("filter_or_not", {"$or": [{"lang": "es"}, {"$not": {"source": "src1"}}]}, "lang = 'es' OR NOT source = 'src1'")
_filter("filter_and", {"$and": [{"lang": {"$ne": "en"}}, {"n_chars": {"$lte": 900.5}}]}, "lang <> 'en' AND n_chars <= 900.5")
_filter("filter_nested", {"stats.n_chars": {"$gt": 1000}, "stats": {"lang": "en"}}, "n_chars > 1000 AND lang = 'en'")
_filter("filter_contains", {"tags": {"$contains": "de"}}, "lang = 'de' OR source = 'de'")
_filter("filter_contains_all", {"tags": {"$contains": ["src2", "en"]}}, "source = 'src2' AND lang = 'en'")
_filter("filter_array_scalar", {"tags": "en"}, "false")


# ---- vector search

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [1.0]


@query("vector_topk", f"SELECT e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 4) AS vector_score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.vector_topk(table(spark, sf, "embeddings"), _first_vector(spark, sf), 10, "vec_id")
    return found.select("vec_id", F.round("vector_score", 4).alias("vector_score"))


@query("vector_topk_filtered", f"SELECT e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 4) AS vector_score FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, embeddings q WHERE q.vec_id = 0 AND d.lang = 'en' ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    items = metadata_rows(spark, sf).filter(compile_filter({"lang": "en"}, F.col("metadata"))).select(F.col("doc_id").alias("vec_id"))
    found = search.vector_topk(table(spark, sf, "embeddings").join(items, "vec_id"), _first_vector(spark, sf), 10, "vec_id")
    return found.select("vec_id", F.round("vector_score", 4).alias("vector_score"))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("batch_vector_topk", f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, round(c, 4) AS vector_score, rank FROM r WHERE rank <= 10""")
def batch_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.batch_vector_topk(table(spark, sf, "embeddings"), _vector_queries(spark, sf), 10, "vec_id")
    return found.select("query_id", "vec_id", F.round("vector_score", 4).alias("vector_score"), "rank")


# ---- keyword and hybrid search


def _lexeme_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.simple_lexemes(F.col("text")).alias("lexemes"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), text.simple_lexemes(F.col("text")).alias("terms"))


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).filter("query_id % 100 = 0")


_WORDS = """lex AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS lexemes FROM documents),
tok AS (SELECT id, len(lexemes) AS n, unnest(lexemes) AS term FROM lex),
post AS (SELECT id, n, term, count(*) AS uses FROM tok GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark {where}),
hits AS (SELECT query_id, id, 0.1 * CAST(sum(uses) AS DOUBLE) / ln(1 + n) AS score FROM post JOIN asked USING (term) GROUP BY query_id, id, n)"""
_STATED_WORDS = _WORDS.format(where="WHERE item_id % 100 = 0")


@query("keyword_matches", f"WITH {_STATED_WORDS} SELECT query_id, count(*) AS n_matches FROM hits GROUP BY query_id")
def keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = search.keyword_matches(search.postings(_lexeme_docs(spark, sf), queries=_stated(spark, sf)), _stated(spark, sf))
    return found.groupBy("query_id").agg(F.count("*").alias("n_matches"))


@query("keyword_topk", f"""WITH {_STATED_WORDS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM hits)
SELECT query_id, id, round(score, 6) AS keyword_score, rank FROM r WHERE rank <= 10""")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.keyword_matches(search.postings(_lexeme_docs(spark, sf), queries=_stated(spark, sf)), _stated(spark, sf)).withColumn("keyword_score", F.round("keyword_score", 9))
    return search._topk(found, "keyword_score", 10, "id").select("query_id", "id", F.round("keyword_score", 6).alias("keyword_score"), "rank")


def _hybrid_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a vector, and questions: every benchmark item divisible by 100, with the vector of the same number."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    items = _lexeme_docs(spark, sf).join(vectors, "id")
    queries = _stated(spark, sf).join(vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    return items, queries


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items, queries = _hybrid_items(spark, sf)
    words = search.keyword_matches(search.postings(items, queries=queries), queries).withColumn("keyword_score", F.round("keyword_score", 9))
    return search.batch_vector_topk(items, queries, 40), search._topk(words, "keyword_score", 40, "id")


_HYBRID = f"""WITH lex AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS lexemes, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
tok AS (SELECT id, len(lexemes) AS n, unnest(lexemes) AS term FROM lex),
post AS (SELECT id, n, term, count(*) AS uses FROM tok GROUP BY ALL),
ques AS (SELECT item_id AS query_id, text, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 100 = 0),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ques),
hits AS (SELECT query_id, id, 0.1 * CAST(sum(uses) AS DOUBLE) / ln(1 + n) AS score FROM post JOIN asked USING (term) GROUP BY query_id, id, n),
kw AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits) WHERE rank <= 40),
sim AS (SELECT query_id, id, {_COS.format(a='embedding', b='qv')} AS c FROM lex, ques),
vec AS (SELECT * FROM (SELECT query_id, id, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM sim) WHERE rank <= 40),
fused AS (SELECT query_id, id, v.c AS vs, CASE WHEN v.rank IS NULL THEN 'keyword' WHEN k.rank IS NULL THEN 'vector' ELSE 'both' END AS found_by,
  coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS rrf, v.rank AS vr, k.rank AS kr FROM vec v FULL JOIN kw k USING (query_id, id)),
ranked AS (SELECT f.*, s.c, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, vr NULLS LAST, kr NULLS LAST, id) AS fused_rank FROM fused f JOIN sim s USING (query_id, id))
"""


@query("rrf_fusion", _HYBRID + "SELECT query_id, id, round(rrf, 9) AS rrf_score FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    vector, words = _lists(spark, sf)
    both = vector.select("query_id", "id", "rank").unionByName(words.select("query_id", "id", "rank"))
    return search.rrf(both, ["query_id", "id"]).withColumn("rrf_score", F.round("rrf_score", 9))


@query("hybrid_found_by", _HYBRID + "SELECT query_id, id, found_by, CAST(fused_rank AS INTEGER) AS fused_rank FROM ranked")
def hybrid_found_by(spark: SparkSession, sf: str) -> DataFrame:
    fused = search.fuse(*_lists(spark, sf))
    order = Window.partitionBy("query_id").orderBy(F.col("fused_rank"))
    return fused.select("query_id", "id", "found_by", F.row_number().over(order).alias("fused_rank"))


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    items, queries = _hybrid_items(spark, sf)
    return search.hybrid(items, queries, 40, 10)


@query("relevance_cut", _HYBRID + "SELECT query_id, id, round(c, 4) AS vector_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INTEGER) AS rank FROM ranked WHERE fused_rank <= 10 AND c >= 0.05")
def relevance_cut(spark: SparkSession, sf: str) -> DataFrame:
    return search.cut(_hybrid(spark, sf), 10, 0.05).select("query_id", "id", F.round("vector_score", 4).alias("vector_score"), "rank")


@query("no_relevant_context", _HYBRID + ", kept AS (SELECT query_id, count(*) AS n FROM ranked WHERE fused_rank <= 3 AND c >= 0.9 GROUP BY query_id) SELECT query_id, coalesce(n, 0) AS n_results, CASE WHEN n > 0 THEN 'ok' ELSE 'no_relevant_context' END AS status FROM ques LEFT JOIN kept USING (query_id)")
def no_relevant_context(spark: SparkSession, sf: str) -> DataFrame:
    _, queries = _hybrid_items(spark, sf)
    return search.statuses(queries, search.cut(_hybrid(spark, sf), 3, 0.9))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as results, ranks 1 to 9, with file name, page and title."""
    docs = metadata_rows(spark, sf)
    page = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 7).cast("int"))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"title": "'), "lang", F.lit(' report"}'))).when(F.col("doc_id") % 5 == 0, '{"title": ""}').otherwise("{}")
    return docs.select(F.col("source").alias("query_id"), "doc_id", "n_chars", (F.col("doc_id") % 9 + 1).cast("int").alias("rank"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), page.alias("page"), title.alias("metadata"), "text")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest documents of every source: the top-k that a context is made of."""
    order = Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id")
    return _results(spark, sf).withColumn("rank", F.row_number().over(order)).filter("rank <= 3")


_FOUND = """WITH f AS (SELECT source AS query_id, doc_id, n_chars, doc_id % 9 + 1 AS rank, doc_id || '.txt' AS filename,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 END AS page, CASE WHEN doc_id % 2 = 0 THEN lang || ' report' END AS title, text FROM documents)
"""
_CITED = _FOUND + """, c AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank) FROM f),
k AS (SELECT *, '[' || rank || ']' AS label, coalesce(title, filename) || coalesce(', p. ' || page, '') AS locator FROM c WHERE rank <= 3)
"""


@query("citations", _FOUND + "SELECT doc_id, '[' || rank || ']' AS label, coalesce(title, filename) || coalesce(', p. ' || page, '') AS locator FROM f")
def cite(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_citations(_results(spark, sf)).select("doc_id", "label", "locator")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.with_citations(_cited(spark, sf))
    return rows.groupBy("query_id").agg(citations.block(F.col("rank"), F.col("locator"), F.col("text")).alias("context"))


_BLOCK = "string_agg(label || ' ' || locator || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"


@query("context_block", _CITED + f"SELECT query_id, {_BLOCK} AS context FROM k GROUP BY query_id")
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)


@query("chat_messages", _CITED + f", b AS (SELECT query_id, {_BLOCK} AS context FROM k WHERE rank < 3 AND query_id <> 'src1' GROUP BY query_id) SELECT s.source AS query_id, 'Sources:' || chr(10) || chr(10) || coalesce(context, '(no sources found)') || chr(10) || chr(10) || 'Question: What does ' || s.source || ' say?' AS message FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN b ON b.query_id = s.source")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.with_citations(_cited(spark, sf)).filter("rank < 3 AND query_id <> 'src1'")
    blocks = rows.groupBy("query_id").agg(citations.block(F.col("rank"), F.col("locator"), F.col("text")).alias("context"))
    asked = table(spark, sf, "documents").select(F.col("source").alias("query_id")).distinct()
    question = F.concat(F.lit("What does "), "query_id", F.lit(" say?"))
    return asked.join(blocks, "query_id", "left").select("query_id", citations.user_message(F.col("context"), question).alias("message"))


@query("judge_contexts", _FOUND + "SELECT doc_id, 'Source: ' || filename || CASE WHEN coalesce(page, 0) <> 0 THEN ', p. ' || page ELSE '' END || chr(10) || text AS context, '[' || rank || '] ' || filename || CASE WHEN coalesce(page, 0) <> 0 THEN ', p. ' || page ELSE '' END AS returned FROM f")
def judge_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("doc_id", citations.judge_context(F.col("filename"), F.col("page"), F.col("text")).alias("context"), citations.returned(F.col("rank"), F.col("filename"), F.col("page")).alias("returned"))


@query("result_snippets", "SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS snippet FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def result_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", citations.snippet(F.col("text")).alias("snippet"))


# ---- versions


@query("content_dedup", f"WITH {UPLOADS_SQL} SELECT id, first(id) OVER (PARTITION BY content_hash ORDER BY seq) AS first_id FROM up QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) > 1")
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return versions.mark_duplicates(uploads(spark, sf)).filter("duplicate_of IS NOT NULL").select("id", F.col("duplicate_of").alias("first_id"))


@query("version_assign", f"WITH {STORED_SQL} SELECT id, doc_key, version, superseded_id, is_current FROM stored")
def version_assign(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).select("id", "doc_key", "version", "superseded_id", "is_current")


@query("live_documents", f"WITH {STORED_SQL} SELECT id FROM stored WHERE is_current AND valid_from <= DATE '2024-09-01' AND (valid_until IS NULL OR valid_until >= DATE '2024-09-01')")
def live_documents(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).filter(search.live(F.lit(AS_OF))).select("id")


@query("validity_window", f"WITH {UPLOADS_SQL} SELECT id, valid_from, valid_until FROM up WHERE valid_from <= DATE '2024-09-01' AND (valid_until IS NULL OR valid_until >= DATE '2024-09-01')")
def validity_window(spark: SparkSession, sf: str) -> DataFrame:
    return uploads(spark, sf).withColumn("is_current", F.lit(True)).filter(search.live(F.lit(AS_OF))).select("id", "valid_from", "valid_until")


@query("next_version", f"WITH {STORED_SQL} SELECT doc_key, max(version) + 1 AS next_version FROM stored GROUP BY doc_key")
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    return versions.next_version(stored(spark, sf))


@query("supersede_current", f"WITH {STORED_SQL} SELECT id, is_current AND doc_key NOT IN ('src1', 'src2') AS is_current, is_current AND doc_key = 'src1' AS superseded_now FROM stored WHERE doc_key <> 'src2'")
def supersede_current(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.createDataFrame([("src1", False), ("src2", True)], "doc_key string, replace boolean")
    now = F.timestamp_seconds(F.lit(1800000000))
    return versions.supersede(stored(spark, sf), new, now).select("id", "is_current", F.coalesce(F.col("superseded_at") == now, F.lit(False)).alias("superseded_now"))


_LAST = "stored.version = max(version) OVER (PARTITION BY doc_key)"


@query("delete_promote", f"WITH {STORED_SQL}, rest AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY version DESC) AS top FROM stored WHERE seq % 7 <> 0) SELECT id, version, top = 1 AS is_current FROM rest")
def delete_promote(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf)
    return versions.delete_versions(rows, rows.filter("seq % 7 = 0")).select("id", "version", "is_current")


@query("delete_cascade", f"WITH {STORED_SQL} SELECT vec_id FROM embeddings JOIN stored ON vec_id = seq WHERE seq % 7 <> 0")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf)
    left = versions.delete_versions(rows, rows.filter("seq % 7 = 0"))
    chunks = table(spark, sf, "embeddings").withColumn("document_id", F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    return versions.cascade(chunks, left).select("vec_id")


@query("keep_newest_current", f"WITH {UPLOADS_SQL} SELECT id, row_number() OVER (PARTITION BY doc_key ORDER BY seq DESC) = 1 AS is_current FROM up")
def keep_newest_current(spark: SparkSession, sf: str) -> DataFrame:
    rows = uploads(spark, sf).withColumn("created_at", F.timestamp_seconds("seq")).withColumn("is_current", F.lit(True)).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return versions.keep_newest_current(rows, F.timestamp_seconds(F.lit(1800000000))).select("id", "is_current")


@query("list_documents_page", f"WITH {STORED_SQL} SELECT id, filename, doc_key, version FROM stored WHERE is_current ORDER BY seq DESC LIMIT 10 OFFSET 5")
def list_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    return versions.list_documents(stored(spark, sf), 10, 5).select("id", "filename", "doc_key", "version")


@query("document_versions", f"WITH {STORED_SQL} SELECT id, version, is_current FROM stored WHERE doc_key = 'src3' ORDER BY version DESC")
def document_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.document_versions(stored(spark, sf), "src3").select("id", "version", "is_current")


@query("upload_errors", f"WITH {UPLOADS_SQL} SELECT id, CASE WHEN valid_until < DATE '2024-08-01' THEN 'valid_until is before valid_from' WHEN size_bytes > 5000 THEN 'file is larger than 5000 bytes' END AS error FROM up")
def upload_errors(spark: SparkSession, sf: str) -> DataFrame:
    late = uploads(spark, sf).withColumn("valid_from", F.lit(datetime.date(2024, 8, 1)))
    return late.select("id", versions.upload_errors(late, 5000).alias("error"))


@query("reserved_metadata_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'page,version' ELSE '' END AS reserved FROM events")
def reserved_metadata_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.when(F.col("event_id") % 2 == 0, '{"version": 1, "page": 2, "k": 3}').otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.array_join(ingest.reserved_used(keys), ",").alias("reserved"))


@query("ocr_gate", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 200 AS needs_ocr FROM documents")
def ocr_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ocr.needs_ocr(F.col("text"), "auto", 200).alias("needs_ocr"))


@query("csv_lines", "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS line FROM nation")
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("string")
    def line(headers: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([loaders.load_csv(f"{h}\n{r}".encode()).sections[0].text for h, r in zip(headers, rows, strict=True)], dtype=object)

    nation = table(spark, sf, "nation")
    return nation.select("n_nationkey", line(F.lit(",".join(nation.columns)), F.to_csv(F.struct(*nation.columns))).alias("line"))


# ---- evaluation


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A case per source: expected is a text of two labelled documents; results are the source's three longest documents."""
    docs = metadata_rows(spark, sf)
    order = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(order))
    wanted = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("contains"))
    good = (F.col("quality") == 1) & (F.col("rank") <= 6)
    cases = ranked.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.when(good, wanted))).alias("expected"), F.max("source").alias("question"))
    results = ranked.filter((F.col("rank") <= 3) & (F.col("source") != "src5")).select(F.col("source").alias("id"), "rank", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(None).cast("int").alias("page"), "text")
    some = results.groupBy("id").agg(F.count("*").alias("n"))
    statuses = cases.select("id").join(some, "id", "left").select("id", F.when(F.col("n") > 0, "ok").otherwise("no_relevant_context").alias("status"), (F.length("id") == 4).alias("reranked"), (F.length("id") * 1.5).cast("double").alias("took_ms"))
    return cases, results, statuses


_EVAL = """WITH r AS (SELECT d.*, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT source AS id, source AS question, count(*) FILTER (WHERE quality = 1 AND rank <= 6) AS expected,
  count(*) FILTER (WHERE quality = 1 AND rank <= 3 AND source <> 'src5') AS found, min(rank) FILTER (WHERE quality = 1 AND rank <= 3 AND source <> 'src5') AS first_hit_rank,
  CASE WHEN source = 'src5' THEN 'no_relevant_context' ELSE 'ok' END AS status, length(source) = 4 AS reranked, length(source) * 1.5 AS took_ms FROM r GROUP BY source)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_cases(*_cases(spark, sf))


@query("eval_first_hit", _EVAL + "SELECT id, expected > 0 AS answerable, status, CAST(first_hit_rank AS INTEGER) AS first_hit_rank, found, expected FROM s")
def eval_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", "answerable", "status", "first_hit_rank", "found", "expected")


@query("eval_summary", _EVAL + """SELECT count(*) FILTER (WHERE NOT reranked) AS rerank_fallbacks, count(*) AS questions, count(*) FILTER (WHERE expected > 0) AS answerable, count(*) FILTER (WHERE expected = 0) AS unanswerable,
round(avg(CASE WHEN expected > 0 THEN CASE WHEN first_hit_rank = 1 THEN 1.0 ELSE 0.0 END END), 3) AS hit_at_1, round(avg(CASE WHEN expected > 0 THEN CASE WHEN first_hit_rank IS NOT NULL THEN 1.0 ELSE 0.0 END END), 3) AS hit_at_k,
round(avg(CASE WHEN expected > 0 THEN coalesce(CAST(1 AS DOUBLE) / first_hit_rank, 0.0) END), 3) AS mrr, round(avg(CASE WHEN expected > 0 THEN CAST(found AS DOUBLE) / expected END), 3) AS recall,
round(avg(CASE WHEN expected > 0 THEN CASE WHEN status <> 'ok' THEN 1.0 ELSE 0.0 END END), 3) AS false_refusal, round(avg(CASE WHEN expected = 0 THEN CASE WHEN status <> 'ok' THEN 1.0 ELSE 0.0 END END), 3) AS correct_refusal,
round(avg(CAST(took_ms AS DOUBLE)), 3) AS avg_ms FROM s""")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summarize(_scored(spark, sf), rerank=True)


@query("eval_failures", _EVAL + "SELECT id, CASE WHEN expected > 0 AND first_hit_rank IS NULL THEN 'MISS' WHEN expected > 0 AND found < expected THEN 'PARTIAL' ELSE 'NO-REFUSE' END AS kind FROM s WHERE (expected > 0 AND (first_hit_rank IS NULL OR found < expected)) OR (expected = 0 AND status = 'ok')")
def eval_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(_scored(spark, sf)).select("id", "kind")


@query("eval_returned", _EVAL + ", t AS (SELECT source AS id, rank, doc_id FROM r WHERE rank <= 3 AND source <> 'src5') SELECT id, string_agg('[' || rank || '] ' || doc_id || '.txt', '; ' ORDER BY rank) AS returned FROM t GROUP BY id")
def eval_returned(spark: SparkSession, sf: str) -> DataFrame:
    _, results, _ = _cases(spark, sf)
    return evaluate.returned_labels(results).select("id", F.array_join("returned", "; ").alias("returned"))


def _judgements(spark: SparkSession, sf: str) -> DataFrame:
    """A synthetic judged run: every labelled document under every metric."""
    metrics = F.explode(F.array(*[F.lit(m) for m in evaluate.THRESHOLDS]))
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), metrics.alias("metric"), F.when(F.col("doc_id") % 17 == 0, "pipeline_error").when(F.col("doc_id") % 5 == 0, "no_relevant_context").otherwise("ok").alias("status"), (F.col("quality") == 1).alias("reranked"))
    score = (F.pmod(F.col("seq") * 7 + F.length("metric") * 13, F.lit(101)) / 100).cast("double")
    return rows.withColumn("score", score).withColumn("error", F.when(F.col("seq") % 13 == 0, "timeout")).withColumn("n_contexts", F.when(F.col("status") == "no_relevant_context", 0).otherwise(3))


_JUDGED = """WITH m(metric, threshold) AS (VALUES ('contextual_precision', 0.7), ('contextual_recall', 0.7), ('contextual_relevancy', 0.5), ('correctness', 0.7), ('faithfulness', 0.8), ('answer_relevancy', 0.7)),
x AS (SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id, metric, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN doc_id % 17 = 0 THEN 'pipeline_error' WHEN doc_id % 5 = 0 THEN 'no_relevant_context' ELSE 'ok' END AS status, quality = 1 AS reranked,
  CAST((doc_id * 7 + length(metric) * 13) % 101 AS DOUBLE) / 100 AS raw, doc_id % 13 = 0 AS bad FROM labels, m),
y AS (SELECT *, CASE WHEN status = 'no_relevant_context' AND metric LIKE 'contextual%' THEN 0.0 WHEN status = 'no_relevant_context' AND metric = 'faithfulness' THEN 1.0 WHEN NOT bad THEN raw END AS score FROM x),
j AS (SELECT *, coalesce(score >= threshold, false) AS passed FROM y)
"""


@query("judged_scores", _JUDGED + "SELECT id, metric, CAST(round(score, 3) AS DOUBLE) AS score, passed FROM j")
def judged_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judge(_judgements(spark, sf)).select("id", "metric", "score", "passed")


@query("judged_summary", _JUDGED + "SELECT metric, CAST(round(avg(score), 3) AS DOUBLE) AS mean, round(avg(CASE WHEN score IS NOT NULL THEN CASE WHEN passed THEN 1.0 ELSE 0.0 END END), 3) AS pass_rate, count(*) FILTER (WHERE score IS NULL) AS errors FROM j GROUP BY metric")
def judged_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judged_metrics(evaluate.judge(_judgements(spark, sf)))


@query("judged_totals", _JUDGED + ", c AS (SELECT DISTINCT id, status, reranked FROM j) SELECT count(*) AS questions_judged, CAST(4 AS BIGINT) AS skipped_no_reference, count(*) FILTER (WHERE status = 'pipeline_error') AS pipeline_errors, count(*) FILTER (WHERE status <> 'pipeline_error' AND NOT reranked) AS rerank_fallbacks, count(*) FILTER (WHERE status = 'no_relevant_context') AS refused FROM c")
def judged_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judged_totals(_judgements(spark, sf).select("id", "status", "reranked").distinct(), 4, True)


@query("judged_lowest", _JUDGED + "SELECT id, CAST(round(score, 3) AS DOUBLE) AS score FROM j WHERE metric = 'correctness' AND score IS NOT NULL ORDER BY round(score, 3), seq LIMIT 10")
def judged_lowest(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.lowest(evaluate.judge(_judgements(spark, sf)), "correctness").select("id", "score")


@query("judged_resume", _JUDGED + "SELECT id FROM j WHERE status <> 'pipeline_error' AND NOT (metric = 'faithfulness' AND seq % 4 = 0) AND metric IN ('correctness', 'faithfulness') GROUP BY id HAVING count(*) = 2")
def judged_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = _judgements(spark, sf).filter("NOT (metric = 'faithfulness' AND seq % 4 = 0)")
    return evaluate.reusable(done, ["correctness", "faithfulness"])


@query("rerank_topk", _HYBRID + """, word AS (SELECT DISTINCT query_id, unnest(string_split_regex(trim(lower(text), ' ' || chr(10)), '\\s+')) AS w FROM ques), share AS (
SELECT r.query_id, r.id, r.fused_rank, CAST(count(*) FILTER (WHERE contains(lower(d.text), w)) AS DOUBLE) / count(*) AS s FROM ranked r JOIN word USING (query_id) JOIN documents d ON d.doc_id = r.id GROUP BY ALL)
SELECT query_id, id, round(s, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_rank) AS INTEGER) AS rank FROM share QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_rank) <= 5""")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf, rerank.OverlapReranker()).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), F.col("fused_rank").alias("rank"))


def _reranked(spark: SparkSession, sf: str, by: rerank.Reranker) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rerank.rerank(_hybrid(spark, sf).join(texts, "id").join(asked, "query_id"), by, 5)


class _Failing:
    enabled = True

    def score(self, query: str, texts: list[str]) -> list[float]:
        raise TimeoutError("no answer")


@query("rerank_fallback", _HYBRID + "SELECT query_id, id, CAST(fused_rank AS INTEGER) AS rank, false AS reranked FROM ranked WHERE fused_rank <= 5")
def rerank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf, _Failing()).select("query_id", "id", F.col("fused_rank").alias("rank"), "reranked")


# ---- ingestion of a batch, parsing, chunking, embedding


@query("ingest_batch", """
WITH up AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source || '.txt' AS filename, coalesce(text, '') AS text FROM documents),
r AS (SELECT *, regexp_matches(text, '\\S') AS readable, min(CASE WHEN regexp_matches(text, '\\S') THEN path END) OVER (PARTITION BY sha256(text)) AS first_path FROM up),
s AS (SELECT *, CASE WHEN first_path < path THEN 'duplicate' WHEN readable THEN 'ingested' ELSE 'error' END AS status FROM r)
SELECT path, filename, status, CASE WHEN status = 'ingested' THEN filename END AS doc_key, CASE WHEN status = 'ingested' THEN CAST(row_number() OVER (PARTITION BY filename, status ORDER BY path) AS INTEGER) END AS version,
  CASE WHEN status = 'error' THEN 'no extractable text' END AS error FROM s""")
def ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one batch of files, each named after its source: names and bytes come again, and each file is judged by itself."""
    files = table(spark, sf, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat("source", F.lit(".txt")).alias("filename"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )
    folder = shared_path(spark, "ingest")
    result = checkpoint(ingest.Ingestor(Store(spark, folder), settings=Settings(analyser="simple")).ingest(files))
    delete(spark, folder)
    return result.select("path", "filename", "status", "doc_key", "version", "error")


@query("html_to_text")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    from brindle.sources.files import sections

    pages = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return sections(pages).select("filename", "text", "metadata", "error")


@query("json_pretty", """SELECT event_id || '.json' AS filename, '{' || chr(10) || '  "k": ' || (props->>'k') || chr(10) || '}' AS text, CAST(NULL AS VARCHAR) AS error FROM events""")
def json_pretty(spark: SparkSession, sf: str) -> DataFrame:
    from brindle.sources.files import sections

    rows = table(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("filename"), F.col("props").cast("binary").alias("content"))
    return sections(rows).select("filename", "text", "error")


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk(table(spark, sf, "documents"), 512, 64, "doc_id")


@query("chunk_offsets", """
WITH t AS (SELECT doc_id, CAST(n_chars % 997 AS INTEGER) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 64 THEN 1 ELSE CAST(ceil((n - 64) / 48.0) AS INTEGER) + 1 END)) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(48 * i AS INTEGER) AS char_start, CAST(least(48 * i + 64, n) AS INTEGER) AS char_end, repeat('x', least(64, n - 48 * i)::INTEGER) AS content FROM c""")
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without a separator, one letter repeated: windows of 64 that begin every 48."""
    texts = table(spark, sf, "documents").select("doc_id", F.repeat(F.lit("x"), (F.col("n_chars") % 997).cast("int")).alias("text"))
    return chunk.chunk(texts, 64, 16, "doc_id").withColumnRenamed("id", "doc_id")


@query("chunk_paragraphs", """
WITH t AS (SELECT doc_id, CAST(n_chars % 13 AS INTEGER) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range((n + 2) // 3)) AS i FROM t),
p AS (SELECT doc_id, i, list_transform(range(3 * i, least(3 * i + 3, n)), lambda k: 'paragraph ' || chr(97 + CAST(k AS INTEGER)) || repeat('!', 9)) AS own FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(66 * i AS INTEGER) AS char_start, CAST(66 * i + 22 * len(own) - 2 AS INTEGER) AS char_end, array_to_string(own, chr(10) || chr(10)) AS content FROM p""")
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of 20 characters, of which three fit a chunk of 66 with the blank lines before them."""
    letters = F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 13).cast("int") - 1), lambda k: F.concat(F.lit("paragraph "), F.char(k + 97), F.lit("!" * 9)))
    body = F.when(F.col("n_chars") % 13 > 0, F.array_join(letters, "\n\n")).otherwise("")
    return chunk.chunk(table(spark, sf, "documents").select("doc_id", body.alias("text")), 66, 0, "doc_id").withColumnRenamed("id", "doc_id")


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    parsed = html_to_text(spark, sf).withColumn("structured", F.lit(True))
    return chunk.chunk(parsed, 400, 40, "filename", "text", "structured")


@query("hash_embedding", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
b AS (SELECT doc_id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm, map_from_entries(list((bucket, n))) AS uses FROM b GROUP BY doc_id)
SELECT doc_id, array_to_string(list_transform(range(64), lambda k: CAST(round(10000 * coalesce(uses[k], 0) / norm) AS INTEGER)), ' ') AS embedding FROM documents JOIN m USING (doc_id)""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with words, their vectors in ten-thousandths, rounded from double precision."""
    embedder = embed.HashingEmbedder(64, 10000, np.float64, embed.sql_words)
    made = table(spark, sf, "documents").select("doc_id", embed.embed(F.col("text"), embedder, kind="array<double>").alias("v"))
    whole = F.transform("v", lambda x: F.round(x).cast("int"))
    return made.filter(F.exists("v", lambda x: x > 0)).select("doc_id", F.array_join(whole, " ").alias("embedding"))


@query("english_lexemes")
def english_lexemes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.lexemes(F.col("text"), "english").alias("lexemes"))


@query("metadata_merge", """
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, '{' || coalesce('"lang": "' || lang || '", ', '') || '"source": "user", ' || coalesce('"n_chars": ' || n_chars || ', ', '') || coalesce('"quality": ' || quality || ', ', '') || coalesce('"toxic": ' || toxic || ', ', '')
  || '"tags": [' || coalesce('"' || lang || '"', 'null') || ', ' || coalesce('"' || source || '"', 'null') || '], "stats": {' || coalesce('"n_chars": ' || n_chars, '') || coalesce(CASE WHEN n_chars IS NULL THEN '' ELSE ', ' END || '"lang": "' || lang || '"', '') || '}, "extra": 1}' AS metadata FROM d""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    return metadata_rows(spark, sf).select("doc_id", ingest.merged_metadata(F.col("metadata"), F.to_json(F.struct(F.lit("user").alias("source"), F.lit(1).alias("extra")))).alias("metadata"))


@query("ocr_layout", """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_quantity, l_returnflag || l_partkey) AS words FROM lineitem GROUP BY ALL),
g AS (SELECT *, n - lag(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS gap FROM l)
SELECT l_orderkey AS page, string_agg(CASE WHEN gap > 1 THEN chr(10) ELSE '' END || words, chr(10) ORDER BY n) AS text FROM g GROUP BY l_orderkey""")
def ocr_layout(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    top = (F.col("l_linenumber") * 12).cast("double")
    box = F.struct(top.alias("top"), (top + 10).alias("bottom"), F.col("l_quantity").cast("double").alias("left"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return ocr.layouts(lines.groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(box).alias("boxes")))


@query("knowledge_base_search")
def knowledge_base_search(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, hashed embeddings, both searches for every benchmark item divisible by 100, fused, cut and cited."""
    docs = table(spark, sf, "documents")
    embedder = embed.HashingEmbedder(64)
    pieces = chunk.chunk(docs, 512, 64, "doc_id")
    pieces = checkpoint(pieces.select(F.concat_ws(":", F.col("id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("doc_id"), "content", embed.embed(F.col("content"), embedder).alias("embedding"), text.simple_lexemes(F.col("content")).alias("lexemes")))
    asked = table(spark, sf, "benchmark").filter("item_id % 100 = 0")
    queries = asked.select(F.col("item_id").alias("query_id"), embed.embed(F.col("text"), embedder).alias("query_vector"), text.simple_lexemes(F.col("text")).alias("terms"))
    best = search.cut(search.hybrid(pieces, queries, 40, 3), 3, 0.0)
    return best.join(pieces.select("id", "doc_id", "content"), "id").select("query_id", "rank", "doc_id", "found_by", F.round("vector_score", 6).alias("vector_score"), "content")


import brindle.path_queries  # noqa: E402, F401  registers more
