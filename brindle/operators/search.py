"""Retrieval: exact vector top-k, keyword top-k, reciprocal rank fusion, relevance cut, one query or a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import citations, text, vectors
from brindle.functions.filters import compile_filter
from brindle.model import NO_RELEVANT_CONTEXT, OK

#: The constant of reciprocal rank fusion (a fixed value).
RRF_K = 60
#: Queries, and numbers of their vectors, that are sent to executors at once: 32 MB at most.
MOST_QUERIES, MOST_NUMBERS = 4096, 1 << 22
#: Items of one product, and how much less than the k-th best of the products may be ranked before it once scored.
STRIP, SLACK = 512, 1e-9


def live(as_of: Column) -> Column:
    """Current and in force on ``as_of``, both ends of the validity included."""
    return F.col("is_current") & F.coalesce(F.col("valid_from") <= as_of, F.lit(True)) & F.coalesce(F.col("valid_until") >= as_of, F.lit(True))


def searchable(chunks: DataFrame, documents: DataFrame, as_of: Column, filters: dict | None = None) -> DataFrame:
    """Chunks of live documents that pass ``filters``, with file name and type. Filters come before any top-k."""
    owners = documents.filter(live(as_of)).select(F.col("id").alias("document_id"), "filename", "file_type")
    return chunks.filter(compile_filter(filters, F.col("metadata"))).join(owners, "document_id")


def vector_topk(items: DataFrame, vector: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` items nearest to one vector by cosine, ties by id, vectors without a norm last; adds vector_score."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = items.withColumn("vector_score", vectors.cosine(F.col(vector_col), query))
    return scored.orderBy(F.col("vector_score").desc_nulls_last(), id_col).limit(k)


def _topk(scored: DataFrame, score: str, k: int, id_col: str) -> DataFrame:
    """Rank by score within query_id, the first ``k``; the group limit runs before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def batch_vector_topk(items: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, vector_score, rank) of the ``k`` nearest items of every query (query_id, query_vector).

    A stated set of queries meets all items. Up to ``MOST_QUERIES`` of one length go to the executors as a matrix: products of it with
    blocks of items pick candidates, at most ``k`` and ties for each query and batch, and only these are scored and ranked.
    A larger set is joined with the items instead.
    """
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("_q"))
    given = asked.limit(MOST_QUERIES + 1).toArrow() if k <= MOST_QUERIES else None
    matrix = _matrix(given) if given is not None and given.num_rows <= MOST_QUERIES else None
    if matrix is not None:
        kind = items.schema[id_col].dataType.simpleString()
        vector = items.schema[vector_col].dataType.simpleString()
        rows = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v")).mapInArrow(_nearest(matrix, k), f"_n int, id {kind}, _v {vector}")
        numbered = items.sparkSession.createDataFrame(given.append_column("_n", pa.array(range(given.num_rows), pa.int32())))
        pairs = rows.join(F.broadcast(numbered), "_n").withColumnRenamed("id", id_col)
    else:
        pairs = items.select(id_col, F.col(vector_col).alias("_v")).join(asked)
    return _topk(pairs.select("query_id", id_col, vectors.cosine(F.col("_v"), F.col("_q")).alias("vector_score")), "vector_score", k, id_col)


def _matrix(given: pa.Table) -> np.ndarray | None:
    """Unit rows of the queries, of zero vectors NaN; None if their lengths differ or something is null."""
    lists = given["_q"].combine_chunks()
    sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False)) if not lists.null_count else []
    if len(sizes) != 1 or not sizes[0] or lists.flatten().null_count or sizes[0] * len(lists) > MOST_NUMBERS:
        return None
    rows = lists.flatten().to_numpy().reshape(len(lists), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(matrix: np.ndarray, k: int):
    """(number of the query, id, vector) of all items that can be among the ``k`` nearest of a query in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, seen = np.full(len(matrix), -np.inf), 0  # of the k-th best so far
        for batch in batches:
            lists = batch.column(1)
            whole = pc.fill_null(pc.equal(pc.list_value_length(lists), matrix.shape[1]), False).to_numpy(zero_copy_only=False)
            values = lists.filter(pa.array(whole)).flatten()
            rows = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            at, numbers = np.flatnonzero(whole), []
            fine = np.isfinite(rows).all(1)  # items without a plain score come along only while others are few
            for i in range(0, len(rows), STRIP):
                own = np.flatnonzero(fine[i : i + STRIP]) + i
                scores = rows[own] @ matrix.T
                if len(own) >= k:
                    least = np.fmax(least, np.partition(scores, len(own) - k, axis=0)[len(own) - k])
                item, query = np.nonzero(~(scores < least - SLACK))
                numbers.append((query, at[own[item]]))
            odd = np.setdiff1d(np.arange(batch.num_rows), at[fine])
            nan = odd[np.isin(odd, at[np.isnan(rows).any(1)])] if len(rows) else odd[:0]
            if seen + int(fine.sum()) >= k:
                odd = nan  # NaN goes before all numbers
            seen += int(fine.sum())
            numbers.append((np.repeat(np.arange(len(matrix)), len(odd)), np.tile(odd, len(matrix))))
            query, item = (np.concatenate([x[i] for x in numbers]) for i in range(2))
            picked = batch.take(pa.array(item))
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), picked.column(0), picked.column(1)], names=["_n", "id", "_v"])

    return run


def postings(items: DataFrame, id_col: str = "id", lexeme_col: str = "lexemes", queries: DataFrame | None = None) -> DataFrame:
    """Inverted index: (id, term, uses, n_lexemes). With ``queries`` (terms) only of their terms, which are picked before anything is shuffled."""
    rows = items.select(id_col, F.size(lexeme_col).alias("n_lexemes"), F.explode(lexeme_col).alias("term"))
    if queries is not None:
        rows = rows.join(queries.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    return rows.groupBy(id_col, "n_lexemes", "term").agg(F.count("*").alias("uses"))


def keyword_matches(index: DataFrame, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """(query_id, id, keyword_score) of every item with a term of the query (query_id, terms): a hash join on terms.

    A query without terms, such as one of stop words alone, matches nothing.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    found = index.join(terms, "term").groupBy("query_id", id_col, "n_lexemes").agg(F.sum("uses").alias("found"))
    return found.select("query_id", id_col, text.keyword_score(F.col("found"), F.col("n_lexemes")).alias("keyword_score"))


def batch_keyword_topk(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(query_id, id, keyword_score, rank) of the ``k`` best items of every query."""
    return _topk(keyword_matches(index, queries, id_col), "keyword_score", k, id_col)


def keyword_topk(items: DataFrame, terms: list[str], k: int, id_col: str = "id", lexeme_col: str = "lexemes") -> DataFrame:
    """The ``k`` best items of one query over a column of lexemes, without an index; adds keyword_score."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    found = text.occurrences(F.col(lexeme_col), wanted)
    scored = items.withColumn("_found", found).filter("_found > 0").withColumn("keyword_score", text.keyword_score(F.col("_found"), F.size(lexeme_col)))
    return scored.drop("_found").orderBy(F.col("keyword_score").desc(), id_col).limit(k)


def rrf(rankings: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) per ``keys`` over all lists of ``rankings``."""
    return rankings.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score"))


def fuse(vector: DataFrame, keyword: DataFrame, id_col: str = "id") -> DataFrame:
    """Both lists as one: query_id, id, found_by, vector_score, keyword_score, rrf_score, fused_rank; equal scores in the vector list's order first.

    The fused list is not cut. A keyword-only hit has no vector score yet; see ``hybrid``.
    """
    v = vector.select("query_id", id_col, "vector_score", F.col("rank").alias("v_rank"))
    w = keyword.select("query_id", id_col, "keyword_score", F.col("rank").alias("k_rank"))
    both = v.join(w, ["query_id", id_col], "full_outer")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    found = F.when(F.col("v_rank").isNull(), "keyword").when(F.col("k_rank").isNull(), "vector").otherwise("both")
    fused = both.withColumn("found_by", found).withColumn("rrf_score", part("v_rank") + part("k_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("v_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last(), id_col)
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("v_rank", "k_rank")


def hybrid(items: DataFrame, queries: DataFrame, candidate_k: int, top_k: int, id_col: str = "id", vector_col: str = "embedding", lexeme_col: str = "lexemes") -> DataFrame:
    """Fused candidates of every query (query_id, query_vector, terms), all with their vector score."""
    k = max(candidate_k, top_k)
    by_vector = batch_vector_topk(items, queries, k, id_col, vector_col)
    by_word = batch_keyword_topk(postings(items, id_col, lexeme_col, queries), queries, k, id_col)
    fused = fuse(by_vector, by_word, id_col)
    own = items.select(id_col, F.col(vector_col).alias("_v"))
    score = F.coalesce("vector_score", vectors.cosine(F.col("_v"), F.col("query_vector")))
    return fused.join(own, id_col).join(queries.select("query_id", "query_vector"), "query_id").withColumn("vector_score", score).drop("_v", "query_vector")


def cut(candidates: DataFrame, top_k: int, threshold: float, score: str = "vector_score", order: str = "fused_rank") -> DataFrame:
    """The first ``top_k`` of every query, then those whose score reaches ``threshold``, ranked without gaps."""
    first = candidates.filter(F.col(order) <= top_k).filter(F.col(score) >= threshold)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))


def statuses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, n_results, status) of every query, also of those that nothing is left for."""
    counted = results.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(counted, "query_id", "left").select("query_id", n.alias("n_results"), F.when(n > 0, OK).otherwise(NO_RELEVANT_CONTEXT).alias("status"))


def with_citations(results: DataFrame) -> DataFrame:
    """Adds label, locator and rounded scores to ranked results that carry filename, page and metadata."""
    title = F.try_variant_get(F.try_parse_json("metadata"), "$.title", "string")
    rounded = [F.round(c, 6).alias(c) if c.endswith("_score") else F.col(c) for c in results.columns]
    return results.select(*rounded, citations.label(F.col("rank")).alias("label"), citations.locator(title, F.col("filename"), F.col("page")).alias("locator"))
