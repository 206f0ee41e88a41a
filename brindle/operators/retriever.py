"""One search over a stored knowledge base, as an application calls it."""

from __future__ import annotations

import datetime
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.functions.text import ANALYSERS
from brindle.model import NO_CONTEXT, NO_RELEVANT_CONTEXT, OK, SearchRequest, SearchResponse
from brindle.operators import index, search
from brindle.operators.embed import Embedder, embed_now
from brindle.operators.rerank import Reranker, rerank


class Retriever:
    """Searches chunks ⋈ documents. Both searches read one snapshot; the plan runs as one action."""

    def __init__(self, documents: DataFrame, chunks: DataFrame, embedder: Embedder, reranker: Reranker | None = None, settings: Settings | None = None, analyser: str | None = None, as_of: datetime.date | None = None, index: str | None = None):
        """``index``: the path of an index of all ``chunks``; without it vector search is exact."""
        self.index = index
        self.documents, self.chunks, self.embedder, self.reranker = documents, chunks, embedder, reranker
        self.settings, self.as_of = settings or Settings(), as_of
        self.analyse = ANALYSERS[analyser or self.settings.analyser]

    def _items(self, filters: dict | None) -> DataFrame:
        return search.searchable(self.chunks, self.documents, F.lit(self.as_of) if self.as_of else F.current_date(), filters)

    def _near(self, items: DataFrame, vector: list[float], k: int) -> DataFrame:
        """Where there is an index, what of ``items`` lies in the cells next to ``vector``, if these hold ``k``; else all."""
        if self.index is None:
            return items
        found = index.near_cells(items.sparkSession, self.index, [vector]).join(items.select("id"), "id", "left_semi")
        return found if found.limit(k).count() == k else items

    def _reranks(self, request: SearchRequest) -> bool:
        return request.rerank and self.reranker is not None and self.reranker.enabled

    def search(self, request: SearchRequest) -> SearchResponse:
        """One search. The candidates' columns are read in the same job that ranks them."""
        started = time.perf_counter()
        items = self._items(request.filters)
        vector = embed_now([request.query], self.embedder)[0]
        k = max(request.candidate_k, request.top_k)
        near = search.vector_topk(self._near(items, vector, k), vector, k).select("id", "vector_score")
        order = search.Window.partitionBy("query_id").orderBy(F.col("vector_score").desc_nulls_last(), "id")
        near = near.withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(order))
        if request.hybrid:
            words = search.keyword_topk(items.select("id", "lexemes"), sorted(set(self.analyse(request.query))), k)
            order = search.Window.partitionBy("query_id").orderBy(F.col("keyword_score").desc(), "id")
            words = words.withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(order))
            found = search.fuse(near, words)
        else:
            found = _vector_only(near)
        query = F.array(*[F.lit(float(x)) for x in vector])
        found = found.join(items, "id").withColumn("vector_score", F.coalesce("vector_score", search.vectors.cosine(F.col("embedding"), query)))
        found = found.withColumn("query", F.lit(request.query))
        rows = self._first(found, self._reranks(request), request.top_k)
        return self._response(request, rows, round((time.perf_counter() - started) * 1000, 1))

    def search_all(self, requests: list[SearchRequest]) -> list[SearchResponse]:
        """Many searches, in one job for all that have filters, depths and methods in common; ``took_ms`` is a search's share of its job."""
        groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(requests):
            groups.setdefault((json.dumps(r.filters, sort_keys=True), r.hybrid, self._reranks(r), r.top_k, r.candidate_k), []).append(i)
        out: dict[int, SearchResponse] = {}
        for (_, hybrid, reranks, top_k, candidate_k), own in groups.items():
            started = time.perf_counter()
            texts = [requests[i].query for i in own]
            rows = [(i, text, [float(x) for x in v], sorted(set(self.analyse(text)))) for i, text, v in zip(own, texts, embed_now(texts, self.embedder), strict=True)]
            asked = self.chunks.sparkSession.createDataFrame(rows, "query_id int, query string, query_vector array<float>, terms array<string>")
            items = self._items(requests[own[0]].filters)
            if hybrid:
                found = search.hybrid(items, asked, candidate_k, top_k)
            else:
                found = _vector_only(search.batch_vector_topk(items, asked, max(candidate_k, top_k)))
            found = found.join(items, "id").join(asked.select("query_id", "query"), "query_id")
            by: dict[int, list[dict]] = {}
            for row in self._first(found, reranks, top_k):
                by.setdefault(row["query_id"], []).append(row)
            took = round((time.perf_counter() - started) * 1000 / len(own), 1)
            for i in own:
                out[i] = self._response(requests[i], by.get(i, []), took)
        return [out[i] for i in range(len(requests))]

    def _first(self, found: DataFrame, reranks: bool, top_k: int) -> list[dict]:
        """The ``top_k`` best of every query, in order."""
        if reranks:
            found = rerank(found, self.reranker, top_k)
        return [r.asDict() for r in found.filter(F.col("fused_rank") <= top_k).drop("embedding", "lexemes").orderBy("query_id", "fused_rank").collect()]

    def _response(self, request: SearchRequest, rows: list[dict], took: float) -> SearchResponse:
        """Rows of one query, cut by the score that decides, with citations."""
        warnings = sorted({r["warning"] for r in rows if r.get("warning")})
        reranked = bool(self._reranks(request) and rows and not warnings)
        threshold = request.min_score
        if threshold is None:
            threshold = self.settings.min_rerank_score if reranked else self.settings.min_vector_score
        kept = [r for r in rows if (s := r.get("rerank_score") if reranked else r["vector_score"]) is not None and s >= threshold]
        results = [self._result(rank, r) for rank, r in enumerate(kept, 1)]
        context = "\n\n".join(f"{r['label']} {r['locator']}\n{r['text']}" for r in results)
        status, message = (OK, None) if results else (NO_RELEVANT_CONTEXT, NO_CONTEXT)
        return SearchResponse(request.query, request.filters, status, message, request.hybrid, reranked, threshold, results, context, took, warnings)

    @staticmethod
    def _result(rank: int, row: dict) -> dict:
        metadata = json.loads(row["metadata"] or "{}")
        title = metadata.get("title")
        title = title if isinstance(title, str) else None
        page = f", p. {row['page']}" if row["page"] is not None else ""
        scores = {k: None if row.get(k) is None else round(row[k], 6) for k in ("vector_score", "keyword_score", "rerank_score")}
        own = {k: row[k] for k in ("document_id", "filename", "file_type", "page", "chunk_index", "char_start", "char_end")}
        return {"rank": rank, "chunk_id": row["id"], "text": row["content"], "found_by": row["found_by"], **scores, "label": f"[{rank}]", "locator": (title or row["filename"]) + page, **own, "title": title, "metadata": metadata}

    #: What a call may override.
    OVERRIDES = ("top_k", "candidate_k", "filters", "hybrid", "rerank", "min_score")

    def invoke(self, query: str, **overrides) -> list[dict]:
        """Results as retriever documents: page_content and metadata with rank, scores and citation."""
        if unknown := sorted(set(overrides) - set(self.OVERRIDES)):
            raise TypeError(f"unknown search arguments: {', '.join(unknown)}")
        out = []
        for r in self.search(SearchRequest(query, **overrides)).results:
            citation = {k: r[k] for k in ("label", "locator", "document_id", "filename", "file_type", "page", "chunk_index", "char_start", "char_end", "title")}
            out.append({"page_content": r["text"], "metadata": {**r["metadata"], **{k: r[k] for k in ("rank", "found_by", "vector_score", "keyword_score", "rerank_score")}, "citation": citation}})
        return out


def _vector_only(near: DataFrame) -> DataFrame:
    """Ranked vector hits in the shape of fused ones."""
    return near.withColumnRenamed("rank", "fused_rank").withColumn("keyword_score", F.lit(None).cast("double")).withColumn("found_by", F.lit("vector"))
