"""A knowledge base as one object: what the command line and the HTTP server offer."""

from __future__ import annotations

import datetime
import json
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.model import SearchRequest, SearchResponse
from brindle.operators import evaluate, index, versions
from brindle.operators.answer import Chat, extractive, generate_answer
from brindle.operators.evaluate import BACKOFF
from brindle.operators.embed import Embedder, HashingEmbedder
from brindle.operators.ingest import ATTEMPTS, Ingestor, validate_metadata
from brindle.operators.rerank import Reranker
from brindle.operators.retriever import Retriever
from brindle.plans.store import HEAD, ConcurrentWrite, Store
from brindle.sources.files import read_files

UPLOAD_FIELDS = ["filename", "content", "metadata", "doc_key", "replace", "valid_from", "valid_until", "review_by"]
_UPLOAD = "filename string, content binary, metadata string, doc_key string, replace boolean, valid_from date, valid_until date, review_by date"


class KnowledgeBase:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, chat: Chat = extractive, judge: evaluate.Judge = evaluate.overlap_judge):
        self.spark, self.settings = spark, settings or Settings.from_env()
        self.chat, self.judge = chat, judge
        self.embedder, self.reranker = embedder or HashingEmbedder(self.settings.embedding_dim), reranker
        self.store = Store(spark, f"{self.settings.base_path.rstrip('/')}/{self.settings.schema}")

    def init(self) -> str:
        if not self.store.last or self.store.revision != HEAD:
            self.store.migrate(HEAD)
        self.store.check(self.settings.embedding_dim)
        return f"schema version {self.store.revision}"

    def upload(self, filename: str, content: bytes, metadata: dict | None = None, doc_key: str | None = None, replace: bool = False, valid_from: datetime.date | None = None, valid_until: datetime.date | None = None, review_by: datetime.date | None = None) -> dict[str, Any]:
        """Ingests one file; refusals are results with an error, not exceptions."""
        return self.upload_all([{"filename": filename, "content": content, "metadata": metadata, "doc_key": doc_key, "replace": replace, "valid_from": valid_from, "valid_until": valid_until, "review_by": review_by}])[0]

    def upload_all(self, files: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Ingests files as one batch, in their order; one result for each, in the same order."""
        out: dict[int, dict[str, Any]] = {}
        rows = []
        for i, given in enumerate(files):
            if unknown := sorted(set(given) - set(UPLOAD_FIELDS)):
                raise TypeError(f"unknown upload fields: {', '.join(unknown)}")
            try:
                metadata = json.dumps(validate_metadata(given.get("metadata")), ensure_ascii=False)
            except ValueError as e:
                out[i] = {"filename": given["filename"], "status": "error", "error": str(e)}
                continue
            rows.append((f"{i:09}", *(metadata if f == "metadata" else bool(given.get(f)) if f == "replace" else given.get(f) for f in UPLOAD_FIELDS)))
        if rows:
            found = self._ingest(self.spark.createDataFrame(rows, f"path string, {_UPLOAD}"))
            out |= dict(zip((int(r[0]) for r in rows), found, strict=True))
        return [out[i] for i in range(len(files))]

    def ingest_path(self, path: str, metadata: dict | None = None, replace: bool = False, doc_key: str | None = None, valid_from: datetime.date | None = None, valid_until: datetime.date | None = None, review_by: datetime.date | None = None) -> list[dict[str, Any]]:
        """Ingests a file, whatever its type, or all supported files of a folder and its subfolders, in order of path."""
        given = json.dumps(validate_metadata(metadata), ensure_ascii=False)
        fs, at = self.store._fs(path)
        if fs.getFileStatus(at).isDirectory():
            if doc_key is not None:
                raise ValueError("doc_key is for a single file")
            files = read_files(self.spark, path)
        else:
            files = self.spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
        days = {"valid_from": valid_from, "valid_until": valid_until, "review_by": review_by}
        own = {"metadata": F.lit(given), "replace": F.lit(replace), "doc_key": F.lit(doc_key).cast("string"), **{k: F.lit(v).cast("date") for k, v in days.items()}}
        return self._ingest(files.select("path", "filename", "content").withColumns(own))

    def _ingest(self, files: DataFrame) -> list[dict[str, Any]]:
        """Results in order of path."""
        rows = Ingestor(self.store, self.embedder, self.settings).ingest(files).collect()
        return [{k: v for k, v in r.asDict().items() if k != "path"} for r in sorted(rows, key=lambda r: (r.path or "", r.filename))]

    def search(self, request: SearchRequest) -> SearchResponse:
        return self._retriever().search(request)

    def build_index(self) -> str:
        """Indexes the vectors of the last commit for approximate search; later commits are searched exactly until they are indexed."""
        path = f"{self.store.path}/index/{self.store.last}"
        index.build(self.store.read("chunks"), path)
        return path

    def _retriever(self) -> Retriever:
        path = f"{self.store.path}/index/{self.store.last}"
        fs, at = self.store._fs(f"{path}/centres/_SUCCESS")
        return Retriever(self.store.read("documents"), self.store.read("chunks"), self.embedder, self.reranker, self.settings, index=path if fs.exists(at) else None)

    def documents(self, limit: int = 100, offset: int = 0, include_history: bool = False) -> list[dict]:
        return [r.asDict() for r in versions.list_documents(self.store.read("documents"), limit, offset, include_history).collect()]

    def document(self, doc_id: str) -> dict | None:
        found = versions.find(self.store.read("documents"), id=doc_id).drop("content_hash").first()
        return found.asDict() if found else None

    def document_versions(self, doc_id: str) -> list[dict] | None:
        own = self.document(doc_id)
        return [r.asDict() for r in versions.document_versions(self.store.read("documents"), own["doc_key"]).drop("content_hash").collect()] if own else None

    def delete(self, doc_id: str) -> bool:
        """Deletes one version and its chunks; False if there is none."""
        if self.document(doc_id) is None:
            return False
        for left in range(ATTEMPTS - 1, -1, -1):
            base = self.store.last
            kept = versions.delete_versions(self.store.read("documents"), self.spark.createDataFrame([(doc_id,)], "id string"))
            try:
                self.store.write(kept, base=base)  # chunks go with their document
                return True
            except ConcurrentWrite:
                if not left:
                    raise
        return False

    def evaluate(self, cases: DataFrame, compare: bool = False, top_k: int = 3, min_score: float | None = None, hybrid: bool = True, rerank: bool = True, delay: float = 0.0) -> dict[str, dict]:
        """Metrics of all labelled questions, by configuration: vector, hybrid and hybrid with rerank if compared.

        In each configuration questions with the same filters are searched as one batch; with a ``delay`` between reranked searches,
        which remote rerankers may ask for, they are searched one by one.
        """
        modes = {"vector": (False, False), "hybrid": (True, False), "hybrid+rerank": (True, True)} if compare else {"default": (hybrid, rerank)}
        asked = cases.collect()
        requests = {name: [SearchRequest(c.question, top_k=top_k, filters=json.loads(c.filters) if c.filters else None, hybrid=h, rerank=r, min_score=min_score) for c in asked] for name, (h, r) in modes.items()}
        out = {}
        retriever = self._retriever()
        for name, (_, reranked) in modes.items():
            if delay and reranked and self.reranker is not None:
                found = []
                for i, request in enumerate(requests[name]):
                    if i:
                        time.sleep(delay)
                    found.append(retriever.search(request))
            else:
                found = retriever.search_all(requests[name])
            rows = [(c.id, x["rank"], x["filename"], x["page"], x["text"]) for c, r in zip(asked, found, strict=True) for x in r.results]
            states = [(c.id, r.status, r.reranked, r.took_ms) for c, r in zip(asked, found, strict=True)]
            results = self.spark.createDataFrame(rows, "id string, rank int, filename string, page int, text string")
            statuses = self.spark.createDataFrame(states, "id string, status string, reranked boolean, took_ms double")
            scored = evaluate.score_cases(cases, results, statuses)
            out[name] = {"summary": evaluate.summarize(scored, reranked and self.reranker is not None).first().asDict(), "failures": [r.asDict() for r in evaluate.failures(scored).collect()], "cases": [r.asDict() for r in scored.collect()]}
        return out

    def judge_cases(self, cases: DataFrame, metrics: str = "all", top_k: int = 3, min_score: float | None = None, hybrid: bool = True, rerank: bool = True, delay: float = 0.0, only: list[str] | None = None, limit: int | None = None, out: str | None = None, resume: bool = False, backoff: tuple[float, ...] = BACKOFF) -> dict[str, Any]:
        """A judged run over the labelled questions that have a reference: {summary, cases}; saved to ``out`` after every question.

        With ``resume`` questions that ``out`` holds with these metrics are reused, and failed ones tried again.
        """
        chosen, skipped = evaluate.select_cases(cases, only, limit)
        names = evaluate.METRIC_SETS[metrics]
        asked = [c.asDict() for c in chosen.orderBy("seq").collect()]
        done = evaluate.read_report(out) if resume and out and os.path.exists(out) else {}
        retriever = self._retriever()

        def search(case: dict) -> SearchResponse:
            return retriever.search(SearchRequest(case["question"], top_k=top_k, filters=json.loads(case["filters"]) if case["filters"] else None, hybrid=hybrid, rerank=rerank, min_score=min_score))

        def save(so_far: list[dict], complete: bool = False) -> dict[str, Any]:
            summary = evaluate.report_summary(so_far, names, skipped, rerank and self.reranker is not None)
            if out:
                evaluate.write_report(out, so_far, complete, summary)
            return summary

        found = evaluate.run_judged(search, asked, self.judge, names, lambda r: generate_answer(r, self.chat), done, delay, backoff, save)
        return {"summary": save(found, all(c["status"] not in evaluate.FAILED for c in found)), "cases": found}
