"""Schemas of the stored tables, and requests and responses of a search."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DOCUMENTS = (
    "id string, filename string, file_type string, content_hash string, size_bytes bigint, metadata string, num_chunks int, created_at timestamp, "
    "doc_key string, version int, is_current boolean, superseded_at timestamp, valid_from date, valid_until date, review_by date"
)
CHUNKS = "id string, document_id string, chunk_index int, content string, page int, char_start int, char_end int, metadata string, embedding array<float>, lexemes array<string>"
#: What a listing of documents shows.
DOCUMENT_INFO = ["id", "filename", "file_type", "size_bytes", "num_chunks", "metadata", "created_at", "doc_key", "version", "is_current", "superseded_at", "valid_from", "valid_until", "review_by"]
#: Keys that the pipeline sets on every chunk and uploads may not (fixed values).
RESERVED_KEYS = ["document_id", "filename", "file_type", "chunk_index", "page", "char_start", "char_end", "uploaded_at", "ocr", "doc_key", "version"]
# Fixed values of responses.
NO_CONTEXT = "No relevant information was found in the knowledge base for this question."
OK, NO_RELEVANT_CONTEXT = "ok", "no_relevant_context"


@dataclass(frozen=True)
class SearchRequest:
    """One search. ``min_score`` None takes the default of the score that decides."""

    query: str
    top_k: int = 3
    candidate_k: int = 40
    filters: dict[str, Any] | None = None
    hybrid: bool = True
    rerank: bool = True
    min_score: float | None = None

    def __post_init__(self):
        if not self.query:
            raise ValueError("query must not be empty")
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k is 1 to 100")
        if not 1 <= self.candidate_k <= 1000:
            raise ValueError("candidate_k is 1 to 1000")


@dataclass
class SearchResponse:
    """A finished search: ``results`` are dicts, best first."""

    query: str
    filters: dict[str, Any] | None
    status: str
    message: str | None
    hybrid: bool
    reranked: bool
    min_score_applied: float
    results: list[dict[str, Any]]
    context: str
    took_ms: float
    warnings: list[str] = field(default_factory=list)
