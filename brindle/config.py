"""Settings, read from environment variables with the prefix ``BRINDLE_`` unless given."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

_SCHEMA = re.compile(r"[a-z_][a-z0-9_]*")


@dataclass(frozen=True)
class Settings:
    """Knobs of ingestion and search. One base path or schema name is one knowledge base.

    Documents and questions have to be analysed and chunked by the same settings throughout the life of a knowledge base.
    """

    base_path: str = "brindle-store"
    schema: str = "public"
    embedding_dim: int = 64
    embedding_batch: int = 128
    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_unit: str = "chars"
    tokenizer: str = ""
    analyser: str = "english"
    default_top_k: int = 3
    default_candidate_k: int = 40
    min_rerank_score: float = 0.8
    min_vector_score: float = 0.2
    ocr_mode: str = "auto"
    ocr_engine: str = "rapidocr"
    ocr_dpi: int = 300
    ocr_min_chars: int = 20
    ocr_min_confidence: float = 0.5
    ocr_lang: str = "eng"
    max_upload_mb: int = 50

    def __post_init__(self):
        if not _SCHEMA.fullmatch(self.schema):
            raise ValueError(f"schema name {self.schema!r} must match {_SCHEMA.pattern}")
        if self.ocr_mode not in ("off", "auto", "force"):
            raise ValueError("ocr_mode is off, auto or force")
        if self.ocr_engine not in ("rapidocr", "tesseract"):
            raise ValueError("ocr_engine is rapidocr or tesseract")
        if self.chunk_unit not in ("chars", "tokens"):
            raise ValueError("chunk_unit is chars or tokens")
        if self.chunk_unit == "tokens" and not self.tokenizer:
            raise ValueError("chunk_unit tokens needs tokenizer, the path of a tokenizers JSON file")
        if self.analyser not in ("simple", "english"):
            raise ValueError("analyser is simple or english")

    @staticmethod
    def from_env(**given) -> Settings:
        kinds = {"int": int, "float": float, "str": str}
        own = {f.name: kinds[f.type](os.environ[f"BRINDLE_{f.name.upper()}"]) for f in fields(Settings) if f"BRINDLE_{f.name.upper()}" in os.environ}
        return Settings(**(own | given))
