"""Ingestion of files: sections, chunks, metadata, embeddings, versions, one snapshot."""

from __future__ import annotations

import datetime
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.config import Settings
from brindle.functions.text import lexemes
from brindle.model import DOCUMENTS, RESERVED_KEYS
from brindle.operators import versions
from brindle.operators.chunk import chunk
from brindle.operators.embed import Embedder, HashingEmbedder, embed_each
from brindle.operators.ocr import PageOcr
from brindle.plans.recovery import checkpoint
from brindle.plans.store import ConcurrentWrite, Store
from brindle.sources.files import sections
from brindle.sources.loaders import PageReader


#: Times that a batch is tried while other writers are faster.
ATTEMPTS = 5


def validate_metadata(metadata: Any) -> dict[str, Any]:
    """An object without reserved keys that JSON can hold; None is empty."""
    if metadata is None:
        return {}
    if not isinstance(metadata, dict):
        raise ValueError("metadata is a JSON object")
    if taken := sorted(set(metadata) & set(RESERVED_KEYS)):
        raise ValueError(f"metadata keys are reserved: {', '.join(taken)}")
    try:
        json.dumps(metadata)
    except TypeError as e:
        raise ValueError(f"metadata is not JSON: {e}") from e
    return metadata


def reserved_used(metadata: Column) -> Column:
    """Reserved keys that a column of JSON text uses, sorted."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in RESERVED_KEYS])))


def merged_metadata(*parts: Column) -> Column:
    """JSON objects joined, later keys before earlier ones; nested values are kept as they are."""

    @F.pandas_udf("string")
    def join(*columns: pd.Series) -> pd.Series:
        out = []
        for texts in zip(*columns, strict=True):
            one: dict[str, Any] = {}
            for text in texts:
                one |= json.loads(text) if text else {}
            out.append(json.dumps(one, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return join(*parts)


class Ingestor:
    """Ingests batches of files (filename, content, and optionally metadata, doc_key, replace, valid_from, valid_until, review_by)."""

    OPTIONAL = {"metadata": "string", "doc_key": "string", "replace": "boolean", "valid_from": "date", "valid_until": "date", "review_by": "date"}

    def __init__(self, store: Store, embedder: Embedder | None = None, settings: Settings | None = None, analyser: str | None = None, ocr: PageReader | None = None):
        self.store, self.settings = store, settings or Settings()
        self.analyser = analyser or self.settings.analyser
        self.embedder = embedder or HashingEmbedder(self.settings.embedding_dim)
        self.ocr = ocr or PageOcr(self.settings)

    def ingest(self, files: DataFrame) -> DataFrame:
        """One row per file: path, filename, status (ingested, duplicate or error), document_id, num_chunks, doc_key, version, superseded_id, error.

        Files are told apart by a number of their own, whatever their names and bytes. Within a batch they come one after the other in
        order of ``path``, where there is one, and name. A file that cannot be parsed or embedded is an error of its own. Where another
        writer's commit comes between, all is done again on top of it, so that equal files of both are duplicates.
        """
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                return self._ingest(files)
            except ConcurrentWrite:
                if not left:
                    raise
        raise AssertionError("the last attempt returns or raises")

    def _ingest(self, files: DataFrame) -> DataFrame:
        for name, kind in ({"path": "string"} | self.OPTIONAL).items():
            if name not in files.columns:
                files = files.withColumn(name, F.lit(None).cast(kind))
        now = F.lit(datetime.datetime.now(datetime.UTC)).cast("timestamp")
        given = files.withColumn("doc_key", versions.doc_key(F.col("doc_key"), F.col("filename"))).withColumn("content_hash", F.sha2("content", 256)).withColumn("size_bytes", F.length("content").cast("long"))
        given = given.withColumn("file", F.monotonically_increasing_id())
        used = reserved_used(F.coalesce("metadata", F.lit("{}")))
        wrong = F.coalesce(versions.upload_errors(given, self.settings.max_upload_mb << 20), F.when(F.size(used) > 0, F.concat(F.lit("metadata keys are reserved: "), F.array_join(used, ", "))))
        given = checkpoint(given.withColumn("error", wrong))
        given = given.withColumn("seq", F.struct("path", "filename", "file")).withColumn("id", F.sha2(F.concat_ws("\0", "doc_key", "content_hash", "file", F.date_format(now, "yyyyMMddHHmmssSSSSSS")), 256))
        base = self.store.last
        stored = self.store.read("documents")
        # a file that turns out unreadable must not make later ones with its bytes duplicates of it: equal bytes fail alike but for their names
        sound = given.filter("error IS NULL")
        known = versions.stored_duplicates(sound.drop("content"), stored)
        wanted = sound.join(known.filter("duplicate_of IS NULL").select("file"), "file", "left_semi")
        parsed = checkpoint(sections(wanted, "file", self.ocr).withColumn("file", F.col("file").cast("long")))
        text = parsed.filter("error IS NULL")
        keyed = text.withColumn("key", F.struct("file", "section"))
        tokenizer = self.settings.tokenizer if self.settings.chunk_unit == "tokens" else None
        pieces = chunk(keyed, self.settings.chunk_size, self.settings.chunk_overlap, "key", "text", "structured", tokenizer)
        pieces = pieces.select("id.file", "id.section", F.col("chunk_index").alias("piece"), "content", "char_start", "char_end")
        readable = pieces.select("file", F.lit(True).alias("readable")).distinct()
        first = checkpoint(versions.batch_duplicates(known.join(readable, "file", "left"), F.coalesce("readable", F.lit(False))))
        fresh = first.filter("duplicate_of IS NULL AND readable")
        order = versions.Window.partitionBy("file").orderBy("section", "piece")
        pieces = pieces.join(fresh.select("file"), "file", "left_semi").withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
        pieces = checkpoint(pieces.withColumn("made", embed_each(F.col("content"), self.embedder, self.settings.embedding_batch)))
        counts = pieces.groupBy("file").agg(F.count("*").cast("int").alias("num_chunks"), F.max("made.error").alias("embed_error"))
        facts = text.filter("section = 0").select("file", "file_type", F.col("metadata").alias("found"))
        good = fresh.join(counts.filter("embed_error IS NULL"), "file").join(facts, "file")
        numbered = checkpoint(versions.assign_versions(good, stored))
        documents = numbered.select(
            "id", "filename", "file_type", "content_hash", "size_bytes", merged_metadata(F.col("found"), F.col("metadata")).alias("metadata"), "num_chunks", now.alias("created_at"),
            "doc_key", "version", "is_current", F.when(~F.col("is_current"), now).alias("superseded_at"), "valid_from", "valid_until", "review_by",
        )
        documents = checkpoint(documents)
        pages = text.select("file", "section", "page", "ocr")
        owners = documents.select("id", "filename", "file_type", "metadata", "doc_key", "version", "created_at").join(numbered.select("id", "file"), "id")
        owned = pieces.join(pages, ["file", "section"]).join(owners, "file")
        page = F.coalesce(F.col("page").cast("string"), F.lit("null"))
        pipeline = F.to_json(F.struct(F.col("id").alias("document_id"), "filename", "file_type", "chunk_index", "char_start", "char_end", F.col("created_at").alias("uploaded_at"), "doc_key", "version"))
        metadata = merged_metadata(F.col("metadata"), F.when(F.col("ocr"), F.lit('{"ocr": true}')), pipeline, F.concat(F.lit('{"page": '), page, F.lit("}")))
        chunks = owned.select(
            F.sha2(F.concat_ws("\0", "id", "chunk_index"), 256).alias("id"), F.col("id").alias("document_id"), "chunk_index", "content", "page", "char_start", "char_end",
            metadata.alias("metadata"), F.col("made.vector").alias("embedding"), lexemes(F.col("content"), self.analyser).alias("lexemes"),
        )
        if not numbered.isEmpty():
            kept = versions.supersede(stored, numbered.select("doc_key", "replace"), now).select(*T._parse_datatype_string(DOCUMENTS).names)
            self.store.write(kept.unionByName(documents), added=chunks, base=base)
        failed = parsed.filter("error IS NOT NULL").select("file", F.col("error").alias("parse_error"))
        done = numbered.select("file", "version", "superseded_id")
        joined = given.select("file", "id", "path", "filename", "doc_key", "error").join(first.select("file", "duplicate_of"), "file", "left").join(failed, "file", "left")
        joined = joined.join(counts.select("file", "embed_error", F.col("num_chunks").alias("made")), "file", "left").join(done, "file", "left")
        # made but without a version: a later file of the batch replaced its key
        ok, twice = F.col("made").isNotNull() & F.col("embed_error").isNull(), F.col("duplicate_of").isNotNull()
        error = F.coalesce("error", "parse_error", "embed_error", F.when(~ok & ~twice, "no extractable text"))
        return joined.select(
            "path", "filename", F.when(twice, "duplicate").when(ok, "ingested").otherwise("error").alias("status"),
            F.when(twice, F.col("duplicate_of")).when(ok, F.col("id")).alias("document_id"), F.when(ok, F.col("made")).otherwise(0).alias("num_chunks"),
            F.when(ok, F.col("doc_key")).alias("doc_key"), "version", "superseded_id", F.when(~ok & ~twice, error).alias("error"),
        )
