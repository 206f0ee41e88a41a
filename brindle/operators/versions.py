"""Versioned documents: duplicates, new versions, superseding, deletion, listings, repair. All are windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.model import DOCUMENT_INFO


def doc_key(given: Column, filename: Column) -> Column:
    """The given key or else the file's name, without white space around it."""
    return F.regexp_replace(F.coalesce(F.nullif(given, F.lit("")), filename), r"(?U)^\s+|\s+$", "")


def upload_errors(uploads: DataFrame, max_bytes: int) -> Column:
    """Why an upload (doc_key, size_bytes, valid_from, valid_until) is refused; NULL if it is not."""
    return (
        F.when(F.length("doc_key") == 0, "doc_key must not be empty")
        .when(F.col("valid_until") < F.col("valid_from"), "valid_until is before valid_from")
        .when(F.col("size_bytes") > max_bytes, f"file is larger than {max_bytes} bytes")
    )


def mark_duplicates(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds duplicate_of: the id of the stored document, or of the first upload, with the same bytes; else NULL.

    The check is global: keys and superseded versions make no difference. An upload with ``replace`` is no duplicate of a
    document of its own key. Needs id, seq, doc_key, content_hash, replace.
    """
    return batch_duplicates(stored_duplicates(uploads, stored))


def _again(known: str) -> Column:
    """Whether an upload replaces the document ``known`` of its own key."""
    return F.coalesce("replace", F.lit(False)) & (F.col(f"{known}.doc_key") == F.col("doc_key"))


def stored_duplicates(uploads: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Adds duplicate_of as far as documents are stored."""
    if stored is None:
        return uploads.withColumn("duplicate_of", F.lit(None).cast("string"))
    known = stored.groupBy("content_hash").agg(F.min_by(F.struct("id", "doc_key"), "created_at").alias("_known"))
    joined = uploads.join(known, "content_hash", "left")
    return joined.withColumn("duplicate_of", F.when(~_again("_known"), F.col("_known.id"))).drop("_known")


def batch_duplicates(uploads: DataFrame, readable: Column | None = None) -> DataFrame:
    """Sets duplicate_of of uploads after the first ``readable`` one with their bytes, if that is no duplicate itself."""
    candidate = F.col("duplicate_of").isNull() & (F.lit(True) if readable is None else readable)
    first = uploads.filter(candidate).groupBy("content_hash").agg(F.min_by(F.struct("id", "doc_key", "seq"), "seq").alias("_first"))
    joined = uploads.join(first, "content_hash", "left")
    later = (F.col("seq") > F.col("_first.seq")) & ~_again("_first")
    return joined.withColumn("duplicate_of", F.coalesce("duplicate_of", F.when(later, F.col("_first.id")))).drop("_first")


def assign_versions(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds version, is_current and superseded_id to uploads that are no duplicates, by seq within their key.

    Numbers follow the highest that is stored; after a ``replace`` they begin at 1 and what came before it in its key is gone.
    """
    by_key = Window.partitionBy("doc_key").orderBy("seq")
    fresh = uploads.withColumn("_era", F.sum(F.coalesce("replace", F.lit(False)).cast("int")).over(by_key))
    fresh = fresh.withColumn("_last", F.max("_era").over(Window.partitionBy("doc_key"))).filter("_era = _last")
    if stored is not None:
        known = stored.groupBy("doc_key").agg(F.max("version").alias("_max"), F.max_by("id", F.when(F.col("is_current"), F.col("version"))).alias("_current"))
        fresh = fresh.join(known, "doc_key", "left")
    else:
        fresh = fresh.withColumn("_max", F.lit(None).cast("int")).withColumn("_current", F.lit(None).cast("string"))
    base = F.when(F.col("_era") == 0, F.coalesce("_max", F.lit(0))).otherwise(0)
    before = F.coalesce(F.lag("id").over(by_key), F.when(F.col("_era") == 0, F.col("_current")))
    out = fresh.withColumn("version", (base + F.row_number().over(by_key)).cast("int")).withColumn("superseded_id", before)
    return out.withColumn("is_current", F.lead("id").over(by_key).isNull()).drop("_era", "_last", "_max", "_current")


def next_version(stored: DataFrame) -> DataFrame:
    """(doc_key, next_version): one above the highest left, so the number of a deleted top version comes again."""
    return stored.groupBy("doc_key").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def supersede(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``stored`` after ``new`` (doc_key, replaces) took over: replaced keys are gone, other current versions superseded."""
    keys = new.groupBy(F.col("doc_key").alias("_key")).agg(F.max(F.coalesce("replace", F.lit(False))).alias("_replaced"))
    joined = stored.join(keys, stored["doc_key"] == keys["_key"], "left").filter(~F.coalesce("_replaced", F.lit(False)))
    over = F.col("_key").isNotNull() & F.col("is_current")
    return joined.withColumn("superseded_at", F.when(over, now).otherwise(F.col("superseded_at"))).withColumn("is_current", F.col("is_current") & ~over).drop("_key", "_replaced")


def delete_versions(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the ids of ``gone``; where the current version went, the highest left becomes current."""
    marked = stored.join(gone.select(F.col("id").alias("_gone")).distinct(), stored["id"] == F.col("_gone"), "left")
    key = Window.partitionBy("doc_key")
    lost = F.max(F.col("_gone").isNotNull() & F.col("is_current")).over(key)
    left = marked.withColumn("_lost", lost).filter("_gone IS NULL")
    top = F.row_number().over(key.orderBy(F.col("version").desc())) == 1
    promoted = left.withColumn("_up", F.col("_lost") & top)
    return promoted.withColumn("superseded_at", F.when(~F.col("_up"), F.col("superseded_at"))).withColumn("is_current", F.col("is_current") | F.col("_up")).drop("_gone", "_lost", "_up")


def cascade(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is there."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def keep_newest_current(stored: DataFrame, now: Column) -> DataFrame:
    """Leaves one current version per key, the newest; demoted ones are superseded now."""
    rank = F.row_number().over(Window.partitionBy("doc_key", "is_current").orderBy(F.col("created_at").desc(), "id"))
    extra = F.col("is_current") & (F.col("_rank") > 1)
    ranked = stored.withColumn("_rank", rank)
    return ranked.withColumn("superseded_at", F.when(extra, now).otherwise(F.col("superseded_at"))).withColumn("is_current", F.col("is_current") & ~extra).drop("_rank")


def list_documents(stored: DataFrame, limit: int = 100, offset: int = 0, include_history: bool = False) -> DataFrame:
    """A page of the listing, newest first, ties by id."""
    rows = stored if include_history else stored.filter("is_current")
    return rows.select(*[c for c in DOCUMENT_INFO if c in stored.columns]).orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def document_versions(stored: DataFrame, key: str) -> DataFrame:
    return stored.filter(F.col("doc_key") == key).orderBy(F.col("version").desc())


def find(stored: DataFrame, **equal: str) -> DataFrame:
    """Point lookup by id, doc_key or content_hash."""
    out = stored
    for column, value in equal.items():
        if column not in ("id", "doc_key", "content_hash"):
            raise ValueError(f"no lookup by {column}")
        out = out.filter(F.col(column) == value)
    return out
