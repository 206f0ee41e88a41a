"""Files as rows, and rows of files as sections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.loaders import LOADERS, PageReader, load

SUPPORTED = "(?i)(" + "|".join(re.escape(x) for x in sorted(LOADERS)) + ")$"


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, filename, size_bytes, content) of the supported files below a folder; other files are left out.

    Rows have no order of their own; ``path`` tells files of one name apart, and ingestion numbers versions by it.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), "content")
    return named.filter(F.col("filename").rlike(SUPPORTED))


def sections(files: DataFrame, key: str = "filename", ocr: PageReader | None = None) -> DataFrame:
    """Sections of files (``key``, filename, content): file (the key), filename, file_type, structured, section, text, page, ocr, metadata (JSON), error.

    A file that cannot be read is one row with its error; the others are not disturbed. ``ocr`` reads pages without a text layer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "filename", "file_type", "structured", "section", "text", "page", "ocr", "metadata", "error"]
        for batch in batches:
            rows = []
            for file, name, data in zip(batch["file"], batch["filename"], batch["content"], strict=True):
                try:
                    got = load(name, bytes(data), ocr)
                except Exception as e:  # parsers fail in many ways; each is that file's error
                    rows.append((file, name, None, None, 0, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(file, name, got.file_type, got.structured, i, s.text, s.page, s.ocr, json.dumps(got.metadata, ensure_ascii=False), None) for i, s in enumerate(got.sections)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"page": "Int32", "structured": "boolean", "ocr": "boolean"})

    schema = "file string, filename string, file_type string, structured boolean, section int, text string, page int, ocr boolean, metadata string, error string"
    return files.select(F.col(key).cast("string").alias("file"), "filename", "content").mapInPandas(run, schema)


CASES = "id string, question string, expected array<struct<filename:string,page:int,contains:string>>, filters string, reference string, seq int"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions of a JSONL file, of any file system that Spark can read: blank lines and lines with # are skipped, ids default to line numbers; faults name file and line."""
    rows = []
    data = spark.read.format("binaryFile").load(path).first()["content"]
    for n, line in enumerate(bytes(data).decode("utf-8").splitlines(), 1):
        if not line.strip() or line.strip().startswith("#"):
            continue
        rows.append(parse_case(line, n, f"{path}:{n}"))
    if not rows:
        raise ValueError(f"{path}: no questions")
    return spark.createDataFrame(rows, CASES)


def parse_case(line: str, n: int, where: str) -> tuple:
    try:
        case = json.loads(line)
    except ValueError as e:
        raise ValueError(f"{where}: invalid JSON: {e}") from e
    if not isinstance(case, dict) or not case.get("question"):
        raise ValueError(f"{where}: a question is missing")
    keys = {"filename", "page", "contains"}
    expected = case.get("expected", [])
    if any(not isinstance(x, dict) or not x or set(x) - keys for x in expected):
        raise ValueError(f"{where}: expected items hold {', '.join(sorted(keys))}")
    reference = case.get("reference")
    if reference is not None and (not isinstance(reference, str) or not reference.strip()):
        raise ValueError(f"{where}: reference is a text that is not blank")
    filters = json.dumps(case["filters"]) if case.get("filters") else None
    return str(case.get("id", n)), case["question"], [(x.get("filename"), x.get("page"), x.get("contains")) for x in expected], filters, reference, n
