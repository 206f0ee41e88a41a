"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brindle.llm import bpe
from brindle.llm.memory import release


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    ``vocabulary`` is the path of a byte-level BPE file (tokenizers JSON). A pre-token's count is its initial
    symbols less the merges made by popping the lowest-ranked adjacent pair; no ids are produced. Equal
    pre-tokens are merged once per worker. There is no shuffle: a scan, one Arrow pass, the result.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; null ids stay null;
    other columns of ``docs`` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.merge_counter(vocabulary)
        for batch in batches:
            texts = bpe.filled(batch.column(1))
            n_tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            release()

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
