"""An optional index of vectors: one folder for each cell of spherical k-means, so that a search reads only the cells next to its vector.

Scores are exact; only which items are looked at is approximate. Centres are fitted on a bounded sample; every item is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.search import batch_vector_topk

#: Bounds of the fit: vectors sampled, centres, rounds.
FIT_ROWS, MOST_CELLS, ROUNDS = 20_000, 1024, 10
#: Share of the cells that a search reads, the nearest first.
PROBED = 0.5


def _plain(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``size`` finite components that are not all 0, and these at norm 1."""
    whole = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    rows = pc.fill_null(column.take(pa.array(whole)).flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    fine = np.isfinite(rows).all(1)
    return whole[fine], rows[fine]


def fit(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Centres of norm 1: each round vectors go to the centre of the greatest product, and centres to the normed sums of theirs."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def build(items: DataFrame, path: str, cells: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Writes the index of ``items`` to ``path``: their ids and vectors by cell, and the centres.

    Vectors that are null or zero, of another length than most or with odd components have no nearest centre and a cell of their own, -1.
    """
    spark = items.sparkSession
    given = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    sizes = given.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
    centres = np.zeros((0, size))
    if n and size:
        drawn = given.filter(F.size("embedding") == size).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30)))
        _, sample = _plain(drawn.select("embedding").limit(2 * FIT_ROWS).toArrow()["embedding"].combine_chunks(), size)
        if len(sample):
            centres = fit(sample, cells or max(1, min(MOST_CELLS, round(n**0.5))))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(sent.value):
                at, rows = _plain(batch.column(1), sent.value.shape[1])
                cell[at] = (rows @ sent.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "embedding", "cell"])

    schema = f"id {given.schema['id'].dataType.simpleString()}, embedding {given.schema['embedding'].dataType.simpleString()}, cell int"
    dealt = given.mapInArrow(assign, schema).repartitionByRange("cell", "id")  # a cell of any size lies in few files, a large one in several
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    spark.createDataFrame([(schema,)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")  # for an index without rows
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def near_cells(spark: SparkSession, path: str, vectors: list[list[float]], probed: float = PROBED) -> DataFrame:
    """Items (id, embedding) of the nearest cells of any of ``vectors``; other folders are not read."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").limit(MOST_CELLS).collect()
    items = spark.read.schema(spark.read.text(f"{path}/schema").first()[0]).parquet(f"{path}/items")
    if not rows:
        return items.select("id", "embedding")
    centres = np.array([r["centre"] for r in rows])
    plain = np.array([v for v in vectors if len(v) == centres.shape[1]], np.float64).reshape(-1, centres.shape[1])
    nearest = np.argsort(-(plain @ centres.T), axis=1)[:, : max(1, round(probed * len(centres)))]
    return items.filter(F.col("cell").isin(sorted({rows[i]["cell"] for i in nearest.ravel().tolist()}))).select("id", "embedding")


def batch_topk(spark: SparkSession, path: str, queries: DataFrame, k: int, probed: float = PROBED) -> DataFrame:
    """(query_id, id, vector_score, rank) of the ``k`` nearest items, in the cells read, of every query (query_id, query_vector) of a stated set."""
    vectors = [list(r["query_vector"]) for r in queries.select("query_vector").filter("query_vector IS NOT NULL").collect()]
    return batch_vector_topk(near_cells(spark, path, vectors, probed), queries, k)
