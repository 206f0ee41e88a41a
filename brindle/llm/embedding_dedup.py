"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.components import components, roots
from brindle.plans.recovery import checkpoint

#: Bounds of the fit: vectors sampled, cells at most, rounds of k-means.
FIT_ROWS, MOST_CELLS, ROUNDS = 20_000, 1024, 8
#: Vectors of a block.
BLOCK = 8192
#: Rows of one product.
STRIP = 512
_SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_cells(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means: assignment by greatest dot product, centres as normed sums."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def block_links(left: np.ndarray, right: np.ndarray | None, left_weight: np.ndarray, right_weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked to every row of ``left`` and then of ``right`` (None: ``left`` with itself), and the root of each in the block's own components."""
    own = right is None
    other = left if own else right
    n, m = len(left), 0 if own else len(other)
    counts, parent = np.zeros(n + m, np.int64), np.arange(n + m)
    for at in range(0, n, STRIP):
        linked = left[at : at + STRIP] @ other.T >= cosine
        if own:
            linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
        a, b = np.nonzero(linked)
        if not len(a):
            continue
        a += at
        counts[:n] += np.bincount(a, weights=right_weight[b], minlength=n).astype(np.int64)
        if not own:
            counts[n:] += np.bincount(b, weights=left_weight[a], minlength=m).astype(np.int64)
        parent = roots(n + m, a, b + (0 if own else n), parent)
    return counts, parent


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (smallest id reachable by links), kept.

    Vectors whose cosine in double precision is at least ``cosine`` are linked, all such pairs and no others. Equal vectors form a
    class, of which one takes part with its count. A class is at home in the cell of its nearest centre. Two linked
    vectors with homes c and d both lie within the link's chord of the plane that parts c from d, so a vector meets its own
    cell and each cell whose plane is that near: no link is missed whatever the centres, and tight clusters meet few cells. Cells are
    cut into blocks; a task multiplies two blocks and returns, for each vector that it linked, a count and a root.

    Vectors of each length are joined among themselves. Null and zero vectors, those with null or non-finite components, and null ids
    link with nothing; the component of a null id is null and it is kept. Rows of one id with different vectors are judged each by
    its own. Other columns are not read.
    """
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType)
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    plain = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    given = given.withColumn("usable", F.col("id").isNotNull() & F.coalesce(plain, F.lit(False)))
    out = given.filter("NOT usable").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for r in given.filter("usable").select(F.size("v").alias("size")).distinct().orderBy("size").collect():
        out = _of_width(given.filter(F.col("usable") & (F.size("v") == r["size"])), r["size"], cosine, np.dtype(np.float32 if single else np.float64)).union(out)
    return out


def _of_width(given: DataFrame, width: int, cosine: float, sent_as: np.dtype) -> DataFrame:
    """The rows of ``near_duplicates`` for usable vectors of one length; ``sent_as`` holds their components without loss."""
    spark = given.sparkSession
    keyed = given.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 is 0.0
    keyed = keyed.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.reverse("v"), F.lit(1)))
    classes = checkpoint(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"), F.first("v").alias("v")))
    placed = keyed.select("id", "k1", "k2").join(classes.select("k1", "k2", "rep", "weight"), ["k1", "k2"]).select("id", "rep", "weight")
    n = classes.count()
    k = max(1, min(MOST_CELLS, -(-n // BLOCK)))
    centres = np.zeros((1, width))
    if k > 1:
        share = min(1.0, max(FIT_ROWS, k) / n)
        drawn = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * FIT_ROWS).toArrow()
        sample = unit(_matrix(drawn["v"].combine_chunks()))
        centres = fit_cells(sample, min(k, len(sample)))
    sent = spark.sparkContext.broadcast(centres)

    def homes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and their dot products with the centres."""
        rows = unit(_matrix(column))
        return rows, rows @ sent.value.T

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, size = np.unique(homes(batch.column(0))[1].argmax(1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(size)], names=["cell", "n"])

    found = classes.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    blocks = np.ones(len(centres), np.int64)
    for r in found:
        blocks[r["cell"]] = -(-r["n"] // BLOCK)
    chord = 2 * math.sin(math.acos(cosine) / 2) + _SLACK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector to all pairs of blocks it has a part in."""
        c = sent.value
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0)) if len(c) <= 64 else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                _, dots = homes(part.column(2))
                home = dots.argmax(1)
                here = np.arange(len(home))
                between = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0))
                near = dots[here, home][:, None] - dots <= chord * between + _SLACK
                near[here, home] = True
                own = (part.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[home]
                who, cell = np.nonzero(near)
                times = blocks[cell]
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                mine, theirs = home[who] * (1 << 32) + own[who], cell * (1 << 32) + nth
                index = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(mine, theirs)), pa.array(np.maximum(mine, theirs)), pa.array(mine > theirs), part.column(0).take(index), part.column(1).take(index), pa.array([x.tobytes() for x in _matrix(part.column(2)).astype(sent_as)], pa.binary()).take(index)],
                    names=["first", "second", "later", "rep", "weight", "row"],
                )

    def link(table: pa.Table) -> pa.Table:
        later = table["later"].to_numpy()
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        order = order[np.argsort(later[order], kind="stable")]
        reps, weights = table["rep"].to_numpy()[order], table["weight"].to_numpy()[order]
        rows = unit(np.frombuffer(b"".join(table["row"].take(pa.array(order)).to_pylist()), sent_as).reshape(len(order), -1).astype(np.float64))
        cut = int((~later).sum())
        alone = table["first"][0].as_py() == table["second"][0].as_py()
        if alone:
            counts, root = block_links(rows, None, weights, weights, cosine)
        else:
            counts, root = block_links(rows[:cut], rows[cut:], weights[:cut], weights[cut:], cosine)
        some = np.flatnonzero(counts)
        return pa.table({"rep": reps[some], "links": counts[some], "root": reps[root[some]]})

    linked = classes.select("rep", "weight", "v").mapInArrow(deal, "first long, second long, later boolean, rep long, weight long, row binary").groupBy("first", "second").applyInArrow(link, "rep long, links long, root long")
    linked = checkpoint(linked)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = checkpoint(labels.withColumnRenamed("node", "rep").join(counts, "rep"))
    return placed.join(known, "rep", "left").select(
        F.col("id").alias("vec_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
        (F.col("id") == F.coalesce("component", "rep")).alias("kept"),
    )
