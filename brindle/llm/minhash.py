"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.llm.components import SLOTS, components, roots, without
from brindle.llm.memory import tidy
from brindle.llm.bpe import mixed
from brindle.llm.shingles import shingle_sets
from brindle.plans.recovery import checkpoint, drop

#: Permutations; each gives two signature values, its least and its greatest hash.
PERMUTATIONS = 64
#: Signature values of a band. With 32 bands of 4, a pair at similarity 0.8 shares no band with probability 5e-8.
ROWS = 4
#: Documents of a block: two blocks are compared in one task.
BLOCK = 1024


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_011)
    return draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def signatures(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each nonempty set: least and greatest hash under every permutation, side by side."""
    starts = ends[:-1]
    out = np.zeros((len(starts), 2 * PERMUTATIONS), np.uint32)
    for j, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        hashed = ((keys * a + b) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * j] = np.minimum.reduceat(hashed, starts)
        out[:, 2 * j + 1] = np.maximum.reduceat(hashed, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row; the band's number is part of its key."""
    out = np.zeros((len(signature), signature.shape[1] // ROWS), np.uint64)
    for b in range(out.shape[1]):
        key = np.full(len(signature), np.uint64(b + 1))
        for k in range(ROWS):
            key = mixed((key ^ signature[:, ROWS * b + k]) * np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = key
    return out


def _digests(shingle: int):
    """Per document: the set's size and 128-bit digest (of documents without words: their id), and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = bpe.filled(batch.column(1)), batch.column(0)
            for begin, end in bpe.steps(texts):
                keys, ends = shingle_sets(texts.slice(begin, end - begin), shingle)
                n = np.diff(ends)
                some = np.flatnonzero(n)
                own = ids.slice(begin, end - begin)
                digest = np.zeros((2, len(n)), np.uint64)
                digest[0] = pa.compute.fill_null(own, 0).to_numpy().view(np.uint64)
                cuts = np.append(ends[some], ends[-1])
                keyed = np.zeros((len(n), 2 * PERMUTATIONS // ROWS), np.uint64)
                if len(some):
                    digest[0, some] = np.add.reduceat(mixed(keys), cuts[:-1])
                    digest[1, some] = np.bitwise_xor.reduceat(mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F)), cuts[:-1])
                    keyed[some] = bands(signatures(keys, cuts))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, keyed.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keyed[some].ravel().view(np.int64)))],
                    names=["doc", "n", "k1", "k2", "bands"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bpe.filled(batch.column(1))
            for begin, end in bpe.steps(texts):
                keys, ends = shingle_sets(texts.slice(begin, end - begin), shingle)
                data = keys.astype("<u8").tobytes()
                at = ends.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([data[8 * a : 8 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["doc", "items"])

    return run


def _linked(percent: int):
    """Keeps the pairs whose full sets have 100 * intersection >= ``percent`` * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                joint = np.concatenate([x, y])
                joint.sort()
                both = int(np.count_nonzero(joint[1:] == joint[:-1]))
                good.append(100 * both >= percent * (len(joint) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _between(percent: int):
    """Components that two blocks link, each with the least one it is joined to: by pairs that share a band and whose full sets are alike
    enough. Pairs that earlier ones have joined already are not compared, and of a group's links a spanning forest is returned."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        names, label = np.unique(table["component"].to_numpy(), return_inverse=True)
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        items = [np.frombuffer(x.as_buffer(), "<u8") for x in table["items"]]
        alone = table["first"][0].as_py() == table["second"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        root = np.arange(len(names))
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            shared = np.zeros((len(rows), len(right)), bool)
            for k in range(keys.shape[1]):
                shared |= keys[rows, k][:, None] == keys[right, k]
            low, high = np.minimum(n[rows][:, None], n[right]), np.maximum(n[rows][:, None], n[right])
            shared &= 100 * low >= percent * high
            if alone:
                shared &= rows[:, None] < right
            for i in np.flatnonzero(shared.any(1)).tolist():
                own = label[rows[i]]
                those = right[shared[i]]
                those = those[root[label[those]] != root[own]]
                if not len(those):
                    continue
                x, sizes = items[rows[i]], n[those]
                joint = np.concatenate([items[j] for j in those])
                place = np.minimum(np.searchsorted(x, joint), len(x) - 1)
                both = np.add.reduceat((x[place] == joint).astype(np.int64), np.cumsum(sizes) - sizes)
                good = those[100 * both >= percent * (len(x) + sizes - both)]
                if len(good):
                    root = roots(len(names), np.full(len(good), own), label[good], root)
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[joined], "b": names[root[joined]]})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked where their full sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100. Documents of equal sets form a class, and its smallest id takes part.
    Classes meet in the buckets of their bands. At first every member of a bucket is compared with the least one, which is
    at most one pair for each member. Buckets that then hold several components are joined to cells; members of a cell that share a
    band and are of different components are compared inside tasks, large cells in pairs of blocks. No pair of one component
    is compared again, and candidates have no cap. Every link is confirmed on the full sets.

    Texts without words (and null) are linked with nothing. Rows of one id are one document; null ids are linked with nothing
    and kept, with a null component. Other columns are not read.
    """
    given = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    digests = checkpoint(given.mapInArrow(tidy(_digests(shingle)), "doc long, n long, k1 long, k2 long, bands array<long>"))
    # written first, so that the join deals both sides anew and a class of very many documents is split between tasks
    classes = checkpoint(digests.filter("doc IS NOT NULL AND n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    rep = F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc"))
    taking_part = (F.col("n") > 0) & (F.col("doc") == rep)
    rows = checkpoint(digests.join(classes, ["n", "k1", "k2"], "left").select("doc", "n", rep.alias("rep"), F.when(taking_part, F.col("bands")).alias("bands")))
    drop(digests, classes)
    placed = rows.filter(F.col("bands").isNotNull()).select("doc", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).filter("leader < last").select("bucket", "leader")
    members = checkpoint(placed.join(buckets, "bucket"))
    wanted = members.select("doc").distinct()
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    likely = given.join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")
    sets = checkpoint(likely.mapInArrow(tidy(_sets(shingle)), "doc long, items binary").join(wanted, "doc", "left_semi").dropDuplicates(["doc"]))

    pairs = members.filter("doc <> leader").select("doc", "leader").distinct()
    pairs = pairs.join(sets.select("doc", F.col("items").alias("x")), "doc").join(sets.select(F.col("doc").alias("leader"), F.col("items").alias("y")), "leader")
    links = checkpoint(pairs.select("doc", "leader", "x", "y").mapInArrow(tidy(_linked(percent)), "a long, b long"))
    labels = components(links)

    known = checkpoint(members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "leader", F.coalesce("component", "doc").alias("component")))
    drop(members)
    open_ones = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    left = checkpoint(known.join(open_ones, "bucket").select("doc", "component", "leader").distinct())
    drop(known)
    led = left.groupBy("doc").agg(F.array_sort(F.collect_set("leader")).alias("leaders")).withColumn("first", F.col("leaders")[0])  # one a band at most
    others = led.select(F.explode(F.slice("leaders", 2, 2 * PERMUTATIONS)).alias("a"), F.col("first").alias("b")).distinct()
    cells = components(led.select(F.col("doc").alias("a"), F.col("first").alias("b")).union(others))
    sized = checkpoint(cells.withColumnRenamed("component", "cell").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")))
    # cells of one block share a task with others: no band is shared between them
    small = sized.filter("blocks = 1").agg(F.sum("size")).first()[0] or 0
    facts = left.select("doc", "component").distinct().join(cells.withColumnRenamed("node", "doc").withColumnRenamed("component", "cell"), "doc").join(sized, "cell")
    facts = facts.withColumn("parcel", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cell"), F.lit(1 + 2 * small // BLOCK))).otherwise(F.xxhash64("cell")))
    dealt = facts.join(rows.filter(F.col("bands").isNotNull()).select("doc", "n", "bands").dropDuplicates(["doc"]), "doc").join(sets, "doc")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("parcel", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), (F.col("block") > F.col("other")).cast("int").alias("side"), "doc", "n", "component", "bands", "items")
    found = checkpoint(dealt.groupBy("parcel", "first", "second").applyInArrow(_between(percent), "a long, b long"))
    drop(sized, left, sets)
    if not found.isEmpty():
        labels = components(links.union(found))
    drop(links, found)
    out = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near-duplicates."""
    return without(docs, id_col, checkpoint(near_duplicates(docs, shingle, percent, id_col, text_col).filter("NOT kept").select("doc_id")))
