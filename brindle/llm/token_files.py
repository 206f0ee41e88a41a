"""Token-id files in Simple-8b: word-aligned integer coding with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector (top bits) and 60 bits of payload. Selectors 2 to 15 pack 60 ids of 1
bit down to one id of 60 bits; selector 1 stands for 120 zeros; selector 0 is the escape: the word after it is
one raw 64-bit id. Each block of ids begins at a word of its own, and the block table (words before, ids in
it) lets a decoder treat all words at once. A payload is self-describing:

``S8B1`` | n_docs, n_blocks, n_words (int64) | doc ids | ids per doc | ids per block | words per block | words
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.llm.memory import release
from brindle.plans.recovery import checkpoint, delete, shared_path

MAGIC = b"S8B1"
# Fixed values of the format: ids and bits per id of the packing selectors 2..15.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ZEROS = 120
#: Ids per block at most, and ids gathered for one payload at least (the last of a partition may have fewer).
BLOCK = 512
PAYLOAD = 600_000


#: Width by bit length.
_WIDTH_OF = np.array([0, *(next((w for w in WIDTHS if n <= w), 64) for n in range(1, 65))], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """The narrowest width that holds each id: 0 for zero, 64 for ids beyond 60 bits."""
    if len(ids) and ids.max() < 1 << 52:
        return _WIDTH_OF[np.frexp(ids.astype(np.float64))[1]]
    bits = np.full(len(ids), 64, np.uint8)
    for width in WIDTHS[::-1]:
        bits[ids < (np.uint64(1) << np.uint64(width))] = width
    bits[ids == 0] = 0
    return bits


def _longest(fits: np.ndarray) -> int:
    """Length of the longest run of true values."""
    at = np.flatnonzero(fits)
    breaks = np.flatnonzero(np.diff(at) != 1)
    return int(np.diff(np.concatenate([[-1], breaks, [len(at) - 1]])).max()) if len(at) else 0


def _plan(bits: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the selector of a word that begins there and the ids it takes; ``ends``: its block's end.

    Widths go from wide to narrow, and a narrower one replaces a wider one where it takes more ids. One whose
    runs are all too short for a whole word is skipped: what is left of a block fits in one wider word as well.
    """
    n = len(bits)
    here = np.arange(n, dtype=np.int32)
    selector, take = np.zeros(n, np.uint8), np.ones(n, np.int32)
    left = ends - here
    top = int(bits.max(initial=0))
    for code, count, width in [*zip(range(15, 1, -1), COUNTS[::-1], WIDTHS[::-1], strict=True), (1, ZEROS, 0)]:
        takes = np.minimum(np.int32(count), left)
        if width >= top:
            selector[:], take = code, takes
            continue
        fits = bits <= width
        if width < 60 and _longest(fits) < count:
            continue
        wrong = np.where(fits, np.int32(n), here)
        run = np.minimum(np.minimum.accumulate(wrong[::-1])[::-1] - here, left)
        good = run >= takes
        np.putmask(selector, good, np.uint8(code))
        np.putmask(take, good, takes)
    return selector, take


def encode(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` cut into blocks of ``sizes``, and the words of each block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    stops = np.cumsum(sizes)
    selector, take = _plan(_bits(ids), np.repeat(stops, sizes).astype(np.int32))
    visited = np.zeros(n, bool)
    at, stop = (stops - sizes)[sizes > 0], stops[sizes > 0]
    while len(at):  # all blocks advance by a word at a time
        visited[at] = True
        at = at + take[at]
        going = at < stop
        at, stop = at[going], stop[going]
    at = np.flatnonzero(visited)
    kind, own = selector[at], take[at]
    place = np.cumsum(1 + (kind == 0)) - 1  # an escape takes two words
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    padded = np.concatenate([ids, np.zeros(ZEROS, np.uint64)])
    for code, count, width in zip(range(2, 16), COUNTS, WIDTHS, strict=True):
        mine = np.flatnonzero(kind == code)
        if not len(mine):
            continue
        value = np.full(len(mine), np.uint64(code) << np.uint64(60))
        start, taken = at[mine], own[mine]
        for k in range(min(count, int(taken.max()))):
            value |= np.where(k < taken, padded[start + k], np.uint64(0)) << np.uint64(width * k)
        words[place[mine]] = value
    words[place[kind == 1]] = np.uint64(1) << np.uint64(60)
    words[place[kind == 0]] = padded[at[kind == 0]]
    words[place[kind == 0] - 1] = 0
    block = np.searchsorted(stops, at, "right")
    return words, np.bincount(block, weights=1 + (kind == 0), minlength=len(sizes)).astype(np.int64)


def decode(words: np.ndarray, sizes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Ids from words, by the block table."""
    code = (words >> np.uint64(60)).astype(np.int64)
    if (code == 0).any():  # raw words follow escapes; which words are escapes is settled in order
        raw = np.zeros(len(words), bool)
        at = -1
        for i in np.flatnonzero(code == 0).tolist():
            if i > at:
                at = i + 1
                raw[at] = True
        for i in np.flatnonzero(raw).tolist():  # what a raw word seems to select means nothing
            code[i] = 16
        code[np.flatnonzero(raw) - 1] = 17
    holds = np.array([0, ZEROS, *COUNTS, 1, 0])[code]
    before = np.cumsum(holds) - holds
    block = np.repeat(np.arange(len(sizes)), n_words)
    head = np.cumsum(n_words) - n_words
    within = before - before[np.minimum(head, max(len(words) - 1, 0))][block] if len(words) else before
    start = (np.cumsum(sizes) - sizes)[block] + within
    taken = np.minimum(holds, np.asarray(sizes)[block] - within)
    out = np.zeros(int(np.sum(sizes)), np.uint64)
    for c, count, width in zip(range(2, 16), COUNTS, WIDTHS, strict=True):
        mine = np.flatnonzero(code == c)
        mask = np.uint64((1 << width) - 1)
        for k in range(min(count, int(taken[mine].max(initial=0)))):
            sel = mine[taken[mine] > k]
            out[start[sel] + k] = (words[sel] >> np.uint64(width * k)) & mask
    sel = np.flatnonzero(code == 16)
    out[start[sel]] = words[sel]
    return out


def dump(doc_ids: np.ndarray, doc_sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A payload of whole documents."""
    n_blocks = -(-doc_sizes // BLOCK)
    of = np.repeat(np.arange(len(doc_sizes)), n_blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    sizes = np.minimum(BLOCK, doc_sizes[of] - nth * BLOCK)
    words, n_words = encode(ids, sizes)
    head = np.array([len(doc_ids), len(sizes), len(words)], np.int64)
    return b"".join([MAGIC, *(x.astype("<i8").tobytes() for x in (head, doc_ids, doc_sizes)), *(x.astype("<i4").tobytes() for x in (sizes, n_words)), words.astype("<u8").tobytes()])


def load(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per doc, ids) of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token-id payload")
    n_docs, n_blocks, n_words = np.frombuffer(payload, "<i8", 3, 4).tolist()
    at = 28
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    doc_sizes = np.frombuffer(payload, "<i8", n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(payload, "<i4", n_blocks, at := at + 8 * n_docs)
    per_block = np.frombuffer(payload, "<i4", n_blocks, at := at + 4 * n_blocks)
    words = np.frombuffer(payload, "<u8", n_words, at + 4 * n_blocks)
    return doc_ids, doc_sizes, decode(words, sizes.astype(np.int64), per_block.astype(np.int64))


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), appends ``end_id`` and writes payloads below ``path``.

    Rows go by range of id, so files and the documents in them ascend; equal ids stay neighbours, null ids
    come first (stored as the least long). The container is Parquet through Spark's committer, one payload a
    row (``shard``, ``part``, ``n_docs``, ``n_ids``, ``payload``), so any file system that Spark writes will do and a
    lost executor's task is simply run again. The only shuffle is that of the texts.
    """
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, held = TaskContext.get().partitionId(), 0, []
        tail = np.array([end_id], np.int32)

        def out() -> pa.RecordBatch:
            nonlocal part, held
            sizes = np.array([len(x) for _, x in held], np.int64)
            payload = dump(np.array([x for x, _ in held], np.int64), sizes, np.concatenate([x for _, x in held]))
            row = [[shard], [part], [len(held)], [int(sizes.sum())], [payload]]
            part, held = part + 1, []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["shard", "part", "n_docs", "n_ids", "payload"])

        size = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, ends in bpe.encoder(vocabulary).encode(batch.column(1)):
                for i in range(len(ends) - 1):
                    held.append((least if doc_ids[first + i] is None else doc_ids[first + i], np.concatenate([ids[ends[i] : ends[i + 1]], tail])))
                    size += len(held[-1][1])
                    if size >= PAYLOAD:
                        yield out()
                        size = 0
            release()
        if held:
            yield out()

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    files = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, part long, n_docs long, n_ids long, payload binary")
    files.write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32 (of ids as unsigned 32-bit)."""
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, sizes, ids = load(payload)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), shard)), pa.array(np.full(len(sizes), part)), pa.array(doc_ids, mask=doc_ids == least), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["shard", "part", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # one row a shard: the only rows that one task orders
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    inner = files.select("shard", "part", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")).alias("ahead"))
    starts = inner.join(base, "shard").select("shard", "part", (F.col("base") + F.col("ahead")).alias("ahead"))
    rows = files.select("shard", "part", "payload").mapInArrow(run, "shard long, part long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "part"]).select("doc_id", (F.col("ahead") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the token-id files of ``docs`` into the shared folder, and returns what was read back from them; the files are deleted."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, vocabulary, path, end_id)
    found = checkpoint(read(docs.sparkSession, path))
    delete(docs.sparkSession, path)
    return found
