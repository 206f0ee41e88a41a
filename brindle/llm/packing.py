"""Bounded-space online packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.llm.memory import release

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows kept open in a partition.
OPEN = 64
#: Partitions whose leftovers are merged together.
MERGE = 16


class Packer:
    """Keeps at most ``slots`` windows open and emits rows (doc, start, length, crc, doc tokens, sequence, offset).

    A document's full windows are emitted at once. The rest goes to the window that it fills best. If it fits
    into none and no slot is free, the fullest window is topped up with the head of the rest and emitted.
    """

    def __init__(self, size: int, slots: int, first_id: int):
        self.size, self.slots, self.next_id = size, slots, first_id
        self.windows: list[list] = []  # [free, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        best = min((w for w in self.windows if w[0] >= len(ids)), key=lambda w: w[0], default=None)
        if best is None and len(self.windows) >= self.slots:
            fullest = min(self.windows, key=lambda w: w[0])
            free = fullest[0]
            self._emit([*fullest[1], (doc, start, ids[:free], total)])
            start, ids = start + free, ids[free:]
            self.windows.remove(fullest)
        if best is None:
            self.windows.append(best := [self.size, []])
        best[0] -= len(ids)
        best[1].append((doc, start, ids, total))
        if not best[0]:
            self._emit(best[1])
            self.windows.remove(best)

    def merge(self) -> list[tuple]:
        """Merges the open windows, fullest first, emits what is full and returns the pieces of the last, partial one."""
        held, room = [], self.size
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            for doc, start, ids, total in pieces:
                while len(ids):
                    cut = min(room, len(ids))
                    held.append((doc, start, ids[:cut], total))
                    start, ids, room = start + cut, ids[cut:], room - cut
                    if not room:
                        self._emit(held)
                        held, room = [], self.size
        self.windows = []
        return held

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_TYPES = [pa.int64()] * 7


def _batch(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
    """``extra``: (group, ids) of each row."""
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    columns += [pa.array([x for x, _ in extra], pa.int64()), pa.array([x for _, x in extra], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "grp", "ids"])


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, slots: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document, encoded and ended by ``end_id``, into sequences of ``size`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset. Each partition packs online in bounded space; what its open windows hold at the end is merged, and
    the one partial window left (under ``size`` ids) meets those of ``MERGE - 1`` other partitions in a second,
    small merge. So per ``MERGE`` partitions one sequence is short; all others are full. Sequence ids are unique,
    not consecutive. The texts are never shuffled, pieces are, once.

    Null and empty texts consist of ``end_id`` alone; repeated rows are packed as often as they occur; null ids
    stay null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(size, slots, part << 32)
        tail = np.array([end_id], np.int32)
        count = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, ends in bpe.encoder(vocabulary).encode(batch.column(1)):
                for i in range(len(ends) - 1):
                    own = np.concatenate([ids[ends[i] : ends[i + 1]], tail])
                    packer.add(doc_ids[first + i], 0, own, len(own))
                if rows := packer.take():
                    count += len(rows)
                    yield _batch(rows, [(~(count + k), None) for k in range(len(rows))])
            release()
        rest = packer.merge()
        if rows := packer.take():
            yield _batch(rows, [(~(count + k), None) for k in range(len(rows))])
        if rest:
            rows = [(doc, start, len(ids), None, total, None, None) for doc, start, ids, total in rest]
            yield _batch(rows, [(part // MERGE, ids.astype("<i4").tobytes()) for _, _, ids, _ in rest])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple]] = {}
        for batch in batches:
            done = pa.compute.is_null(batch.column(8))
            if (own := batch.filter(done)).num_rows:
                yield own.select(range(7))
            for row in batch.filter(pa.compute.invert(done)).to_pylist():
                groups.setdefault(row["grp"], []).append((row["doc_id"], row["start"], np.frombuffer(row["ids"], "<i4"), row["doc_tokens"]))
        for group, pieces in sorted(groups.items()):
            packer = Packer(size, slots, (1 << 62) + (group << 24))
            for piece in sorted(pieces, key=lambda p: (p[0] is None, p[0] or 0, p[1], len(p[2]))):  # whatever order they came in
                packer.add(*piece)
            if rest := packer.merge():
                packer._emit(rest)
            yield _batch(rows := packer.take(), [(0, None)] * len(rows)).select(range(7))

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = source.mapInArrow(run, SCHEMA + ", grp long, ids binary")
    return pieces.repartition(F.col("grp")).mapInArrow(finish, SCHEMA)
