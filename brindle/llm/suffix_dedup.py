"""Removal of long repeats with run-length indexes.

Texts travel once, in compressed blocks. Every string of ``LENGTH`` bytes has a minimizer, so equal strings meet where their
minimizers meet; strings whose minimizer several documents hold are candidates. Runs of candidates (snippets) go to the part
of their route, a minimizer of fewer bytes that equal strings share as well. A part builds, for some distinct snippets
at a time, a run-compressed Burrows-Wheeler transform with suffixes sampled at both ends of its runs, and the least
document of every interval of suffixes with ``LENGTH`` bytes in common. The snippets are then streamed against it from right to
left; where the matching statistic reaches ``LENGTH``, the interval tells whether a smaller document holds the string.

Between blocks and parts go packed messages, one for each block and part: hashes, a bit for each of them, distinct snippets with the
least document of the block, spans. Who else of a block holds a snippet stays with the block, so what a part gets of a very common
passage is one snippet a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.llm.bpe import mixed
from brindle.llm.memory import release, tidy
from brindle.plans.recovery import checkpoint, drop

LENGTH = 50
#: Bytes of a minimizer, and of a route; strings in a snippet at most.
GRAM, ROUTE, RUN = 24, 12, 60
#: Text bytes of a block, of a step, and snippet bytes of one index (more only where one text, or one route, has more).
BLOCK, STEP, INDEX = 8_000_000, 1 << 18, 500_000
_KINDS = ["uint8", "uint16", "uint32", "uint64", "int64"]


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed string; bytes of equal weight lie side by side."""
    head = np.array([(_KINDS.index(x.dtype.name), len(x)) for x in arrays], "<i8")
    body = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return bytes([len(arrays)]) + head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    head = np.frombuffer(data, "<i8", 2 * data[0], 1).reshape(-1, 2)
    sizes = [np.dtype(_KINDS[k]).itemsize * n for k, n in head.tolist()]
    body = np.frombuffer(pa.decompress(data[1 + head.nbytes :], sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for (kind, n), size in zip(head.tolist(), sizes, strict=True):
        out.append(np.ascontiguousarray(body[at : at + size].reshape(-1, n).T).view(_KINDS[kind]).ravel() if n else np.zeros(0, _KINDS[kind]))
        at += size
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Values of 0 or more in the least unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` (no nulls), and where each text begins, plus the end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def minimizers(data: np.ndarray, gram: int, length: int = LENGTH) -> np.ndarray:
    """For every string of ``length`` bytes of ``data`` the least hash of ``gram`` bytes in it."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    m = len(data) - gram + 1
    h = x[:m] * np.uint64(0x9E3779B97F4A7C15 + gram)
    for k in [*range(8, gram - 8, 8), gram - 8]:
        h += x[k : k + m] * np.uint64((0xC2B2AE3D27D4EB4F * (k + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
    h = mixed(h)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:n], h[rest : rest + n])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in ascending order of begin, those that overlap or touch joined."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return begin[starts], reach[np.append(starts[1:] - 1, len(begin) - 1)]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


_BLOCKS = "block long, data binary, nth binary, digests binary"


def _pack(length: int):
    """Blocks of rows (the first two columns are id and text) as compressed Arrow, with SHA-256 digests of the texts that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        held, size = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, block
            table = pa.Table.from_batches(held)
            held, size = [], 0
            ids, texts = table.column(0).combine_chunks(), bpe.filled(table.column(1))
            data, offsets = text_bytes(texts)
            nth = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) >= length))
            digests = b"".join(hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in nth.tolist())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.combine_chunks())
            block += 1
            own = pc.fill_null(ids, 0).to_numpy()[nth]
            return _rows([(block - 1, sink.getvalue().to_pybytes(), packed(nth.astype(np.uint32), own), digests)], _BLOCKS)

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = 0
            while at < batch.num_rows:
                base = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + BLOCK - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - base
                at = to
                if size >= BLOCK or at < batch.num_rows:
                    yield out()
        if held:
            yield out()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text that takes part."""
    for batch in batches:
        for block, nth, digests in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            nth, ids = unpacked(nth)
            texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(nth), [None, pa.py_buffer(digests)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([texts, pa.array(ids), pa.array(np.full(len(nth), block)), pa.array(nth.astype(np.int32))], names=["digest", "doc", "block", "nth"])


def _opened(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0]


class _Block:
    """The texts of a block that take part, end to end."""

    def __init__(self, data: bytes, twins: list[int] | None, length: int):
        batch = _opened(data)
        texts = bpe.filled(batch.column(1))
        part = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) >= length)
        part[twins or []] = False
        self.rows = np.flatnonzero(part)
        self.ids = pc.fill_null(batch.column(0), 0).to_numpy()[self.rows]
        self.data, self.offsets = text_bytes(texts.filter(pa.array(part)))
        self.length = length

    def census(self, n_parts: int) -> None:
        """Runs of strings with one minimizer, and the distinct keys (part and 32 bits of the hash) in ascending order."""
        length, data = self.length, self.data
        fits = np.ones(len(data), bool)
        fits[(self.offsets[1:, None] - np.arange(1, length)).ravel()] = False
        keys, starts, counts = [], [], []
        for a in range(0, len(data), STEP):
            at = np.flatnonzero(fits[a : a + STEP])
            h = minimizers(data[a : a + STEP + length - 1], GRAM, length)[at]
            if not len(at):
                continue
            edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1), [True]]))
            keys.append(h[edges[:-1]])
            starts.append(at[edges[:-1]] + a)
            counts.append(np.diff(edges))
        self.starts, self.counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, counts))
        key = _routed(np.concatenate([np.zeros(0, np.uint64), *keys]), n_parts)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        self.keys = key[heads]
        self.kind = np.empty(len(key), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        row = np.searchsorted(self.offsets, self.starts[order], "right")
        self.several = np.minimum.reduceat(row, heads) < np.maximum.reduceat(row, heads) if len(heads) else np.zeros(0, bool)
        self.cuts = np.searchsorted(self.keys, np.arange(n_parts + 1, dtype=np.uint64) << np.uint64(32))


def _routed(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each hash, and 32 bits of it below."""
    return ((hashes >> np.uint64(40)) % np.uint64(n_parts)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


_MESSAGES = "part int, block long, message binary"


def _send(n_parts: int, length: int):
    """The distinct minimizers of a block by part, and whether several of its documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, twins in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = _Block(data, twins, length)
                block.census(n_parts)
                low = (block.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = []
                for p in range(n_parts):
                    a, b = block.cuts[p : p + 2]
                    if a < b:
                        rows.append((p, number, packed(np.diff(low[a:b], prepend=np.uint32(0)), np.packbits(block.several[a:b]))))
                yield _rows(rows, _MESSAGES)
                release()

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """The messages of each part of a task."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for part, block, message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(part, []).append((block, message))
    for part in sorted(held):
        yield part, [(block, unpacked(message)) for block, message in sorted(held.pop(part))]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block a bit for each of its minimizers in a part: whether several documents hold it."""
    for part, messages in _by_part(batches):
        low = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for _, x in messages])
        shared = np.concatenate([np.unpackbits(x[1], count=len(x[0])) for _, x in messages]).astype(bool)
        order = np.argsort(low)
        low = low[order]
        same = low[1:] == low[:-1]
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum([len(x[0]) for _, x in messages]).tolist()
        rows = [(part, block, np.packbits(own).tobytes()) for (block, _), own in zip(messages, np.split(shared, ends[:-1]), strict=True) if own.any()]
        yield _rows(rows, _MESSAGES)


def _snip(n_parts: int, length: int):
    """Distinct snippets of candidates by part, each with the least document of the block that holds it; and for the block itself (part -1) who holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, twins, replies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block = _Block(data, twins, length)
                block.census(n_parts)
                good = np.zeros(len(block.keys), bool)
                for reply in replies:
                    a, b = block.cuts[reply["part"] : reply["part"] + 2]
                    good[a:b] = np.unpackbits(np.frombuffer(reply["message"], np.uint8), count=int(b - a))
                runs = np.flatnonzero(good[block.kind])
                yield _rows(_snippets(number, block, spread(block.starts[runs], block.counts[runs]), n_parts), _MESSAGES)
                release()

    return run


def _snippets(number: int, block: _Block, at: np.ndarray, n_parts: int) -> list[tuple]:
    """Messages with the snippets of the strings that begin ``at``."""
    if not len(at):
        return []
    data, length = block.data, block.length
    route = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + STEP, STEP))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if i < j:
            route[i:j] = minimizers(data[k * STEP : (k + 1) * STEP + length - 1], ROUTE, length)[at[i:j] - k * STEP]
    edges = np.flatnonzero(np.concatenate([[True], (route[1:] != route[:-1]) | (at[1:] != at[:-1] + 1), [True]]))
    nth = np.arange(len(at)) - np.repeat(edges[:-1], np.diff(edges))
    first = np.flatnonzero(nth % RUN == 0)
    last = np.append(first[1:], len(at)) - 1
    route, begin, end = _routed(route[first], n_parts), at[first], at[last] + length
    digest = bpe.span_hashes(data, begin, end)
    order = np.argsort((route >> np.uint64(32)) << np.uint64(40) | mixed(digest ^ route) >> np.uint64(24))
    route, begin, end, digest = route[order], begin[order], end[order], digest[order]
    row = np.searchsorted(block.offsets, begin, "right") - 1
    fresh = np.ones(len(order), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (route[1:] != route[:-1])
    one = np.flatnonzero(fresh)
    least, sizes = np.minimum.reduceat(block.ids[row], one), end[one] - begin[one]
    cuts = np.searchsorted(route[one] >> np.uint64(32), np.arange(n_parts + 1, dtype=np.uint64))
    own = packed(narrow(block.rows[row]), narrow(begin - block.offsets[row]), narrow(np.cumsum(fresh) - 1), narrow(sizes), least, narrow(cuts))
    rows = [(-1, number, own)]
    for p in range(n_parts):
        mine = slice(*cuts[p : p + 2])
        if mine.start < mine.stop:
            rows.append((p, number, packed(least[mine], narrow(sizes[mine]), (route[one[mine]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), data[spread(begin[one[mine]], sizes[mine])])))
    return rows


class RunIndex:
    """A run-length index of distinct strings, each ended by an end mark of its own.

    Kept of the Burrows-Wheeler transform: where its runs begin, their symbols (0: an end mark), their images under the LF mapping
    and the runs that these lie in, and the suffixes at both ends of each run; beside the texts, and the least ``owner`` of
    every group of suffixes that have ``length`` bytes in common. Rows 0, 1, .. are the end marks of the strings.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int):
        self.length = length
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) if len(ends) else 0
        marks = ends - 1
        text = np.zeros(n, np.int16)
        inside = np.ones(n, bool)
        inside[marks] = False
        text[inside] = data.astype(np.int16) + 1
        left = np.repeat(ends, sizes + 1) - np.arange(n) - 1
        order = _suffixes(text, left, int(sizes.max(initial=0)))
        before = np.concatenate([text[-1:], text[:-1]])[order]  # an end mark before the first of each string
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.lengths = np.diff(np.append(self.heads, n))
        self.symbols = before[self.heads]
        self.first, self.last = order[self.heads], order[self.heads + self.lengths - 1]
        self.by_symbol = np.argsort(self.symbols, kind="stable")
        sizes_by = self.lengths[self.by_symbol]
        images = np.cumsum(sizes_by) - sizes_by
        self.images, self.goals = np.empty(len(self.heads), np.int64), np.empty(len(self.heads), np.int64)
        self.images[self.by_symbol] = images
        self.goals[self.by_symbol] = np.searchsorted(self.heads, images, "right") - 1
        self.keys = self.symbols[self.by_symbol].astype(np.int64) * len(self.heads) + self.by_symbol
        self.text, self.left = np.concatenate([text, np.zeros(4, np.int16)]), left
        self.words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(self.text.view(np.uint8)[:8].view(np.uint64), (n,), (2,)))
        shared = self._shared(order)
        self.groups = np.flatnonzero(shared < length)  # a suffix shorter than that is a group, too
        self.least = np.minimum.reduceat(np.repeat(owner, sizes + 1)[order], self.groups) if n else owner[:0]

    def _shared(self, order: np.ndarray) -> np.ndarray:
        """Bytes that the suffix of each row has in common with the one before it.

        They are compared at run heads only. Inside a run the symbol before both suffixes is the same, so the pair one
        byte to the left is adjacent, too, and the number falls by one from there in text order.
        """
        n = len(order)
        common = np.zeros(n, np.int64)
        heads = self.heads[1:]
        at = np.full(n, -1, np.int64)
        if n:
            at[order[0]] = 0
        at[order[heads]] = self.extension(order[heads], order[heads - 1], np.minimum(self.left[order[heads]], self.left[order[heads - 1]]))
        here = np.arange(n)
        nearest = np.maximum.accumulate(np.where(at >= 0, here, 0))
        common = np.maximum(at[nearest] - (here - nearest), 0)
        return common[order]

    def extension(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Symbols that the texts from ``x`` and from ``y`` have in common, up to ``limit``; four are compared at a time."""
        out = limit.copy()
        going = np.flatnonzero(limit > 0)
        x, y, limit, depth = x[going], y[going], limit[going], 0
        while len(going):
            apart = self.words[x + depth] ^ self.words[y + depth]
            ended = np.flatnonzero(apart)
            lowest = apart[ended] & (~apart[ended] + np.uint64(1))
            out[going[ended]] = np.minimum(limit[ended], depth + (np.log2(lowest.astype(np.float64)) / 16).astype(np.int64))
            depth += 4
            on = np.flatnonzero((apart == 0) & (limit > depth))
            going, x, y, limit = going[on], x[on], y[on], limit[on]
        return out

    def _forward(self, run: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The runs of ``row``, which are ``run`` or runs after them."""
        going = np.flatnonzero(self.heads[run] + self.lengths[run] <= row)
        for _ in range(8):
            if not len(going):
                return run
            run[going] += 1
            going = going[self.heads[run[going]] + self.lengths[run[going]] <= row[going]]
        run[going] = np.searchsorted(self.heads, row[going], "right") - 1
        return run

    def stream(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of texts, all from right to left at once: for every byte the length of the longest match that begins there
        (``length`` at most), and a row with that match.

        A step takes the LF mapping where the run's symbol is the text's next. Else it goes on from the nearest run of that symbol above or
        below, whichever sample has the longer match in common with the suffix left behind.
        """
        n, runs = len(data), len(self.heads)
        length, row = np.zeros(n, np.int64), np.zeros(n, np.int64)
        turn = np.argsort(-sizes, kind="stable")
        ends, sizes = np.cumsum(sizes)[turn], sizes[turn]
        run, off, at_text, matched = (np.zeros(len(sizes), np.int64) for _ in range(4))
        if runs:
            at_text[:] = self.first[0]
        for k in range(int(sizes.max(initial=0)) if runs else 0):
            m = int(np.searchsorted(-sizes, -k, "left"))  # streams that are longer than k
            here = ends[:m] - 1 - k
            symbol = data[here].astype(np.int16) + np.int16(1)
            j, o, q, l = run[:m], off[:m], at_text[:m], matched[:m]
            absent = other = np.flatnonzero(self.symbols[j] != symbol)
            if len(other):
                c = symbol[other]
                place = np.searchsorted(self.keys, c.astype(np.int64) * runs + j[other])
                below, above = self.by_symbol[np.minimum(place, runs - 1)], self.by_symbol[np.maximum(place - 1, 0)]
                has_below, has_above = (place < runs) & (self.symbols[below] == c), (place > 0) & (self.symbols[above] == c)
                was, limit = q[other], l[other]
                samples = np.concatenate([self.first[below], self.last[above]])
                most = np.where(np.concatenate([has_below, has_above]), np.minimum(np.tile(limit, 2), self.left[samples]), 0)
                to_below, to_above = np.split(self.extension(np.tile(was, 2), samples, most), 2)
                take_above = has_above & (~has_below | (to_above > to_below))
                j[other] = np.where(take_above, above, below)
                o[other] = np.where(take_above, self.lengths[above] - 1, 0)
                q[other] = np.where(take_above, self.last[above], self.first[below])
                l[other] = np.where(take_above, to_above, to_below)
                absent = other[~has_above & ~has_below]
            r = self.images[j] + o
            j[:] = self._forward(self.goals[j], r)
            o[:] = r - self.heads[j]
            q -= 1
            l += 1
            np.minimum(l, self.length, out=l)
            if len(absent):
                r[absent], j[absent], o[absent], q[absent], l[absent] = 0, 0, 0, self.first[0], 0
            length[here], row[here] = l, r
        return length, row

    def least_owner(self, row: np.ndarray) -> np.ndarray:
        """The least owner of the groups of ``row``."""
        return self.least[np.searchsorted(self.groups, row, "right") - 1]


def _suffixes(text: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """All suffixes in order, by prefix doubling; end marks are below all bytes, and equal suffixes in text order."""
    n = len(text)
    used = np.zeros(257, np.int64)
    used[text] = 1
    used[0] = 0
    code = np.cumsum(used) * used  # 0 for end marks
    bits = max(1, int(code.max(initial=0)).bit_length())
    key, step = code[text], 1
    while 2 * step * bits <= 62 and step < longest:
        key[:-step] = key[:-step] << (bits * step) | np.where(left[:-step] > step, key[step:], 0)
        key[-step:] <<= bits * step
        step *= 2
    order = np.argsort(key)
    low = max(1, n.bit_length())
    while True:
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([np.zeros(1, np.int64), (ranked[1:] != ranked[:-1]).astype(np.int64)])) if n else ranked
        if step >= longest:  # equal suffixes in text order
            return np.sort(rank << low | np.arange(n)) & ((1 << low) - 1) if 2 * low < 64 else np.lexsort((np.arange(n), rank))
        key = rank << low
        key[:-step] |= np.where(left[:-step] > step, rank[step:] + 1, 0)
        step *= 2
        if 3 * low < 64:
            key = np.sort(key << low | np.arange(n))
            order = key & ((1 << low) - 1)
            key = _placed(key >> low, order)
        else:
            order = np.argsort(key)


def _placed(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(values), values.dtype)
    out[order] = values
    return out


def _match(length: int):
    """To each block: which of its snippets are repeated as a whole, for even their least document there, and marked spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, messages in _by_part(batches):
            docs, sizes, routes, data = (np.concatenate([own[i] for _, own in messages]) for i in range(4))
            sizes = sizes.astype(np.int64)
            ends = np.cumsum(sizes)
            digest = bpe.span_hashes(data, ends - sizes, ends)
            order = np.lexsort((digest, routes))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (digest[order[1:]] != digest[order[:-1]]) | (routes[order[1:]] != routes[order[:-1]])
            same = np.empty(len(order), np.int64)  # snippets of equal bytes are one
            same[order] = np.cumsum(fresh) - 1
            one = order[fresh]
            first_doc = np.minimum.reduceat(docs[order], np.flatnonzero(fresh)) if len(order) else docs
            bounds = np.flatnonzero(np.concatenate([[True], routes[one[1:]] != routes[one[:-1]], [True]]))
            total = np.concatenate([[0], np.cumsum(sizes[one])])
            found, at = [], 0
            while at < len(bounds) - 1:
                to = max(at + 1, int(np.searchsorted(total[bounds], total[bounds[at]] + INDEX, "right")) - 1)
                a, b = int(bounds[at]), int(bounds[to])
                at = to
                n = sizes[one[a:b]]
                found.append(_marked(data[spread(ends[one[a:b]] - n, n)], n, first_doc[a:b], a, length))
            snippet, low, high = (np.concatenate([x[i] for x in found]) for i in range(3))
            whole = docs > first_doc[same]
            others = np.flatnonzero(~whole)
            cuts = np.searchsorted(snippet, np.arange(len(one) + 1))
            times = np.diff(cuts)[same[others]]
            held, span = np.repeat(others, times), spread(cuts[same[others]], times)
            release()
            rows, a = [], 0
            for block, own in messages:
                b = a + len(own[1])
                i, j = np.searchsorted(held, [a, b])
                if i < j or whole[a:b].any():
                    rows.append((part, block, packed(np.packbits(whole[a:b]), narrow(held[i:j] - a), narrow(low[span[i:j]]), narrow(high[span[i:j]]))))
                a = b
            yield _rows(rows, _MESSAGES)

    return run


def _spans(ids: np.ndarray, own: bytes, replies: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the marked bytes of a block's rows, whose ``ids`` are given, from who holds its snippets and what the parts say."""
    row, begin, which, sizes, least, cuts = (x.astype(np.int64) for x in unpacked(own))
    whole, found = np.zeros(len(sizes), bool), []
    for reply in replies:
        bits, snippet, low, high = unpacked(reply["message"])
        a, b = cuts[reply["part"] : reply["part"] + 2]
        whole[a:b] = np.unpackbits(bits, count=int(b - a))
        found.append((snippet.astype(np.int64) + a, low.astype(np.int64), high.astype(np.int64)))
    snippet, low, high = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3))
    order = np.argsort(snippet, kind="stable")
    snippet, low, high = snippet[order], low[order], high[order]
    repeated = whole[which] | (ids[row] > least[which])
    some = np.flatnonzero(~repeated)
    bounds = np.searchsorted(snippet, np.arange(len(sizes) + 1))
    times = np.diff(bounds)[which[some]]
    held, span = np.repeat(some, times), spread(bounds[which[some]], times)
    return np.concatenate([row[repeated], row[held]]), np.concatenate([begin[repeated], begin[held] + low[span]]), np.concatenate([begin[repeated] + sizes[which[repeated]], begin[held] + high[span]])


def _joined(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, begin, end), those of a row merged."""
    room = int(high.max()) + 1
    order = np.argsort(row * room + low)
    a, b = merged((row * room + low)[order], (row * room + high)[order])
    row = a // room
    return row, a - row * room, b - row * room


def _marked(data: np.ndarray, sizes: np.ndarray, owner: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, begin, end) of the bytes of snippets that are covered by strings of a smaller owner; ``base`` is the first snippet's number."""
    index = RunIndex(data, sizes, owner, length)
    statistics, row = index.stream(data, sizes)
    ends = np.cumsum(sizes)
    at = np.flatnonzero(statistics >= length)
    snippet = np.searchsorted(ends, at, "right")
    good = index.least_owner(row[at]) < owner[snippet]
    at, snippet = at[good], snippet[good]
    edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (snippet[1:] != snippet[:-1]), [True]])) if len(at) else np.zeros(1, np.int64)
    first, last = edges[:-1], edges[1:] - 1
    start = (ends - sizes)[snippet[first]]
    return snippet[first] + base, at[first] - start, at[last] + length - start


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Blocks of ``docs`` (whose first columns are an id of type long and a text) with what repeats in them: (block, data, twins, held, replies).

    A byte repeats where a string of ``length`` bytes covers it that also starts in a document of smaller id. ``twins`` are rows whose
    whole text, by its SHA-256, is that of a document of smaller id; ``held`` tells who holds the block's snippets, ``replies`` what is marked of them.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    source = checkpoint(numbered.mapInArrow(tidy(_pack(length)), _BLOCKS))
    texts = source.select("block", "nth", "digests").mapInArrow(_digests, "digest binary, doc long, block long, nth int")
    # written first, so that the join deals both sides anew and a class of very many documents is split between tasks
    classes = checkpoint(texts.groupBy("digest").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").drop("high"))
    twins = texts.join(classes, "digest").filter("doc > low").groupBy("block").agg(F.collect_list("nth").alias("twins"))
    blocks = checkpoint(source.select("block", "data").repartition(n_parts, "block").join(twins.hint("merge"), "block", "left"), layout=True)
    drop(source, classes)
    met = blocks.select("block", "data", "twins").mapInArrow(tidy(_send(n_parts, length)), _MESSAGES).repartitionById(n_parts, "part").mapInArrow(tidy(_meet), _MESSAGES)
    replies = checkpoint(met.groupBy("block").agg(F.collect_list(F.struct("part", "message")).alias("replies")))
    asked = blocks.join(replies, "block").select("block", "data", "twins", "replies")
    snippets = checkpoint(asked.mapInArrow(tidy(_snip(n_parts, length)), _MESSAGES))
    found = snippets.filter("part >= 0").repartitionById(n_parts, "part").mapInArrow(tidy(_match(length)), _MESSAGES)
    marks = found.groupBy("block").agg(F.collect_list(F.struct("part", "message")).alias("marks"))
    told = checkpoint(snippets.filter("part = -1").select("block", F.col("message").alias("held")).join(marks, "block", "left"))
    drop(replies, snippets)
    return blocks.join(told, "block", "left").select("block", "data", "twins", "held", "marks")


class _Result:
    """The bytes of all texts of a block, and which of them go."""

    def __init__(self, data: bytes, twins: list[int] | None, held: bytes | None, replies: list[dict] | None):
        self.batch = _opened(data)
        self.data, self.offsets = text_bytes(bpe.filled(self.batch.column(1)))
        n = len(self.offsets) - 1
        alike = np.array(twins or [], np.int64)
        found = [(alike, np.zeros(len(alike), np.int64), np.diff(self.offsets)[alike])]
        if held:
            found.append(_spans(pc.fill_null(self.batch.column(0), 0).to_numpy(), held, replies or []))
        row, low, high = (np.concatenate([x[i] for x in found]) for i in range(3))
        self.n_spans = np.zeros(n, np.int64)
        self.gone = np.zeros(len(self.data), bool)
        if len(row):
            row, low, high = _joined(row, low, high)
            self.n_spans = np.bincount(row, minlength=n)
            self.gone[spread(self.offsets[row] + low, high - low)] = True

    def whole_characters(self) -> None:
        """A character stays if any of its bytes does."""
        if self.gone.any():
            begins = (self.data & 0xC0) != 0x80
            begins[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
            first = np.flatnonzero(begins)
            self.gone = np.repeat(np.logical_and.reduceat(self.gone, first), np.diff(np.append(first, len(self.data))))

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes left of all texts, and where each text begins in them, plus the end."""
        stays = np.concatenate([[0], np.cumsum(~self.gone)])
        return self.data[~self.gone], stays[self.offsets]


def _results(batches: Iterator[pa.RecordBatch], made: Callable[[_Result], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, twins, held, replies in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            yield made(_Result(data, twins, held, replies))
            release()


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after removal of all repeats (see ``repeats``).

    Null texts are empty; texts shorter than ``length`` and rows with null ids lose nothing; rows of one id
    are no repeats of each other; other columns are not read.
    """

    def rows(result: _Result) -> pa.RecordBatch:
        kept, ends = result.kept()
        n_bytes = np.diff(result.offsets)
        texts = memoryview(np.ascontiguousarray(kept))
        hashes = [hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [result.batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n_bytes, n_bytes - np.diff(ends), result.n_spans)), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), length)
    return found.mapInArrow(tidy(lambda batches: _results(batches, rows)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats removed from ``text_col`` (a string column); documents of which nothing is left go, unless they were empty before.

    A character stays if any of its bytes does. All other columns are kept as they are, whatever their names.
    """
    names = docs.columns
    text_at = names.index(text_col)

    def rows(result: _Result) -> pa.RecordBatch:
        result.whole_characters()
        kept, ends = result.kept()
        before = result.batch.column(1)
        large = pa.types.is_large_string(before.type)
        texts = pa.Array.from_buffers(before.type, len(before), [None, pa.py_buffer(ends.astype(np.int64 if large else np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
        texts = pc.if_else(before.is_valid(), texts, pa.scalar(None, before.type))
        columns = [texts if i == text_at else result.batch.column(2 + i - (i > text_at)) for i in range(len(names))]
        stays = (np.diff(ends) > 0) | (np.diff(result.offsets) == 0)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    others = [docs[c] for i, c in enumerate(names) if i != text_at]
    found = repeats(docs.select(docs[id_col].cast("long"), docs[text_col], *others), length)
    return found.mapInArrow(tidy(lambda batches: _results(batches, rows)), docs.schema)
