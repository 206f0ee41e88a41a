"""Byte-level BPE over Arrow batches.

The pre-tokenizer of the byte-level vocabularies is a fixed regular expression. It is evaluated here for
many texts at once on arrays of code points, so that each *distinct* pre-token meets the tokenizer only
once per worker; texts are assembled from the cached ids. A pre-token is identified by its length and a 64-bit hash
with a seed that every worker draws anew.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import secrets
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Fixed values of the byte-level pre-tokenizer: its white space, its contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

#: Characters per vectorised step, so that its arrays stay in cache; one longer text is a step of its own.
STEP = 500_000
#: Distinct pre-tokens that a worker keeps; beyond it starts anew.
CACHE = 1_500_000
_SPECIAL = 0x110000
_OTHER, _LETTER, _NUMBER, _SPACE, _MARK, _UNASSIGNED = range(6)
#: Words of a span from which it is hashed alone.
LONG_SPAN = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.full(1 << 21, _MARK, np.uint8)
    kinds[:_SPECIAL] = _OTHER
    for i in range(_SPECIAL):
        category = unicodedata.category(chr(i))
        if category[0] == "L":
            kinds[i] = _LETTER
        elif category[0] == "N":
            kinds[i] = _NUMBER
        elif category == "Cn":
            kinds[i] = _UNASSIGNED
    kinds[WHITE_SPACE] = _SPACE
    return kinds


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` (bytes or code points) for every span, independent of where the span lies.

    Words of 8 bytes or 3 code points are mixed in one after the other, which no arithmetic of the spans undoes; spans of
    over ``LONG_SPAN`` words are hashed one by one.
    """
    width, bits = (8, 8) if values.dtype == np.uint8 else (3, 21)
    words = values.astype(np.uint64)
    step = 1
    while step < width:
        words[:-step] |= words[step:] << np.uint64(bits * step) if width == 8 else values[step:].astype(np.uint64) << np.uint64(bits * step)
        step += step if width == 8 else 1
    size = ends - starts
    h = (size.astype(np.uint64) ^ np.uint64(seed)) * _A
    at, left = starts, size
    going = None  # at first all
    if len(size) and (int(size.min()) == 0 or int(size.max()) > LONG_SPAN * width):
        for i in np.flatnonzero(size > LONG_SPAN * width).tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(values[starts[i] : ends[i]].tobytes(), seed=seed))
        going = np.flatnonzero((size > 0) & (size <= LONG_SPAN * width))
        at, left = starts[going], size[going]
    while len(at):
        word = words[at]
        spare = np.maximum(width - left, 0).astype(np.uint64) * np.uint64(bits) + np.uint64(64 - width * bits)
        word <<= spare
        word >>= spare
        word ^= h if going is None else h[going]
        word ^= word >> np.uint64(32)
        word *= _B
        word ^= word >> np.uint64(29)
        if going is None:
            h = word
        else:
            h[going] = word
        on = np.flatnonzero(left > width)
        going, at, left = on if going is None else going[on], at[on] + width, left[on] - width
    return h


def code_points(texts: pa.Array, specials: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` (no nulls) in one array, and where each text begins, plus the end.

    Every one of ``specials`` inside a text, the leftmost and then the longest first, becomes one value outside Unicode.
    """
    if any(pc.any(pc.match_substring(texts, s)).as_py() for s in specials):
        parts, lengths = [], []
        split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split
        for text in texts.to_pylist():
            own = [np.array([_SPECIAL + specials.index(x)], np.uint32) if i % 2 else np.frombuffer(x.encode("utf-32-le"), np.uint32) for i, x in enumerate(split(text))]
            parts += own
            lengths.append(sum(map(len, own)))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=offsets[1:])
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), offsets


def _resolve(kinds: np.ndarray, points: np.ndarray, tokenizer) -> None:
    """Asks the library, whose Unicode tables may be newer, for the class of code points unassigned in ours."""
    for c in np.unique(points).tolist():
        alone = [len(tokenizer.pre_tokenizer.pre_tokenize_str(x + chr(c))) == 1 for x in ("a", "1", "!")]
        kinds[c] = (_LETTER, _NUMBER, _OTHER, _SPACE)[[*alone, True].index(True)]


def pretokens(points: np.ndarray, offsets: np.ndarray, tokenizer) -> np.ndarray:
    """First positions of the pre-tokens of all texts, ascending."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    if (odd := kind == _UNASSIGNED).any():
        _resolve(_classes(), points[odd], tokenizer)
        kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    marks = np.flatnonzero(kind == _MARK)
    first[marks] = True
    first[marks + 1] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
    last = np.flatnonzero(last)  # the last white space before something else is a pre-token or begins one
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(start[:n] & (points == 0x27))
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        ends = np.concatenate([first, np.ones(3, bool)])
        for text in CONTRACTIONS:
            own = quote
            for k, c in enumerate(text[1:], 1):
                own = own[(padded[own + k] == ord(c)) & ~ends[own + k]]
            start[own + 1] = False
            start[own + len(text)] = True
    return np.flatnonzero(start[:n])


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``STEP`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    begin = 0
    while begin < len(size):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + STEP, "right")))
        yield begin, end
        begin = end


def filled(texts: pa.Array) -> pa.Array:
    """``texts`` as plain strings, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    return pc.fill_null(texts, "")


@functools.cache
def library(path: str):
    """The tokenizers object of a file, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials_of(path: str) -> tuple[str, ...]:
    """The added strings of a vocabulary file, which are tokens wherever they stand."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(x.get(flag) for x in added for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    return tuple(x["content"] for x in added)


class Known:
    """A map from hashes to small numbers: open addressing in arrays, many keys at a time, at most half full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self._room(16)

    def __len__(self) -> int:
        return self.size

    def _room(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at, out = self._first(hashes), np.full(len(hashes), -1, np.int32)
        going = np.arange(len(hashes))
        while len(going):
            value = self.values[at]
            same = self.keys[at] == hashes[going]
            out[going] = np.where(same, value, np.int32(-1))
            on = np.flatnonzero((value >= 0) & ~same)
            going, at = going[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds hashes, all different, that are not there."""
        self.size += len(hashes)
        if 2 * self.size > 1 << self.bits:
            held = self.values >= 0
            hashes, values = np.concatenate([self.keys[held], hashes]), np.concatenate([self.values[held], values])
            self._room(int(4 * self.size - 1).bit_length())
        at, values = self._first(hashes), values.astype(np.int32)
        while len(at):
            free = np.flatnonzero(self.values[at] < 0)
            self.values[at[free]], self.keys[at[free]] = values[free], hashes[free]  # of several at one place the last stays
            on = np.flatnonzero(self.keys[at] != hashes)
            at, hashes, values = (at[on] + 1) & ((1 << self.bits) - 1), hashes[on], values[on]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each of them stands, and which of them each value is."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(hashes), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    heads = np.flatnonzero(new)
    return ranked[heads], order[heads], back


class Encoder:
    """Ids of whole texts by the tokenizers library, one call for each distinct pre-token."""

    def __init__(self, path: str):
        self.path, self.specials, self.tokenizer, self.seed = path, specials_of(path), library(path), secrets.randbits(64)
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        n, ends = len(self.known), self.used + np.cumsum(size)
        self.flat = _roomy(self.flat, int(ends[-1]))
        self.first, self.size = _roomy(self.first, n + len(found)), _roomy(self.size, n + len(found))
        self.flat[self.used : ends[-1]] = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(ends[-1]) - self.used)
        self.first[n : n + len(found)], self.size[n : n + len(found)] = ends - size, size
        self.known.add(hashes, np.arange(n, n + len(found)))
        self.used = int(ends[-1])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows that follow, where each row's ids begin and the end), step by step."""
        texts = filled(texts)
        for begin, end in steps(texts):
            points, offsets = code_points(texts.slice(begin, end - begin), self.specials)
            start = pretokens(points, offsets, self.tokenizer)
            stop = np.append(start[1:], len(points))
            unique, where, back = distinct(span_hashes(points, start, stop, self.seed))
            if len(self.known) > CACHE:
                self.clear()
            slot = self.known.find(unique)
            new = np.flatnonzero(slot < 0)
            if len(new):
                slot[new] = len(self.known) + np.arange(len(new))
                at = where[new]
                self.learn(unique[new], [self._text(points[a:b]) for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            slot = slot[back]
            size = self.size[slot]
            ends = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=ends[1:])
            place = np.repeat(self.first[slot] - ends[:-1], size)
            place += np.arange(len(place), dtype=np.int32)
            yield begin, self.flat[place], ends[np.searchsorted(start, offsets)]

    def _text(self, points: np.ndarray) -> str:
        return self.specials[points[0] - _SPECIAL] if points[0] >= _SPECIAL else points.tobytes().decode("utf-32-le", "surrogatepass")


def _roomy(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, at least doubled if it is shorter than ``size``."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


class MergeCounter:
    """Token counts by heap-and-linked-list merging: initial symbols less merges, without emitting ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.specials, self.tokenizer, self.seed = specials_of(path), library(path), secrets.randbits(64)
        model = self.spec["model"]
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.symbol = [vocab[c] for c in byte_symbols()]
        self.known = Known()

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token. Each merge unlinks one node; stale heap entries are skipped."""
        ids = [self.symbol[b] for b in word]
        n = len(ids)
        if n < 2:
            return n
        rank = self.rank
        heap = []
        for i in range(n - 1):
            found = rank.get((ids[i], ids[i + 1]))
            if found is not None:
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get((made, ids[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1], made, ids[k]))
            h = before[i]
            if h >= 0:
                found = rank.get((ids[h], made))
                if found is not None:
                    heapq.heappush(heap, (found[0], h, found[1], ids[h], made))
        return n - merges

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        texts = filled(texts)
        out = np.zeros(len(texts), np.int64)
        for begin, end in steps(texts):
            points, offsets = code_points(texts.slice(begin, end - begin), self.specials)
            start = pretokens(points, offsets, self.tokenizer)
            stop = np.append(start[1:], len(points))
            unique, where, back = distinct(span_hashes(points, start, stop, self.seed))
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known.find(unique)
            new = np.flatnonzero(found < 0)
            for i, a, b in zip(new.tolist(), start[where[new]].tolist(), stop[where[new]].tolist(), strict=True):
                own = points[a:b]
                found[i] = 1 if own[0] >= _SPECIAL else self.count(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
            self.known.add(unique[new], found[new])
            sums = np.concatenate([[0], np.cumsum(found[back], dtype=np.int64)])
            out[begin:end] = np.diff(sums[np.searchsorted(start, offsets)])
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@functools.cache
def merge_counter(path: str) -> MergeCounter:
    """The worker's counter for a vocabulary file."""
    return MergeCounter(path)
