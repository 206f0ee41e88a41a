"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its
template. Windows of templates are hash-joined between benchmark and documents, and the values that the
placeholders stood for must correspond one to one. Beside the templates stand windows of tokens in lower case, which find
copies whose capitals tell names apart in another way, and items without a window of templates.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bpe
from brindle.llm.components import without
from brindle.llm.memory import tidy
from brindle.plans.recovery import checkpoint

#: Tokens of a window (of a shorter item: the whole item), and how many that are no placeholders make a template tell something.
WINDOW, LITERALS = 8, 3
#: Share of an item's windows that a document must hold.
COVERED = 0.5
#: Tokens in a row that prove a quotation, whatever its share of the item.
RUN = 13
#: Slots of the prefilter sent to all executors: 2 MB whatever the benchmark's size; the join after it decides.
SLOTS = 1 << 24
#: Bytes of the prefilter that one group of slots makes; the driver gets each of them once.
CHUNK = 1 << 12
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "mph", "usd", "eur"]
#: Scripts written without spaces: every letter is a token.
SPACELESS = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF)]
_TOKEN, _WORD, _NUMBER, _UPPER, _STOP, _ALONE = 1, 2, 4, 8, 16, 32
#: Sequences of a text: templates; templates in which every capitalised word is a name; tokens in lower case; all characters but white
#: space; templates with the signs between their tokens.
_TEMPLATE, _CAPITALS, _RAW, _GLYPHS, _SIGNS = range(5)
_NAME, _NUM, _UNIT = (np.uint64(0x1000000001 + k) for k in range(3))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Flags and lower case of every code point."""
    flags, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            flags[i] = _TOKEN | _WORD | (_UPPER if kind in ("Lu", "Lt") else 0)
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif kind[0] == "N":
            flags[i] = _TOKEN | _NUMBER
    for c in ".!?:;\"“”«»":
        flags[ord(c)] |= _STOP
    for low, high in SPACELESS:
        flags[low : high + 1] |= np.where(flags[low : high + 1] & _WORD, np.uint8(_ALONE), np.uint8(0))
    return flags, lower


def _hash(text: str) -> int:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(bpe.span_hashes(points, np.array([0]), np.array([len(points)]))[0])


@functools.cache
def _units() -> np.ndarray:
    return np.array(sorted(_hash(u) for u in UNITS), np.uint64)


class _Tokens(NamedTuple):
    points: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    own: np.ndarray  # hash in lower case
    opens: np.ndarray  # first token of each text, plus the end
    number: np.ndarray
    upper: np.ndarray
    ended: np.ndarray  # first of a sentence
    gap: np.ndarray


class _Sequence(NamedTuple):
    tokens: np.ndarray
    values: np.ndarray  # of placeholders, else 0
    words: np.ndarray
    opens: np.ndarray


def _tokens(texts: pa.Array) -> _Tokens:
    """A token is a run of letters or of digits, or one letter of a script without spaces."""
    points, offsets = bpe.code_points(texts)
    flags, lower = _tables()
    flag = flags[points]
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    kind = flag & (_WORD | _NUMBER | _ALONE)
    change = first[:-1].copy()
    if len(points):
        change[1:] |= (kind[1:] != kind[:-1]) | ((kind[1:] & _ALONE) > 0)
    start = np.flatnonzero(change & (kind > 0))
    edges = np.append(np.flatnonzero(change), len(points))
    stop = edges[np.searchsorted(edges, start, "right")]
    own = bpe.span_hashes(lower[points], start, stop)
    opens = np.searchsorted(start, offsets)
    n = len(start)
    stops = np.concatenate([[0], np.cumsum((flag & _STOP) > 0)])
    ends_line = points == ord("\n")
    ends_line |= (points == ord("\r")) & ~np.append(ends_line[1:], False)
    lines = np.concatenate([[0], np.cumsum(ends_line)])
    blanks = np.concatenate([[0], np.cumsum(np.isin(points, bpe.WHITE_SPACE))])
    gap = np.zeros(n, np.int64)
    ended = np.ones(n, bool)
    if n > 1:
        gap[1:] = start[1:] - stop[:-1]
        ended[1:] = (stops[start[1:]] > stops[stop[:-1]]) | (lines[start[1:]] > lines[stop[:-1]] + 1)  # a stop or an empty line
        gap[1:][(gap[1:] > 1) & (blanks[start[1:]] - blanks[stop[:-1]] == gap[1:])] = 1  # white space is one space
    ended |= _firsts(opens, n)
    return _Tokens(points, offsets, start, stop, own, opens, (flag[start] & _NUMBER) > 0, (flag[start] & _UPPER) > 0, ended, gap)


def _firsts(opens: np.ndarray, n: int) -> np.ndarray:
    new = np.zeros(n + 1, bool)
    new[opens] = True
    return new[:n]


def _templates(t: _Tokens, capitals: bool = False) -> _Sequence:
    return _parsed(t, capitals)[0]


def _parsed(t: _Tokens, capitals: bool = False) -> tuple[_Sequence, np.ndarray]:
    """The templates, and which tokens belong to the one before."""
    n, new = len(t.start), _firsts(t.opens, len(t.start))
    name = ~t.number & t.upper & (~t.ended | capitals)
    after_number = np.zeros(n, bool)
    after_number[1:] = t.number[:-1] & ~new[1:]
    unit = ~t.number & after_number & np.isin(t.own, _units()) & (t.gap <= 1)
    joined = np.zeros(n, bool)  # tokens that continue a number or a name
    if n > 1:
        points_before = t.points[np.maximum(t.start - 1, 0)]
        joined[1:] = (t.number[1:] & t.number[:-1] & (t.gap[1:] == 1) & np.isin(points_before[1:], [ord("."), ord(",")])) | (name[1:] & name[:-1] & (t.gap[1:] == 1) & ~t.ended[1:])
        joined &= ~new
    token = np.where(t.number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, t.own)))
    slot = t.number | name | unit
    head = np.flatnonzero(~joined)
    value = np.where(slot, t.own, np.uint64(0))
    if n:
        ranks = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        value = np.add.reduceat(value * (np.uint64(2) * ranks.astype(np.uint64) + np.uint64(1)), head)
    return _Sequence(token[head], value, value == 0, np.searchsorted(head, t.opens)), joined


def _signs(t: _Tokens) -> _Sequence:
    of, joined = _parsed(t)
    sign = ((_tables()[0][t.points] & _TOKEN) == 0) & ~np.isin(t.points, bpe.WHITE_SPACE)
    inner = np.flatnonzero(joined)  # the point or comma of a number is no sign
    sign[t.start[inner] - 1] = False
    at = np.flatnonzero(sign)
    place = np.concatenate([t.start[~joined], at])
    order = np.argsort(place, kind="stable")
    tokens = np.concatenate([of.tokens, bpe.mixed((t.points[at] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))])[order]
    values = np.concatenate([of.values, np.zeros(len(at), np.uint64)])[order]
    return _Sequence(tokens, values, np.concatenate([of.words, np.zeros(len(at), bool)])[order], np.searchsorted(place[order], t.offsets))


def _raw(t: _Tokens) -> _Sequence:
    return _Sequence(t.own, np.zeros(len(t.own), np.uint64), ~t.number, t.opens)


def _glyphs(t: _Tokens) -> _Sequence:
    at = np.flatnonzero(~np.isin(t.points, bpe.WHITE_SPACE))
    return _Sequence(t.points[at].astype(np.uint64), np.zeros(len(at), np.uint64), np.zeros(len(at), bool), np.searchsorted(at, t.offsets))


_SEQUENCES = {_TEMPLATE: _templates, _CAPITALS: lambda t: _templates(t, True), _RAW: _raw, _GLYPHS: _glyphs, _SIGNS: _signs}


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of all texts, the values of those that are placeholders (else 0), and each text's first token, plus the end.

    A capitalised word that follows another word within a sentence is a name, and so are those right after it; a sentence
    does not end with a line, but with an empty one; digits parted by ``.`` or ``,`` are one number; a unit stands right after a number.
    """
    found = _templates(_tokens(texts))
    return found.tokens, found.values, found.opens


def windows(of: _Sequence, size: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of ``size`` within texts, and whether each has words enough; templates that have not: left out."""
    n = len(of.tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, np.uint64(size + (kind << 8)))
    for k in range(size):
        h = (h ^ of.tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    row = np.searchsorted(of.opens, np.arange(len(of.tokens)), "right")
    words = np.concatenate([[0], np.cumsum(of.words)])
    worded = words[size:] - words[:-size] >= min(LITERALS, size)
    within = row[:n] == row[size - 1 :]
    at = np.flatnonzero(within & worded if kind in (_TEMPLATE, _CAPITALS) else within)
    return at, h[at], worded[at]


_SCHEMA = "id long, at long, hash long, slots array<long>"


def _window_rows(ids: pa.Array, texts: pa.Array, wanted: list[tuple[int, int]], keep) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SCHEMA`` of the windows of all ``wanted`` kinds and sizes whose hashes are to ``keep``."""
    for begin, end in bpe.steps(texts):
        read = _tokens(texts.slice(begin, end - begin))
        for kind in sorted({k for k, _ in wanted}):
            of = _SEQUENCES[kind](read)
            for size in sorted(size for k, size in wanted if k == kind):
                at, h, _ = windows(of, size, kind)
                good = keep(h)
                at, h = at[good], h[good]
                if len(at):
                    row = np.searchsorted(of.opens, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin).take(pa.array(row)), *_columns(of, size, at, at - of.opens[row], h)], names=["id", "at", "hash", "slots"])


def _columns(of: _Sequence, size: int, at: np.ndarray, place: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    inside = of.values[at[:, None] + np.arange(size)]
    some = inside != 0
    return [pa.array(place), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)), pa.array(inside[some].view(np.int64)))]


def _item_windows(text: pa.Array) -> Iterator[tuple[int, int, _Sequence, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, size, sequence, windows) by which one item is sought."""
    read = _tokens(text)
    told = False
    for kind in (_TEMPLATE, _CAPITALS):
        of = _SEQUENCES[kind](read)
        size = min(len(of.tokens), WINDOW)
        at, h, worded = windows(of, size, kind) if int(of.words.sum()) >= LITERALS else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        if len(at):
            told |= kind == _TEMPLATE
            yield kind, size, of, at, h, worded
    if not told:  # signs such as those of arithmetic tell what too few words do not; those around the item are not its own
        of = _signs(read)
        own = np.flatnonzero(of.words | (of.values != 0))
        of = _Sequence(*(x[own[0] : own[-1] + 1] for x in of[:3]), np.array([0, own[-1] + 1 - own[0]])) if len(own) else of
        if len(own) and (of.values != 0).any() and int((of.values == 0).sum()) >= LITERALS:
            size = min(len(of.tokens), WINDOW)
            at, h, _ = windows(of, size, _SIGNS)
            yield _SIGNS, size, of, at, h, np.zeros(len(at), bool)
    kind, of = (_RAW, raw) if len((raw := _raw(read)).tokens) else (_GLYPHS, _glyphs(read))
    if size := min(len(of.tokens), WINDOW):
        yield kind, size, of, *windows(of, size, kind)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of a chunk of the prefilter as bits."""
    for batch in batches:
        out = []
        for slots in batch.column(1):
            bits = np.zeros(8 * CHUNK, bool)
            bits[slots.values.to_numpy()] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "bits"])


def find(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document that holds a benchmark item: doc_id, item_id, n_windows, n_matched, share.

    A document holds an item if at least ``covered`` of the item's distinct windows of one kind occur in it, or those of
    ``RUN`` tokens in a row, some with words enough, on one diagonal; ``share`` may be less than ``covered`` then. Kinds are
    templates, templates in which the first words of sentences are names too if they are capitalised, and tokens in lower
    case. Values of templates correspond one to one along their diagonal; where a share of ``covered`` contradicts itself,
    tokens count only if the whole item is there. Windows are of ``WINDOW`` tokens; a shorter item is one window. A template
    tells something by ``LITERALS`` words or more; where it has fewer, its signs count as well, as those of arithmetic do, and it is held where
    all of it stands in a row. So are tokens without a window of enough words, and of an item without letters and digits, all
    characters but white space. Documents emit
    only windows that pass a fixed-size prefilter; a hash join with the benchmark's windows settles the rest, at whatever
    size the benchmark has.

    Null and blank texts, and rows with null ids, hold nothing and are never held; rows repeated under an id count once,
    and different texts of one item id are sought one by one; only the named columns are read.
    """
    items = benchmark.select(benchmark[item_col].cast("long").alias("id"), benchmark[item_text_col].cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    items = items.distinct().select("id", F.xxhash64("text").alias("variant"), "text")
    given = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for kind, size, of, at, h, worded in _item_windows(bpe.filled(batch.column(2).slice(i, 1))):
                    same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [same[0], *_columns(of, size, at, at, h), same[1], *(pa.array(np.full(len(at), x)) for x in (kind, size)), pa.array(worded)],
                        names=["id", "at", "hash", "slots", "variant", "kind", "size", "worded"],
                    )

    index = items.mapInArrow(of_items, _SCHEMA + ", variant long, kind long, size long, worded boolean")
    index = checkpoint(index)
    wanted = sorted((r["kind"], r["size"]) for r in index.select("kind", "size").distinct().collect())  # kinds times window sizes at most
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in index.select((F.pmod("hash", F.lit(SLOTS)) / F.lit(8 * CHUNK)).cast("int").alias("chunk"), F.pmod("hash", F.lit(8 * CHUNK)).cast("int").alias("slot")).distinct().groupBy("chunk").agg(F.collect_list("slot").alias("slots")).mapInArrow(_bits, "chunk int, bits binary").collect():
        bits[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(h: np.ndarray) -> np.ndarray:
            slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
            return (sent.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            yield from _window_rows(batch.column(0), bpe.filled(batch.column(1)), wanted, keep)

    held = given.mapInArrow(tidy(of_docs), _SCHEMA)
    item = ["item_id", "variant", "kind"]
    known = index.select(F.col("id").alias("item_id"), "variant", "kind", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), "worded")
    of_words = F.when(F.col("worded"), F.col("hash"))
    totals = index.withColumnRenamed("id", "item_id").groupBy(*item).agg(F.countDistinct(of_words).alias("n_worded"), F.countDistinct("at").alias("n_all"))
    met = held.join(known, "hash").filter(F.size("slots") == F.size("item_slots"))
    lines = met.groupBy(F.col("id").alias("doc_id"), *item, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.collect_set(of_words).alias("hashes"), F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs")
    )
    n_pairs = F.size("pairs")
    one_to_one = (F.size(F.array_distinct(F.col("pairs.item_slots"))) == n_pairs) & (F.size(F.array_distinct(F.col("pairs.slots"))) == n_pairs)
    blank = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def further(row, x):
        run = F.when(x == row["last"] + 1, row["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(row["most"], run).alias("most"))

    run = F.when(F.size("hashes") > 0, F.aggregate(F.array_sort("places"), blank, further, lambda row: row["most"])).otherwise(F.lit(0))
    matched = lines.withColumn("fit", one_to_one).withColumn("run", run).groupBy("doc_id", *item).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("fit"), F.col("hashes")))))).cast("long").alias("n_hashes"),
        F.coalesce(F.max(F.when(F.col("fit"), F.size("places"))), F.lit(0)).cast("long").alias("n_places"),
        F.coalesce(F.max(F.when(~F.col("fit"), F.size("hashes"))), F.lit(0)).alias("n_unfit"),
        (F.coalesce(F.max(F.when(F.col("fit"), F.col("run"))), F.lit(0)) > RUN - WINDOW).alias("quoted"),
    )
    some = F.col("n_worded") > 0  # else the whole item has to stand on one diagonal
    judged = matched.join(totals, item).select(
        "doc_id", *item, some.alias("some"), "n_unfit", "quoted", F.when(some, F.col("n_worded")).otherwise(F.col("n_all")).alias("n_windows"), F.when(some, F.col("n_hashes")).otherwise(F.col("n_places")).alias("n_matched")
    ).withColumn("share", F.col("n_matched") / F.col("n_windows"))
    enough = F.col("share") >= F.when(F.col("some"), F.lit(covered)).otherwise(F.lit(1.0))
    enough = enough | F.col("quoted")
    best = F.struct("share", "n_matched", "n_windows")
    template = F.col("kind").isin(_TEMPLATE, _CAPITALS, _SIGNS)
    chosen = judged.groupBy("doc_id", "item_id", "variant").agg(
        F.max(F.when(enough & template, best)).alias("by_template"),
        F.max(F.when(enough & ~template, best)).alias("by_tokens"),
        (F.max(F.col("n_unfit") / F.col("n_windows")) >= covered).alias("unfit"),
    )
    # The tokens of a copy whose values do not correspond prove it only if they are all the same.
    by_tokens = F.when((F.col("by_tokens.share") >= 1) | ~F.col("unfit"), F.col("by_tokens"))
    found = chosen.select("doc_id", "item_id", F.greatest("by_template", by_tokens).alias("best")).filter("best IS NOT NULL").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return found.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.share")


def remove(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item (see ``find``); all others whole, with all their columns."""
    return without(docs, id_col, checkpoint(find(docs, benchmark, covered, id_col=id_col).select("doc_id").distinct()))
