"""Language identification with a bit-sliced Bloom filter of character n-grams.

One slot of the filter holds a bit for every language, so one probe of an n-gram gives the mask of all languages
that (may) hold it. A text's languages are compared by the popcounts of these masks, corrected for false positives.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import bpe
from brindle.llm.memory import tidy
from brindle.plans.recovery import checkpoint, drop

#: Characters of an n-gram, hash functions, and slots of the filter (4 MB for every 64 languages, whatever the data).
N, PROBES, SLOTS = 4, 2, 1 << 19
#: Bound of the fit: about so many labelled documents of each language.
FIT_DOCS = 1500
#: An n-gram belongs to a language with at least this many uses in its sample and this share of its rate in the language where it is commonest.
LEAST, SHARE = 3, 0.3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def _held(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased words, single spaces around and between them; the row of each; letters per row."""
    points, offsets = bpe.code_points(pc.utf8_lower(texts))
    letter = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    begin = letter.copy()
    if len(points):
        begin[1:] = letter[1:] & (~letter[:-1] | (owner[1:] != owner[:-1]))
    kept = np.flatnonzero(letter)
    lead = begin[kept]  # a space goes before each word, and one after the last of each row
    at = np.arange(len(kept)) + np.cumsum(lead) + owner[kept]
    line = np.full(len(kept) + int(lead.sum()) + len(texts), 0x20, np.uint64)
    line[at] = points[kept]
    row = np.repeat(np.arange(len(texts)), np.bincount(owner[kept], minlength=len(texts)) + np.bincount(owner[kept][lead], minlength=len(texts)) + 1)
    n = max(len(line) - N + 1, 0)
    hashes = np.zeros(n, np.uint64)
    for k in range(N):
        hashes = (hashes + line[k : k + n]) * _A
    hashes ^= hashes >> np.uint64(32)
    hashes *= _B
    hashes ^= hashes >> np.uint64(29)
    whole = row[:n] == row[N - 1 :]
    return hashes[whole], row[:n][whole], np.bincount(owner[kept], minlength=len(texts))


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(20 * k)) % np.uint64(SLOTS)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Model:
    """languages (most documents first), the filter (a row for every 64 languages), and each language's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    rates: np.ndarray

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score (the share of its n-grams that the language holds, without false positives) of each text, and its n-grams."""
        out, scores, grams = [], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        k = len(self.languages)
        for begin, end in bpe.steps(texts):
            hashes, row, letters = _held(texts.slice(begin, end - begin))
            n = end - begin
            slots = _slots(hashes)
            masks = [functools.reduce(np.bitwise_and, [line[slot] for slot in slots]) for line in self.table]
            grams[begin:end] = np.bincount(row, minlength=n)
            total = np.maximum(grams[begin:end], 1)
            counts = np.stack([np.bincount(row, weights=(masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n) for i in range(k)], 1) if k else np.zeros((n, 1))
            true = np.clip((counts / total[:, None] - self.rates) / (1 - self.rates), 0, 1) if k else counts
            best = true.argmax(1)
            out += [self.languages[b] if m and k else "und" for b, m in zip(best.tolist(), letters.tolist(), strict=True)]
            scores[begin:end] = true[np.arange(n), best] * (letters > 0)
        return out, scores, grams


def fit(labelled: DataFrame) -> Model:
    """A model from ``labelled`` (id, text, lang; null langs and texts are left out).

    About ``FIT_DOCS`` documents of each language are taken, by a hash of their id. The cluster counts their n-grams and decides which
    of them belong to a language; the driver gets the languages and the bits of the filter, a slot at most once for every 64 languages.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    table = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    if not languages:
        return Model([], table, np.zeros(1))
    shares: Column = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(FIT_DOCS / r["n"]))])[F.col("lang")]
    numbers: Column = F.create_map(*[x for i, r in enumerate(sizes) for x in (F.lit(r["lang"]), F.lit(i))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_numpy()
            for begin, end in bpe.steps(batch.column(0)):
                hashes, row, _ = _held(batch.column(0).slice(begin, end - begin))
                for lang in np.unique(langs[begin:end]).tolist():
                    grams, uses = np.unique(hashes[(langs[begin:end] == lang)[row]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), lang, np.int32)), pa.array(grams.view(np.int64)), pa.array(uses)], names=["lang", "gram", "uses"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, slots = batch.column(0).to_numpy(), np.stack(_slots(batch.column(1).to_numpy().view(np.uint64)), 1)
            bits = (np.uint64(1) << (langs % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(langs // 64, PROBES)), pa.array(slots.ravel()), pa.array(np.repeat(bits, PROBES))], names=["line", "slot", "bits"])

    counted = known.filter(drawn < shares).select("text", numbers.alias("lang")).mapInArrow(tidy(count), "lang int, gram long, uses long")
    counted = checkpoint(counted.groupBy("lang", "gram").agg(F.sum("uses").alias("uses")))
    totals = counted.groupBy("lang").agg(F.sum("uses").alias("total"))
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("uses") / F.col("total"))
    highest = rated.filter(F.col("uses") >= LEAST).groupBy("gram").agg(F.max("rate").alias("highest"))
    own = rated.filter(F.col("uses") >= LEAST).join(highest, "gram").filter(F.col("rate") >= SHARE * F.col("highest"))
    placed = own.select("lang", "gram").mapInArrow(places, "line int, slot long, bits long").groupBy("line", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[placed["line"].to_numpy(), placed["slot"].to_numpy()] = placed["bits"].to_numpy().view(np.uint64)
    drop(counted)
    filled = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, np.minimum(filled**PROBES, 0.99))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text is a multiple of 5 (null ids: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), n_grams.

    The model learns from text and language of documents not held out, and predicts from whole texts alone. ``und`` with score
    0 goes to texts that are null or without letters, and to all if nothing is labelled. A score near 0 means that no learned
    language holds the text's n-grams. Documents with null ids are judged but not learned from. Repeated rows are judged each; other
    columns are not read, but for those named in ``keep``: then the result is these columns and _lang_pred, _score, _n_grams.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(source.filter(F.col("id").isNotNull() & ~held_out(F.col("id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, grams = model.value.judge(bpe.filled(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores), pa.array(grams)], names=names)

    text = docs[text_col].cast("string").alias("_text")
    if keep is None:
        given = docs.select(text, docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"))
        made = ["lang_pred", "score", "n_grams"]
    else:
        given = docs.select(text, *[docs[c] for c in keep])
        made = ["_lang_pred", "_score", "_n_grams"]
    fields = [*given.schema.fields[1:], *(T.StructField(n, t) for n, t in zip(made, [T.StringType(), T.DoubleType(), T.LongType()], strict=True))]
    names = [f.name for f in fields]
    return given.mapInArrow(tidy(run), T.StructType(fields))
