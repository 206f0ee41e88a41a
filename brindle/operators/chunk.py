"""Recursive chunking with exact offsets.

Pieces are spans of the text from the start, so a chunk's offsets are known, never searched for.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Length = Callable[[str], int]

# Separators from coarse to fine; of markdown they are regular expressions.
TEXT_SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]
MARKDOWN_SEPARATORS = [r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", r"\. ", r"\? ", r"! ", r"; ", r", ", r" ", ""]


@dataclass(frozen=True)
class Chunk:
    text: str
    start: int
    end: int


@functools.cache
def tokenizer_length(path: str) -> Length:
    """Length in tokens of a tokenizers JSON file, read once per worker; special strings count as text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def token_length(encoding) -> Length:
    """Length in tokens of a tiktoken-like encoding; special strings count as text."""
    return lambda text: len(encoding.encode(text, disallowed_special=()))


class Chunker:
    """Splits at the coarsest separator present, merges small pieces up to ``size`` and goes on inside larger ones."""

    def __init__(self, size: int = 512, overlap: int = 64, markdown: bool = False, length: Length = len, separators: list[str] | None = None):
        if size <= 0:
            raise ValueError("size must be positive")
        if not 0 <= overlap < size:
            raise ValueError("overlap is at least 0 and below size")
        self.size, self.overlap, self.length = size, overlap, length
        given = separators or (MARKDOWN_SEPARATORS if markdown else TEXT_SEPARATORS)
        self.separators = [s if markdown else re.escape(s) for s in given]

    def split(self, text: str | None) -> list[Chunk]:
        """Chunks in order, stripped; a blank text has none."""
        if not text or not text.strip():
            return []
        out = []
        for a, b in self._spans(text, 0, len(text), 0):
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip())
            b = a + len(piece.strip())
            if a < b:
                out.append(Chunk(text[a:b], a, b))
        return out

    def _pieces(self, text: str, a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
        """Spans between a and b that begin at a separator, and the level below the separator used."""
        for i in range(level, len(self.separators)):
            if not self.separators[i]:
                return [(k, k + 1) for k in range(a, b)], i + 1
            cuts = [m.start() for m in re.compile(self.separators[i]).finditer(text, a, b)]
            if cuts:
                edges = sorted({a, *cuts, b})
                return list(zip(edges, edges[1:], strict=False)), i + 1
        return [(a, b)], len(self.separators)

    def _spans(self, text: str, a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        pieces, below = self._pieces(text, a, b, level)
        small: list[tuple[int, int]] = []
        for x, y in pieces:
            if self.length(text[x:y]) < self.size:
                small.append((x, y))
                continue
            yield from self._merged(text, small)
            small = []
            if below < len(self.separators):
                yield from self._spans(text, x, y, below)
            else:
                yield x, y
        yield from self._merged(text, small)

    def _merged(self, text: str, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Neighbouring pieces joined while the sum of their lengths, white space included, fits; the next chunk begins with the last of
        them, as many as fit ``overlap`` and leave room for the piece to come."""
        first = total = 0
        sizes = [self.length(text[a:b]) for a, b in pieces]
        for i, n in enumerate(sizes):
            if i > first and total + n > self.size:
                yield pieces[first][0], pieces[i - 1][1]
                while total > self.overlap or 0 < total > self.size - n:
                    total -= sizes[first]
                    first += 1
            total += n
        if pieces:
            yield pieces[first][0], pieces[-1][1]


def chunk(sections: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "id", text_col: str = "text", structured_col: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """(id, section order kept) chunks of every text: id, chunk_index, content, char_start, char_end.

    ``structured_col`` names a boolean that picks the markdown separators; ``tokenizer`` the path of a tokenizers JSON file,
    at the same place on every machine, whose tokens are the unit of ``size`` and ``overlap``; else it is characters.
    One Arrow pass, no shuffle.
    """
    Chunker(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length = tokenizer_length(tokenizer) if tokenizer else len
        chunkers = {flag: Chunker(size, overlap, flag, length) for flag in (False, True)}
        for batch in batches:
            rows = []
            for own, text, flag in zip(batch["id"], batch["text"], batch["structured"], strict=True):
                rows += [(own, i, c.text, c.start, c.end) for i, c in enumerate(chunkers[bool(flag)].split(text))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "content", "char_start", "char_end"])

    from pyspark.sql import functions as F

    flag = F.col(structured_col) if structured_col else F.lit(False)
    given = sections.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), flag.alias("structured"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInPandas(run, f"id {kind}, chunk_index int, content string, char_start int, char_end int")
