"""The gate that decides which pages need OCR, and the layout of recognised boxes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from statistics import median
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import Settings


class OcrUnavailable(ValueError):
    """No OCR engine is installed."""


class Engine(Protocol):
    def read(self, image: Any) -> str: ...


class RapidOcrEngine:
    """RapidOCR; boxes below ``min_confidence`` are left out, the others laid out in lines."""

    def __init__(self, min_confidence: float = 0.5):
        try:
            from rapidocr import RapidOCR
        except ImportError as e:
            raise OcrUnavailable("the OCR engine rapidocr needs the packages rapidocr and onnxruntime") from e
        self.engine, self.min_confidence = RapidOCR(), min_confidence

    def read(self, image: Any) -> str:
        found = self.engine(np.asarray(image.convert("RGB")))
        if found.boxes is None:
            return ""
        boxes = []
        for corners, text, score in zip(np.asarray(found.boxes), found.txts, found.scores, strict=True):
            if score >= self.min_confidence and text.strip():
                (left, top), (_, bottom) = corners.min(0).tolist(), corners.max(0).tolist()
                boxes.append((top, bottom, left, text))
        return layout(boxes)


class TesseractEngine:
    """The Tesseract binary with the language codes ``lang``."""

    def __init__(self, lang: str = "eng"):
        try:
            import pytesseract

            pytesseract.get_tesseract_version()
        except Exception as e:  # the package or the binary
            raise OcrUnavailable("the OCR engine tesseract needs the package pytesseract and the binary on the path") from e
        self.library, self.lang = pytesseract, lang

    def read(self, image: Any) -> str:
        return self.library.image_to_string(image, lang=self.lang)


class PageOcr:
    """Reads pages of a PDF that lack a text layer; the engine is made once per worker, when the first such page comes."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def needs(self, text: str) -> bool:
        """The gate of ``needs_ocr`` for one text."""
        if self.settings.ocr_mode in ("off", "force"):
            return self.settings.ocr_mode == "force"
        return sum(c.isalnum() for c in text) < self.settings.ocr_min_chars

    def read(self, data: bytes, pages: list[int]) -> dict[int, str]:
        """Texts of the given pages (from 0), one page at a time."""
        try:
            import pypdfium2
        except ImportError as e:
            raise OcrUnavailable("OCR of PDF pages needs the packages pypdfium2 and Pillow") from e
        engine = _engine(self.settings)
        document = pypdfium2.PdfDocument(data)
        try:
            return {i: engine.read(document[i].render(scale=self.settings.ocr_dpi / 72).to_pil()).strip() for i in pages}
        finally:
            document.close()


@functools.cache
def _engine(settings: Settings) -> Engine:
    return TesseractEngine(settings.ocr_lang) if settings.ocr_engine == "tesseract" else RapidOcrEngine(settings.ocr_min_confidence)


def needs_ocr(text: Column, mode: str = "auto", min_chars: int = 20) -> Column:
    """off: never, force: always, auto: fewer than ``min_chars`` letters and digits."""
    if mode in ("off", "force"):
        return F.lit(mode == "force")
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < min_chars


Box = tuple[float, float, float, str]


def layout(boxes: list[Box]) -> str:
    """Text of (top, bottom, left, text) boxes: a box whose middle lies within the last line joins it and the
    line grows; words go from left to right; a gap above the median line height is a blank line."""
    lines: list[dict] = []
    for top, bottom, left, text in sorted(boxes, key=lambda b: (b[0], b[2])):
        line = lines[-1] if lines else None
        if line is not None and line["top"] <= (top + bottom) / 2 <= line["bottom"]:
            line["top"], line["bottom"] = min(line["top"], top), max(line["bottom"], bottom)
            line["words"].append((left, text))
        else:
            lines.append({"top": top, "bottom": bottom, "words": [(left, text)], "start": top})
    if not lines:
        return ""
    usual = median(x["bottom"] - x["top"] for x in lines)
    out, above = [], None
    for line in lines:
        if above is not None and line["top"] - above > usual:
            out.append("")
        out.append(" ".join(t for _, t in sorted(line["words"])))
        above = line["bottom"]
    return "\n".join(out)


def layouts(pages: DataFrame) -> DataFrame:
    """(page, text) of pages with a column ``boxes``: array of (top, bottom, left, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page": batch["page"], "text": [layout([(b["top"], b["bottom"], b["left"], b["text"]) for b in boxes]) for boxes in batch["boxes"]]})

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("page", "boxes").mapInPandas(run, f"page {kind}, text string")
