"""Labels, locators, context blocks and prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of prompts.
SYSTEM_PROMPT = (
    "Answer the user's question using only the numbered sources provided. "
    "Cite every claim with the source label in square brackets, e.g. [1] or [2][3]. "
    "If the sources do not contain the answer, say you don't know."
)
NO_SOURCES = "(no sources found)"


def label(rank: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("]"))


def locator(title: Column, filename: Column, page: Column) -> Column:
    """Title, or the file's name if there is none, and the page unless it is null."""
    return F.concat(F.coalesce(F.nullif(title, F.lit("")), filename), F.coalesce(F.concat(F.lit(", p. "), page.cast("string")), F.lit("")))


def returned(rank: Column, filename: Column, page: Column) -> Column:
    """Label and file for reports; page 0 counts as none here."""
    return F.concat(label(rank), F.lit(" "), filename, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"))).otherwise(""))


def judge_context(filename: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("Source: "), filename, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"))).otherwise(""), F.lit("\n"), text)


def block(rank: Column, where: Column, text: Column) -> Column:
    """Aggregate: numbered sources in order of rank, parted by blank lines; of no rows empty."""
    entry = F.concat(label(rank), F.lit(" "), where, F.lit("\n"), text)
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), entry.alias("entry"))))
    return F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n\n")


def user_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Sources:\n\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit(NO_SOURCES)), F.lit("\n\nQuestion: "), question)


def snippet(text: Column, size: int = 300) -> Column:
    """One line of a text for a terminal."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)
