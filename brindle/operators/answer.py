"""Answers from retrieved context."""

from __future__ import annotations

import re
from collections.abc import Callable

from brindle.functions.citations import NO_SOURCES, SYSTEM_PROMPT
from brindle.model import NO_CONTEXT, SearchResponse

#: Turns chat messages into an answer.
Chat = Callable[[list[dict]], str]


class GenerationError(RuntimeError):
    """The chat model failed."""


def build_messages(response: SearchResponse, system_prompt: str = SYSTEM_PROMPT) -> list[dict]:
    content = f"Sources:\n\n{response.context or NO_SOURCES}\n\nQuestion: {response.query}"
    return [{"role": "system", "content": system_prompt}, {"role": "user", "content": content}]


def extractive(messages: list[dict]) -> str:
    """The first sentence of the first source with its label: an offline stand-in for a chat model."""
    found = re.search(r"(\[\d+\])[^\n]*\n(.+?(?:[.!?]|$))", messages[-1]["content"], re.S)
    return f"{found[2].strip()} {found[1]}" if found else NO_CONTEXT


def generate_answer(response: SearchResponse, chat: Chat = extractive) -> str:
    """One chat call; with nothing retrieved a fixed refusal and no call."""
    if not response.results:
        return NO_CONTEXT
    try:
        return chat(build_messages(response))
    except Exception as e:
        raise GenerationError(f"answer generation failed: {e}") from e


def build_chain(search: Callable[[str], SearchResponse], chat: Chat = extractive) -> Callable[[str], dict]:
    """question -> {answer, sources}."""

    def ask(question: str) -> dict:
        response = search(question)
        return {"answer": generate_answer(response, chat), "sources": response.results}

    return ask
