"""Stand-ins for outside services that fail in known ways, for the queries."""

from __future__ import annotations

from ..operators.embedding import hashed_words


def flaky(texts: list[str]) -> list[list[float]]:
    """A vector service that knows no function without annotations."""
    if any("->" not in t for t in texts):
        raise ValueError("text refused")
    return [[float(len(t))] for t in texts]


def picky(texts: list[str]) -> list[list[float]]:
    if any("lonely" in t for t in texts):
        raise ValueError("not lonely")
    return hashed_words(texts)


def refusing(texts: list[str]) -> list[list[float]]:
    raise ValueError("not this one")


def answering(prompts: list[str]) -> list[str]:
    """A model that finds one thing in each function, says nonsense about walks and refuses builds."""
    out = []
    for p in prompts:
        if "def build" in p:
            raise ValueError("401 unauthorized")
        out.append("I see a problem: it walks." if "def walk" in p else 'Here: {"issues": [{"type": "behavior_mismatch", "description": "It does more.", "suggestion": "Describe what it changes.", "confidence": 0.85, "line_number": 1}], "confidence": 0.9}')
    return out


def no_pause(seconds: float) -> None:
    return None


def answering_quietly(prompts: list[str]) -> list[str]:
    return [answering([p])[0] if "def build" not in p else "none" for p in prompts]
