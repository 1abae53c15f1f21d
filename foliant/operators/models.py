"""Calls of models as functions of text, with what surrounds them: splitting, fallback and retries. The functions given here are deterministic and stand in for a model."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from foliant.operators import extraction
from foliant.tables import cut_table

#: Texts below are passed through, texts above are split into parts of so many characters, and the time limits of the tries, in seconds.
SHORT, LARGE, PART = 20, 6000, 5000
TRIES = (60, 120, 180)


def packed(text: str, most: int) -> list[str]:
    """The paragraphs of a text, packed greedily into parts of at most `most` characters; a longer paragraph is a part of its own."""
    parts: list[str] = []
    for paragraph in filter(str.strip, text.split("\n\n")):
        if parts and len(parts[-1]) + 2 + len(paragraph) <= most:
            parts[-1] += "\n\n" + paragraph
        else:
            parts.append(paragraph)
    return parts


def correct(text: str, model: Callable[[str], str | None]) -> str:
    """`text` through `model`, in parts if it is large; a part that fails, or comes back empty, stays as it is."""
    if len(text) < SHORT:
        return text

    def one(part: str) -> str:
        try:
            return model(part) or part
        except Exception:  # whatever a model raises, the text isn't lost
            return part

    return "\n\n".join(map(one, packed(text, PART))) if len(text) > LARGE else one(text)


def retried(text: str, model: Callable[[str, int], str]) -> str | None:
    """What `model` gives within the first time limit it keeps; None if it keeps none."""
    for limit in TRIES:
        try:
            return model(text, limit)
        except TimeoutError:
            continue
    return None


def tidy(text: str) -> str:
    """A stand-in for a correction: cut words joined, spaces closed up."""
    return re.sub(r"[ \t]+", " ", re.sub(r"(\w)[-¬]\n(\w)", r"\1\2", text)).strip()


def slow_at(seconds: int) -> Callable[[str, int], str]:
    """A stand-in for a model that takes `seconds`, twice that for a long text."""

    def model(text: str, limit: int) -> str:
        if limit < seconds * (1 + (len(text) > LARGE)):
            raise TimeoutError
        return tidy(text)

    return model


def extract(text: str) -> str:
    """A stand-in for an extraction: the entities and relations of a text as JSON."""
    found = extraction.entities(text)
    said = extraction.Reading(text, found).relations()
    return json.dumps({"entities": [{"name": e.name, "type": e.type} for e in found], "relations": [{"subject": r.subject, "predicate": r.predicate, "object": r.object or r.literal} for r in said]}, ensure_ascii=False)


def embed(text: str, size: int = 16) -> list[float]:
    """A stand-in for an embedding: hashed words, signed, of length 1."""
    out = [0.0] * size
    for word in extraction.plain_name(text).split():
        h = hashlib.md5(word.encode()).digest()
        out[h[0] % size] += 1 if h[1] % 2 else -1
    length = sum(x * x for x in out) ** 0.5
    return [x / length for x in out] if length else out


def rebuilt(cache: DataFrame) -> DataFrame:
    """`cache`, written to the shared folder and read from there."""
    return cut_table(cache)
