"""Recursive chunking, which no expression can say: an Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators from coarse to fine; the last splits anywhere.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", "")


def split(text: str | None, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that helps.

    Neighbours repeat up to ``overlap`` characters of whole parts. Separators
    stay at the end of their part, so the pieces without overlap join to the text.
    """
    if not text:
        return []
    parts = _parts(text, size, separators)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in parts:
        if held and length + len(p) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        out.append("".join(held))
    return [x for x in (o.strip() for o in out) if x]


def _parts(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text]
    sep, rest = separators[0], separators[1:]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    pieces = text.split(sep)
    for i, piece in enumerate(pieces):
        whole = piece + (sep if i < len(pieces) - 1 else "")
        if whole:
            out += _parts(whole, size, rest) if len(whole) > size else [whole]
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def recursive_chunks(texts: pa.Array) -> pa.Array:
    """A batch of texts; those that fit into one chunk, and null ones, never reach `split`."""
    long_ = pc.greater(pc.utf8_length(texts), 500).fill_null(False)
    whole = pc.utf8_trim_whitespace(texts).to_pylist()
    out = [[w] if w else [] for w in whole]
    at = np.flatnonzero(long_.to_numpy(zero_copy_only=False))
    for i, t in zip(at.tolist(), texts.filter(long_).to_pylist(), strict=True):
        out[i] = split(t)
    return pa.array(out, pa.list_(pa.string()))
