"""Hashed byte 4-grams of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

BUCKETS = 1 << 16

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def hashed(data: np.ndarray) -> np.ndarray:
    """A bucket for each run of four bytes."""
    if len(data) < 4:
        return np.zeros(0, np.uint16)
    code = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        code |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.uint16)


def padded(texts: pa.Array, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each with a blank before and two after, and where each begins.

    With `letters`: in lower case, every run of ASCII bytes that are no letters as one blank.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if letters:
        texts = pc.utf8_lower(texts)
    data, at = text_bytes(pc.binary_join_element_wise(" ", texts, "  ", ""))
    if not letters:
        return data, at
    data = _LETTERS[data]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = keep[at[1:] - 1] = keep[at[1:] - 2] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]
