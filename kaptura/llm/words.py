"""ASCII-folded words of UTF-8 text: letters and digits of ASCII, and every byte beyond it."""

from __future__ import annotations

import re

import numpy as np

#: Upper case to lower, other ASCII than letters and digits to a space, bytes beyond ASCII as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def framed(words: list[bytes]) -> str:
    """Words with one space around each; every byte is one character, so places are bytes."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def word_starts(words: list[bytes]) -> np.ndarray:
    """Where each word's leading space stands in ``framed(words)``."""
    return np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])[:-1])) if words else np.zeros(0, np.int64)


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in ``text`` of spans of words (first, beyond last)."""
    at = [m.span() for m in WORD.finditer(lower_ascii(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def lower_ascii(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
