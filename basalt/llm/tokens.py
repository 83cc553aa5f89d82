"""Tokens as this project counts them: a longest run of ASCII letters, digits and underscores, or any
other single character that is not white space. NULL has none."""

from __future__ import annotations

import re

import numpy as np

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def count(text: str | None) -> int:
    return len(TOKEN.findall(text)) if text else 0


def offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets at which tokens start and end."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array(spans, np.int64)
    return a[:, 0], a[:, 1]
