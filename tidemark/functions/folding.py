"""Folding of free-typed text, for use inside vectorised functions."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Lower case without diacritics, runs of white space as one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())
