"""Edit distances, Jaro–Winkler and phonetic codes of short strings."""

from __future__ import annotations

import re


def _distance(a: str, b: str, most: int, cost_of) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit), or most + 1.

    Only cells within ``most`` of the diagonal are worked out, so long strings take linear time.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    n, far = len(b), most + 1
    older: dict[int, int] = {}
    before = {j: j for j in range(min(n, most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            cost = min(row.get(j - 1, far) + 1, before.get(j, far) + 1, before.get(j - 1, far) + (0 if x == y else cost_of(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older.get(j - 2, far) + 1)
            row[j] = min(cost, far)
        if min(row.values(), default=far) > most:
            return far
        older, before = before, row
    return before.get(n, far)


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1."""
    return _distance(a, b, most, lambda x, y: 1)


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swaps = sum(x != y for x, y in zip(hits, (y for y, t in zip(b, taken) if t))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + common * prefix_weight * (1 - jaro)


_SOUNDS = str.maketrans({"c": "k", "q": "k", "g": "k", "p": "b", "v": "f", "w": "f", "z": "s", "j": "s", "x": "s", "d": "t", "n": "m"})


def sound(token: str) -> str:
    """Consonants by place of articulation, doubles once, vowels and h dropped; letters of other scripts stay as they are."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiouyh]", "", token).translate(_SOUNDS))


# The rows of letters on a keyboard.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def confusable(a: str, b: str) -> bool:
    """Whether two letters lie beside each other on a keyboard or sound alike."""
    if a in _AT and b in _AT and abs(_AT[a][0] - _AT[b][0]) <= 1 and abs(_AT[a][1] - _AT[b][1]) <= 1:
        return True
    return sound(a) == sound(b) != ""


def is_slip(a: str, b: str) -> bool:
    """Whether strings one edit apart differ by a left-out, doubled or swapped letter, or by two confusable ones."""
    if len(a) != len(b):
        return True
    at = [k for k in range(len(a)) if a[k] != b[k]]
    return len(at) == 2 or (len(at) == 1 and confusable(a[at[0]], b[at[0]]))


def slips(a: str, b: str, most: int) -> int:
    """Least number of slips of typing between two strings, or most + 1; another letter that is not confusable counts as two."""
    return _distance(a, b, most, lambda x, y: 1 if confusable(x, y) else 2)
