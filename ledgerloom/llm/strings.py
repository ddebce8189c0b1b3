"""String distances for short names."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn `a` into `b`."""
    if a == b:
        return 0
    before, last, n = [], list(range(len(b) + 1)), len(b)
    for i, x in enumerate(a, 1):
        row = [i] + [0] * n
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row[j] = cost
        before, last = last, row
    return last[n]


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """The Jaro-Winkler similarity with a prefix weight of 0.1 over at most four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)
