"""Edit distances, Jaro-Winkler and deletion neighbourhoods of short strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable


def fold(text: str) -> str:
    """Case folded, compatibility forms resolved, Latin accents removed."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()) if not unicodedata.combining(c)).replace("ß", "ss")


def osa(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap of neighbours), cut off above ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    common = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                common.append(x)
                break
    if not common:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(common, other, strict=True)) / 2
    m = len(common)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and all its forms with up to ``most`` letters left out."""
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def neighbourhood(words: Iterable[str], most: int = 1) -> dict[str, list[str]]:
    """Deletion form -> words, so that words one edit apart meet in a shared form."""
    out: dict[str, list[str]] = {}
    for w in words:
        for d in deletions(w, most):
            out.setdefault(d, []).append(w)
    return out


def near(word: str, table: dict[str, list[str]], most: int = 1) -> list[tuple[str, int]]:
    """Words of a neighbourhood table within ``most`` edits, with their distance, closest first."""
    found = {w for d in deletions(word, most) for w in table.get(d, ())}
    return sorted(((w, n) for w in found if (n := osa(word, w, most)) <= most), key=lambda x: (x[1], x[0]))
