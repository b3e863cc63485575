"""Plain-Python counterparts of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
DOCUMENTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "The same short text, twice in the table."),
    (5, "The same short text, twice in the table."),
    (6, "The same short text, twice in the table."),
    (7, "Été 日本語 \U0001f642 ▁ ok"),
    (None, "A row without an id has a text."),
]

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text: str | None) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in sets}


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            repeated.update((i, i + 1, i + 2))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


def unigram(train: list[str | None], text: str | None) -> tuple[int, int, int, float]:
    counts = Counter(t for x in train for t in [*words(x), None])
    total, distinct = sum(counts.values()), len(counts)
    own = [*words(text), None]
    score = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
    return len(own), sum(counts[t] > 0 for t in own), total, score
