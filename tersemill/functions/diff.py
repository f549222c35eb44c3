"""A shortest edit script between two texts, in linear space.

The script is found by divide and conquer: the first text is halved, and the place in the second one at which its
halves meet best is where the common subsequences of prefixes and of suffixes are longest together. Their lengths
for all places at once are the bits of one number, which takes a few operations on whole numbers for each word, so
time is the product of the lengths by the width of a machine word, and no table of that size is ever held.
"""

from __future__ import annotations

import re

import numpy as np

PIECES = re.compile(r"\s+|\S+")
#: Products of lengths up to which a table is filled in; places of a word up to which its mask isn't kept.
SMALL, FEW = 512, 8


def common_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of a longest common subsequence of x and each prefix of y."""
    m = len(y)
    places: dict[int, list[int]] = {}
    for j, word in enumerate(y):
        places.setdefault(word, []).append(j)
    masks = {}
    for word, at in places.items():
        if len(at) > FEW:
            row = np.zeros(m, np.uint8)
            row[at] = 1
            masks[word] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
    full = (1 << m) - 1
    v = full
    for word in x:
        at = places.get(word)
        if at is not None:
            mask = masks.get(word)
            if mask is None:
                mask = 0
                for j in at:
                    mask |= 1 << j
            u = v & mask
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def small_matches(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    rows = [[0] * (len(y) + 1)]
    for a in x:
        before, row = rows[-1], [0]
        for j, b in enumerate(y):
            row.append(before[j] + 1 if a == b else max(before[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def matches(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if b < 0:  # a stretch that both have
            out.extend((a + k, c + k) for k in range(d))
            continue
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d, tail = b - 1, d - 1, tail + 1
        if tail:
            stack.append((b, -1, d, tail))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= SMALL or b - a == 1:
            out.extend((a + i, c + j) for i, j in small_matches(x[a:b], y[c:d]))
            continue
        mid = (a + b) // 2
        cut = c + int(np.argmax(common_lengths(x[a:mid], y[c:d]) + common_lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]))
        stack.append((mid, b, cut, d))
        stack.append((a, mid, c, cut))
    return out


def word_diff(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(op, value): equal, delete and insert runs of words and blanks. What isn't inserted makes the old text, what
    isn't deleted the new one. Null texts are empty."""
    x, y = PIECES.findall(old or ""), PIECES.findall(new or "")
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(w, len(codes)) for w in words] for words in (x, y))
    out: list[tuple[str, str]] = []
    equal: list[str] = []
    i = j = 0

    def flush() -> None:
        if equal:
            out.append(("equal", "".join(equal)))
            equal.clear()

    for k, m in [*matches(a, b), (len(x), len(y))]:
        if i < k or j < m:
            flush()
            out.extend((op, "".join(part)) for op, part in (("delete", x[i:k]), ("insert", y[j:m])) if part)
        if k < len(x):
            equal.append(x[k])
        i, j = k + 1, m + 1
    flush()
    return out
