"""Blocks that two strings have in common: the longest, those of some length, and the share of all of them.

The blocks are those of the longest-first recursion: the longest common block is taken, of equals the one that
stands first in the left string and then in the right, and what lies left and right of it is treated alike.
The longest one is found by its length: a common block of n letters has common parts of every length below,
so the length is searched by doubling and halving over the sets of a string's parts; long ones follow from
the common parts of a few letters that lie on one diagonal. The time follows the strings' lengths, not
their product.
"""

from __future__ import annotations

from collections.abc import Iterator

LONG = 12  # letters from which common parts are few enough to be joined one by one


def _parts(s: str, n: int) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def _common(a: str, b: str, n: int) -> bool:
    """Whether the strings have a block of n letters in common."""
    there = _parts(b, n)
    return any(a[i : i + n] in there for i in range(len(a) - n + 1))


def _extended(a: str, b: str, n: int) -> tuple[int, int, int] | None:
    """The longest match of n letters or more from the common parts of n letters, those on one diagonal joined.

    None if the strings repeat themselves so much that there are far more such pairs than letters.
    """
    places: dict[str, list[int]] = {}
    for j in range(len(b) - n + 1):
        places.setdefault(b[j : j + n], []).append(j)
    begins: dict[int, tuple[int, int]] = {}  # diagonal: begin and latest place in a of its run
    best, left = (0, 0, 0), 16 * (len(a) + len(b))
    for i in range(len(a) - n + 1):
        found = places.get(a[i : i + n], ())
        left -= len(found)
        if left < 0:
            return None
        for j in found:
            begin, latest = begins.get(j - i, (i, -2))
            begin = begin if latest == i - 1 else i
            begins[j - i] = begin, i
            size = i - begin + n
            if size > best[2] or size == best[2] and (begin, j - i + begin) < best[:2]:
                best = begin, j - i + begin, size
    return best


def longest_match(a: str, b: str, least: int = 1) -> tuple[int, int, int]:
    """Begin in a, begin in b, letters of the longest common block; the first of equals. Without one, (0, 0, 0)."""
    most = min(len(a), len(b))
    if most < least or not _common(a, b, least):
        return 0, 0, 0
    low, high = least, most + 1  # low fits, high does not
    while (step := min(2 * low, high - 1)) > low:
        if low >= LONG and (found := _extended(a, b, low)) is not None:
            return found
        if not _common(a, b, step):
            high = step
            break
        low = step
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _common(a, b, mid) else (low, mid)
    there = _parts(b, low)
    i = next(i for i in range(len(a) - low + 1) if a[i : i + low] in there)
    return i, b.find(a[i : i + low]), low


def longest(a: str, b: str) -> int:
    """Letters of the longest common block."""
    return longest_match(a, b)[2]


def matching_blocks(a: str, b: str, least: int = 1) -> Iterator[tuple[int, int, int]]:
    """The recursion's blocks of at least so many letters, from left to right."""
    todo = [(0, len(a), 0, len(b), None)]
    while todo:
        alo, ahi, blo, bhi, block = todo.pop()
        if block is not None:
            yield block
            continue
        i, j, n = longest_match(a[alo:ahi], b[blo:bhi], least)
        if n:
            i, j = alo + i, blo + j
            todo += [(i + n, ahi, j + n, bhi, None), (0, 0, 0, 0, (i, j, n)), (alo, i, blo, j, None)]


def ratio(a: str, b: str) -> float:
    """Twice the letters of all blocks over the letters of both strings; 1 for two empty strings."""
    size = len(a) + len(b)
    return 2 * sum(n for _, _, n in matching_blocks(a, b)) / size if size else 1.0
