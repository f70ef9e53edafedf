"""The token rules on Python strings, for operators that run in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from loomspan.functions import lexicon as L

_TOKEN = re.compile(L.TOKEN)
SENTENCE = re.compile(L.SENTENCE)
PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*")
STOP = frozenset(L.STOPWORDS)


_HYPHEN = re.compile(rf"([A-Za-z])-{L.SPACE}*\n{L.SPACE}*([A-Za-z])")
_NUMBER = re.compile(rf"(?m)^{L.SPACE}*[0-9]{{1,4}}{L.SPACE}*$")
_ENDS = re.compile(rf"^{L.SPACE}+|{L.SPACE}+\Z")


def collapse(text: str) -> str:
    return " ".join(text.split())


def clean_block(text: str) -> str:
    """The same as the column function of that name."""
    for a, b in L.LETTERS.items():
        text = text.replace(a, b)
    text = _HYPHEN.sub(r"\1\2", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub("[ \t]+", " ", _NUMBER.sub("", text))
    return _ENDS.sub("", re.sub("\n{3,}", "\n\n", re.sub(" *\n *", "\n", text)))


def sample_indexes(total: int, most: int) -> list[int]:
    """The same as the column function of that name."""
    if total <= 0 or most <= 0:
        return []
    if total <= most:
        return list(range(total))
    return sorted({round(i * ((total - 1) / max(most - 1, 1))) for i in range(most)})


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@lru_cache(200_000)
def stem(token: str) -> str:
    if len(token) <= 3:
        return token
    for group in L.SUFFIXES:
        for s in group:
            if token.endswith(s) and len(token) > len(s) + 2:
                return token[: -len(s)]
    return token


def content(toks: list[str]) -> list[str]:
    """Canonical stems that are no stopwords; all of them if none is left."""
    stems = [stem(t) for t in toks]
    kept = [s for s in stems if s not in STOP] or stems
    return [L.VARIANTS.get(s, s) for s in kept]


def is_noise(text: str) -> bool:
    """The same as the column function of that name."""
    text = collapse(text)
    low, toks = text.lower(), tokens(text)
    n, digits = len(toks), sum(any(c in "0123456789" for c in t) for t in toks)
    if not n or digits >= 0.22 * n or any(m in low for m in L.NOISE_MARKS):
        return True
    if n <= 20 and sum(len(x) > 1 and x.upper() == x and x.lower() != x for x in text.split(" ")) >= max(4, n // 2):
        return True
    return n >= 10 and digits >= 2 and sum(map(len, toks)) < 3.7 * n


def distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


def shingles(values: list[str], n: int = 3) -> list[str]:
    return distinct([" ".join(values[i : i + n]) for i in range(max(1, len(values) - n + 1))]) if values else []


def counts(values: list[str]) -> list[int]:
    """How often each distinct value stands, in the order of ``distinct``."""
    return list(Counter(values).values())


def reach(toks: list[str]) -> int:
    """Letters of the longest stretch of the joined tokens with fewer than three whole content tokens in it.

    Two texts that share no run of three content terms have no longer stretch in common.
    """
    begins, ends, at = [], [], 0
    for t in toks:
        if stem(t) not in STOP:
            begins.append(at)
            ends.append(at + len(t))
        at += len(t) + 1
    whole = max(0, at - 1)
    if len(begins) < 4:
        return whole
    begins, ends = [0, *begins], [*ends, whole]
    return max(ends[i + 2] - begins[i] for i in range(len(ends) - 2))
