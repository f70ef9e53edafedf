"""Features of all spans of some texts at once, as arrays.

Tokens become numbers in one pass over a text; a span is a stretch of them, so what overlapping windows have in
common is read once, and terms are counted by sorting pairs of a span and a term.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from loomspan.functions import lexicon as L
from loomspan.functions import plain as Y
from loomspan.operators import spans as P

#: Numbers of no term and of a term that the other side cannot have; numbers of terms that a run holds as one integer.
NONE, OTHER, FIRST, BASE = 0, 1, 2, 1 << 21
#: Tokens that may be added to those that are kept; a million take some 300 MB of each worker.
MOST_WORDS = 1 << 16


class Words(dict):
    """The number of each token: twice its canonical term's, and one more if its stem is a stopword."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.kept, self.era = (0, 0), 0

    def __missing__(self, token: str) -> int:
        stem = Y.stem(token)
        self[token] = number = 2 * self.terms.setdefault(L.VARIANTS.get(stem, stem), len(self.terms) + FIRST) + (stem in Y.STOP)
        return number

    @property
    def size(self) -> int:
        return len(self.terms) + FIRST

    def trim(self) -> None:
        """Forgets what was added since ``keep``, if it is much."""
        if len(self) > self.kept[0] + MOST_WORDS:
            self.era += 1  # numbers from before may mean other terms now
            for known, n in ((self, self.kept[0]), (self.terms, self.kept[1])):
                while len(known) > n:
                    known.popitem()

    def keep(self) -> None:
        self.kept = len(self), len(self.terms)

    def release(self) -> None:
        self.kept = 0, 0
        self.trim()


def outline(text: str) -> tuple[list[str], list[tuple[int, int, int, int, int]]]:
    """The tokens of a text, and span_id, start, end, first token, end of tokens of its ``spans.spans``.

    A token never reaches over the end of a sentence, so a window's tokens are those of its sentences.
    """
    toks: list[str] = []
    out: list[tuple[int, int, int, int]] = []
    for m in Y.PARAGRAPH.finditer(text):
        block, first, places = m.group(), len(toks), []
        if len(block) <= 2 * P.LARGE:  # not enough letters for so many tokens
            toks += Y.tokens(block)
        else:
            for s in Y.SENTENCE.finditer(block):
                said = s.group()
                if not said.isspace():
                    places.append((s.start(), s.end(), len(toks)))
                    toks += Y.tokens(said)
        if len(toks) - first < 6:
            del toks[first:]
            continue
        n, offset, windows = len(places), m.start(), []
        if n >= 3 and len(toks) - first > P.LARGE:
            for i in range(0, n, P.STRIDE):
                if i and i + P.STRIDE >= n:
                    break
                z = min(i + P.SIZE, n)
                a, b = places[i][2], places[z][2] if z < n else len(toks)
                if b - a >= 6:
                    windows.append((offset + places[i][0], offset + places[z - 1][1], a, b))
        out += windows or [(offset, m.end(), first, len(toks))]
    if out:
        return toks, [(i, *x) for i, x in enumerate(out)]
    toks, short = [], []
    for i, m in enumerate(Y.SENTENCE.finditer(text)):
        own = Y.tokens(m.group())
        if len(own) >= 3:
            short.append((i, m.start(), m.end(), len(toks), len(toks) + len(own)))
            toks += own
    return toks, short


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of stretches of the given sizes, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class Features:
    """The spans of some texts: ``places`` has (text, span_id, start, end, first token, end of tokens) of each.

    ``span``, ``term`` and ``count`` have a row for each distinct term of a span; ``squares`` and ``sizes`` are the
    sums of squared counts and the numbers of these by span; ``letters`` the lengths of the joined tokens.
    """

    def __init__(self, texts: list[str], words: Words):
        self.texts, self.toks, self.places = texts, [], []
        for k, text in enumerate(texts):
            toks, found = outline(text)
            at = len(self.toks)
            self.places += [(k, i, s, e, at + a, at + z) for i, s, e, a, z in found]
            self.toks += toks
        toks, n = self.toks, len(self.places)
        self.first, self.last = np.array([p[4:] for p in self.places], np.int64).reshape(-1, 2).T
        numbers = np.fromiter(map(words.__getitem__, toks), np.int64, len(toks))
        long = np.fromiter(map(len, toks), np.int64, len(toks))
        self._ends = np.cumsum(long + 1) - 1
        self._begins = self._ends - long
        terms, self._at = numbers >> 1, np.flatnonzero(numbers & 1 == 0)
        self._from, self._to = np.searchsorted(self._at, self.first), np.searchsorted(self._at, self.last)
        self.letters = (self._ends[self.last - 1] - self._begins[self.first]).astype(np.float64) if n else np.zeros(0)
        # spans of stopwords alone have these as their terms
        self.begin, self.end, self.content = self._from.copy(), self._to.copy(), terms[self._at]
        if len(bare := np.flatnonzero(self._from == self._to)):
            size = (self.last - self.first)[bare]
            self.end[bare] = len(self.content) + np.cumsum(size)
            self.begin[bare] = self.end[bare] - size
            self.content = np.concatenate([self.content, terms[stretches(self.first[bare], size)]])
        size, self.known, self.era = self.end - self.begin, words.size, words.era
        keys = np.sort(np.repeat(np.arange(n), size) * self.known + self.content[stretches(self.begin, size)])
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        self.span, self.term = np.divmod(keys[new], self.known)
        self.count = np.diff(new, append=len(keys)).astype(np.float64)
        self.squares, self.sizes = np.bincount(self.span, self.count**2, n), np.bincount(self.span, minlength=n).astype(np.float64)

    @cached_property
    def reach(self) -> np.ndarray:
        """``plain.reach`` of each span."""
        out = self.letters.copy()
        many = np.flatnonzero(self._to - self._from >= 4)
        if len(many):
            a, z, first, last = self._from[many], self._to[many], self.first[many], self.last[many]
            begins, ends = self._begins[self._at], self._ends[self._at]
            within = np.append(ends[3:] - begins[:-3], 0)
            inner = np.maximum.reduceat(within, np.column_stack([a, z - 3]).ravel())[::2]
            out[many] = np.maximum(inner, np.maximum(ends[a + 2] - self._begins[first], self._ends[last - 1] - begins[z - 3]))
        return out

    def runs(self, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the runs of three terms at each place, and where those of each span begin and how many they are.

        Terms that are not among the first ``known`` count as one, as the other side has none of them. A span of
        fewer than three terms has one run, of all of them.
        """
        begin, size = self.begin.copy(), self.end - self.begin
        content = np.where(self.content < known, self.content, OTHER)
        parts, at = [content], len(content)
        for i in np.flatnonzero(size < 3):
            parts.append(np.append(content[begin[i] : begin[i] + size[i]], np.full(3 - size[i], NONE)))
            begin[i], at = at, at + 3
        content, base = np.concatenate(parts), BASE
        if known > BASE:
            content, base = content.astype(object), 1 << 40  # integers of any length
        return (content[:-2] * base + content[1:-1]) * base + content[2:], begin, np.maximum(1, size - 2)

    def tokens(self, i: int) -> list[str]:
        return self.toks[self.first[i] : self.last[i]]

    def raw(self, i: int) -> str:
        k, _, start, end, *_ = self.places[i]
        return Y.collapse(self.texts[k][start:end])


def distinct_runs(begin: np.ndarray, size: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, span) of each distinct pair, sorted; ``run`` numbers the run at each place, -1 if it does not matter."""
    span, at = np.repeat(np.arange(len(begin)), size), run[stretches(begin, size)]
    keep = at >= 0
    keys = np.unique(at[keep] * max(1, len(begin)) + span[keep])
    return np.divmod(keys, max(1, len(begin)))


class Postings:
    """Rows sorted by a number: which spans have it, and how often."""

    def __init__(self, number: np.ndarray, span: np.ndarray, count: np.ndarray | None = None):
        order = np.argsort(number, kind="stable")
        number, self.span = number[order], span[order]
        self.count = np.ones(len(span)) if count is None else count[order]
        new = np.flatnonzero(np.diff(number, prepend=-1))
        self.numbers, self.begin, self.size = number[new], new, np.diff(new, append=len(number))

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Where each number stands among these, -1 for those that are not there."""
        return places(self.numbers, numbers)


def places(there: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where each number stands in a sorted array, -1 for those that do not."""
    if not len(there):
        return np.full(len(numbers), -1)
    at = np.minimum(np.searchsorted(there, numbers), len(there) - 1)
    return np.where(there[at] == numbers, at, -1)
