"""Features of all spans of a text together, against the functions that take them one by one."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomspan.functions import plain as Y
from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.operators import features, matching
from loomspan.operators import spans as P
from loomspan.plans import catalog, overlap

WORDS = [f"{a}{b}ing" for a in "bcdfgh" for b in "aeiou"] + ["the", "of", "and", "is", "methods", "results", "42", "don't"]


def texts(n=60):
    rnd = random.Random(5)
    some = lambda k, words=WORDS: " ".join(rnd.choices(words, k=k))
    made = ["", "..", "a b", "The of and the is of. Is the", "The of and the is of in", "\n\n \n", "İstanbul ΣΑΣ K one two three four five six. x"]
    for i in range(n):
        made.append(rnd.choice(["\n\n", "\n", ". ", "! \n"]).join(some(rnd.randint(0, 14), WORDS[30:34] if rnd.random() < 0.2 else WORDS) for _ in range(rnd.choice([1, 3, 8, 60]))))
    return made


def spans_of(text):
    return P.paragraphs_of(text, 6, None) or P.sentences_of(text, 3)


def test_features_equal_those_of_single_spans():
    words = features.Words()
    names = lambda: {n: t for t, n in words.terms.items()}
    for text in texts():
        own, want = features.Features([text], words), spans_of(text)
        assert [(i, s, e, own.raw(k), own.tokens(k)) for k, (_, i, s, e, *_) in enumerate(own.places)] == [(s[0], s[2], s[3], s[4], s[5]) for s in want]
        counts = [Counter() for _ in want]
        for span, term, n in zip(own.span, own.term, own.count, strict=True):
            counts[span][names()[term]] += int(n)
        assert counts == [Counter(Y.content(s[5])) for s in want]
        assert own.reach.tolist() == [Y.reach(s[5]) for s in want] and own.letters.tolist() == [len(" ".join(s[5])) for s in want]
        assert own.squares.tolist() == [sum(n * n for n in c.values()) for c in counts] and own.sizes.tolist() == [len(c) for c in counts]


@pytest.mark.parametrize(("cells", "base"), [(1 << 18, 1 << 21), (1, 1 << 21), (300, 4)])
def test_candidates_equal_brute_force(monkeypatch, cells, base):
    """F1: whatever meets at a time and however many terms there are; all that reach the score are among them."""
    monkeypatch.setattr(matching, "CELLS", cells)
    monkeypatch.setattr(features, "BASE", base)
    made = texts(24)
    refs = [(i, f"T{i % 5}", "", "s", t) for i, t in enumerate(made[::2])]
    block = matching.Block(refs)
    theirs = [(i, s, Y.content(s[5])) for i, *_, t in refs for s in spans_of(t)]
    assert block.size == len(theirs) and [block.span(j)[:2] for j in range(block.size)] == [(i, s[0]) for i, s, _ in theirs]
    seen = 0
    for text in made:
        own = features.Features([text], block.words)
        got = {(i, j): rank for i, j, rank in block.candidates(own, 0.3)}
        for i, s in enumerate(spans_of(text)):
            content, norm = Y.content(s[5]), " ".join(s[5])
            hits = [3 * len({*Y.shingles(content)} & {*Y.shingles(c)}) + len({*content} & {*c}) for *_, c in theirs]
            order = sorted(range(len(theirs)), key=lambda j: (-hits[j], j))
            for j, (_, r, c) in enumerate(theirs):
                if (i, j) in got:
                    assert got[i, j] == order.index(j) + 1 <= 48 and hits[j] >= 2
                elif hits[j] >= 2 and order.index(j) < 48:
                    assert S.pair_parts(S._span(norm, tuple(content)), S._span(" ".join(r[5]), tuple(c)), 1.0, 0.3) is None or S.pair_parts(S._span(norm, tuple(content)), S._span(" ".join(r[5]), tuple(c)), 1.0, 0.3)[0] < 0.3
        seen += len(got)
    assert seen > 100


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(features, "MOST_WORDS", 3)
    words = features.Words()
    block = matching.Block([(0, "t", "", "s", "one house two trees three rivers four hills")], words)
    known = dict(words)
    for text in ("several other words appear here today", "one house two trees three rivers four hills"):
        found = list(block.matches(text, 0.5))
    assert [m["rank"] for m in found] == [1] and {t: words[t] for t in known} == known
    matching.Block([], words)
    words["another"], words["more"]
    words.release()
    assert len(words) <= 5


def test_equal_strings_are_as_the_matcher_sees_them():
    rnd = random.Random(4)
    for norm in ("", "ab cd", "ab" * 150, "ab" * 150 + " z", "the cat " * 40, *("".join(rnd.choices("abcdefgh xyz"[: rnd.randint(1, 12)], k=rnd.randint(190, 400))) for _ in range(60))):
        assert SequenceMatcher(None, norm, norm).ratio() == 1.0
        span = S._span(norm, ("x",))
        assert S.pair_parts(span, span, 0.5, 0.0)[3] == 1.0
    assert S.matching_ranges("A" * 15, "A" * 15) == [] and S.matching_ranges("A" * 16, "A" * 16) == [(0, 16)]


def test_pairs_are_dealt_over_all_cores(spark):
    """adaptive execution put the pairs of a small table into one task."""
    assert catalog._pairs(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_cleaning_looks_only_for_what_may_be_there(spark):
    """the letters' words are counted once and texts without dashes, line ends or outer blanks are left alone."""
    spaced, plain = " ".join("abcdefghij" * 4), " ".join(["word"] * 40 + list("abcdefghij") * 2)
    rows = [("x-\ny-\nz", "xy-\nz"), ("a–\r\nb", "ab"), ("ﬁn’", "fin'"), ("12\n　 7 \nend-", "\n\nend-"), (spaced, spaced.replace(" ", "")), (plain, plain), (" 　a b\x1c", " 　a b\x1c"), (None, ""), ("", "")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string").select("i", T.cleaned(F.col("t")).alias("c"), T.strip(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.c for r in got] == [b for _, b in rows] and got[6].s == "a b" and got[7].s == ""


def test_texts_meet_the_next_as_pairs_do(spark):
    """the same rows as of joined pairs, whatever the keys: gaps, doubles, nulls, below zero."""
    made = texts(12)
    keys = [-18, -17, -16, -15, -1, 0, 1, 2, 2, 3, 3, 7, 15, 16, 17, 18, 31, 32, 33, None]
    said = lambda k: made[(k or 0) % 5 + 8] + f"\n\n{made[9]} {k}" + "  \n" * (k == 16)
    docs = spark.createDataFrame([(k, None if k == 7 else said(k)) for k in keys], "doc_id long, text string")
    pairs = docs.select(F.col("doc_id").alias("pair_id"), "text").join(docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("reference_text")), "pair_id")
    told = lambda found: sorted(map(str, found.collect()))
    want = told(matching.found_in_rows(pairs, "pair_id", "reference_text", "text", overlap.LOCAL, 0.4))
    assert told(matching.found_with_next(docs, "doc_id", "text", overlap.LOCAL, 0.4)) == want and len(want) > 30
