"""Common blocks against the standard library's matcher, bounds and containment against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomspan.functions import blocks as B
from loomspan.functions import plain as Y
from loomspan.functions import similarity as S
from loomspan.operators import containment, index
from loomspan.operators import spans as P


def strings():
    rnd = random.Random(1)
    yield from [("", ""), ("a", ""), ("", "a"), ("abc", "abc"), ("ab" * 40, "ba" * 50), ("a" * 200, "a" * 90 + "b" + "a" * 30)]
    for _ in range(1500):
        letters = rnd.choice(["ab", "abc", "abcdefgh ", "etaoin shrdluüß"])
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(2))
        yield a, (a[rnd.randint(0, len(a)) :] + b if rnd.random() < 0.4 else b)


def test_blocks_equal_the_library():
    for a, b in strings():
        want = SequenceMatcher(None, a, b, autojunk=False)
        blocks = [tuple(x) for x in want.get_matching_blocks()[:-1]]
        assert B.ratio(a, b) == want.ratio()
        assert B.longest(a, b) == max((n for *_, n in blocks), default=0)
        for least in (1, 3, 16):
            assert list(B.matching_blocks(a, b, least)) == [x for x in blocks if x[2] >= least]


def test_bounds_are_never_below_the_score(spark):
    rnd = random.Random(2)
    words = ["method", "the", "of", "result", "alpha", "beta", "gamma", "delta", "and", "x", "running", "learned"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    left = [text(rnd.randint(3, 30)) for _ in range(40)] + ["the of and the of", "the of and"]
    right = [rnd.choice(left)[4:] + " " + text(4) if rnd.random() < 0.5 else text(rnd.randint(3, 30)) for _ in range(40)] + ["and the of and the", "the of and"]
    frame = lambda rows: P.sentences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), min_words=1, featured=True).cache()
    ours, theirs = frame(left), frame(right).withColumnsRenamed({"doc_id": "ref_id", "span_id": "ref_span"})
    both = index.candidates(ours, theirs, most=10**6).join(index.sizes(ours, ["doc_id", "span_id"], "l"), ["doc_id", "span_id"]).join(index.sizes(theirs, ["ref_id", "ref_span"], "r"), ["ref_id", "ref_span"])
    found = both.withColumn("bound", index.bound(F.col("l"), F.col("r"))).collect()
    assert len(found) > 500
    for r in found:
        a, b = Y.tokens(left[r.doc_id]), Y.tokens(right[r.ref_id])
        x, y = Y.content(a), Y.content(b)
        assert (r.shared, r.runs) == (len(set(x) & set(y)), len(set(Y.shingles(x)) & set(Y.shingles(y))))
        assert r.dot == sum(n * Counter(y)[k] for k, n in Counter(x).items()) and r.hits == r.shared + 3 * r.runs
        score = S.pair_parts(S._Span(" ".join(a), tuple(x)), S._Span(" ".join(b), tuple(y)), 1.0, 0.0)[0]
        assert score <= r.bound + 1e-6
        if r.runs == 0:
            assert B.longest(" ".join(a), " ".join(b)) <= min(Y.reach(a), Y.reach(b))


def test_contained_rows(spark):
    rnd = random.Random(3)
    text = {k: "".join(rnd.choice("abc ") for _ in range(400)) for k in ("a", "b")}
    rows = [(i, k, text[o][s : s + n]) for i, (k, o, s, n) in enumerate((rnd.choice("ab"), rnd.choice("ab"), rnd.randrange(390), rnd.randint(1, 12)) for _ in range(300))]
    rows += [(1000, None, "ab"), (1001, "c", "ab"), (1002, "a", ""), (1003, "a", None), *[(2000 + i, "a", text["a"][i : i + 9]) for i in range(60)]]
    made = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, k string, p string, _key int, _side int")
    texts = spark.createDataFrame([(k, t) for k, t in text.items()] + [(None, "xaby")], "k string, t string")
    got = sorted(r.id for r in containment.contained(made, texts, ["k"], "p", "t").collect())
    assert got == sorted(i for i, k, p in rows if p and p in ({**text, None: "xaby"}.get(k, "")))
    assert containment.contained(made.where("false"), texts, ["k"], "p", "t").count() == 0


@pytest.mark.parametrize("size", [3, 40])
def test_many_patterns_make_an_automaton(size):
    patterns = {f"w{i}x" for i in range(size)}
    assert containment.found_in(patterns, "aw1xw2x w39") == {"w1x", "w2x"}


@pytest.mark.parametrize("floor", [0.05, 0.3, 0.7, 0.95])
def test_cosines_from_a_floor_on(spark, floor):
    rnd = random.Random(4)
    side = lambda n, of: [(k, t, rnd.randint(1, 4)) for k in range(n) for t in rnd.sample(range(of), rnd.randint(1, 12))]
    left = side(60, 30)
    right = side(50, 35) + [(100 + k, t, n) for k, t, n in left if k < 20 and rnd.random() < 0.9] + [(200, 99, 1)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, term long, n long")
    whole = {(r.a, r.b): r.cosine for r in S.cosine_of_rows(frame(left, "a"), frame(right, "b"), "a", "b", "term", "n").collect()}
    got = {(r.a, r.b): r.cosine for r in S.cosine_of_rows(frame(left, "a"), frame(right, "b"), "a", "b", "term", "n", floor).collect()}
    assert got == {k: pytest.approx(x) for k, x in whole.items() if x >= floor} and 0 < len(got) < len(whole)
