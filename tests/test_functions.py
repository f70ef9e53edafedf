"""Column functions against their plain versions and hand-made constants."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import html as H
from loomspan.functions import plain as Y
from loomspan.functions import rewrite as W
from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.operators import intervals


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


TEXTS = ["", None, "The analyses of models, methods and results", "été d'hiver 12", "after after", "ands outs fores", "A b c\n\n d", "x" * 9, "ti ti ti ti"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_and_content(spark, text):
    plain = text or ""
    assert one(spark, text, T.tokens) == Y.tokens(plain)
    assert one(spark, Y.tokens(plain), T.content_tokens, "array<string>") == Y.content(Y.tokens(plain))
    assert one(spark, Y.content(Y.tokens(plain)), T.shingles, "array<string>") == Y.shingles(Y.content(Y.tokens(plain)))
    assert one(spark, text, T.collapse) == Y.collapse(plain)


def test_stems(spark):
    pairs = {"this": "thi", "analysis": "analysi", "running": "runn", "abilities": "abil", "nationalization": "national", "es": "es", "used": "used", "cities": "cities", "ingly": "ing"}
    for token in pairs:
        assert one(spark, token, T.stem) == Y.stem(token)
    assert Y.stem("this") == "thi" and Y.stem("analysis") == "analysi"


def test_extracted_text(spark):
    assert one(spark, "eﬃ-\n  cient ‘x’ — y\r\n\n 12 \nz", T.normalize_extracted) == "efficient 'x' - y\n\nz"
    spaced = " ".join("abcdefghij" * 5)
    assert one(spark, spaced, T.repair_spaced) == spaced.replace(" ", "")
    assert one(spark, "a b c", T.repair_spaced) == "a b c"


def test_char_grams_and_samples(spark):
    assert one(spark, "abcdef", T.char_grams) == ["abcd", "bcde", "cdef"] and one(spark, "ab", T.char_grams) == ["ab"] and one(spark, "", T.char_grams) == []
    long = " ".join(str(i) for i in range(2000))
    got = one(spark, long, lambda c: T.distributed_sample(c, 3000))
    assert len(got) <= 3000 and got.startswith("0 1 2")
    assert one(spark, "short", lambda c: T.distributed_sample(c, 3000)) == "short"


@pytest.mark.parametrize(("text", "noise"), [("", True), ("All Rights Reserved by us", True), ("THE BIG BAD WOLF CAME", True), ("12 34 apples 56", True), ("a quiet paragraph of plain running words without anything odd in it", False), (None, True)])
def test_noise(spark, text, noise):
    assert one(spark, text, T.is_noise) is noise


def test_presentation(spark):
    assert one(spark, 0.925, T.match_label, "double") == "Exact Match" and one(spark, 0.5, T.match_label, "double") == "Paraphrased Overlap"
    assert one(spark, 0.25, T.half_even, "double") == 0.2
    assert one(spark, "a" * 171, T.preview) == "a" * 167 + "..."
    assert one(spark, "http://h/a%20b+c.PDF?x", T.file_name) == "a b+c.PDF" and one(spark, "http://h/", T.file_name) == "PDF Source"
    assert one(spark, "http://h/a.PDF?x", T.is_pdf) and not one(spark, "nope", T.is_pdf)
    assert [one(spark, x, T.reference_mode) for x in ("https://a", "some topic", " ", None)] == ["url", "topic", "web", "web"]
    assert one(spark, 9, lambda c: T.sample_indexes(c, F.lit(4)), "int") == [0, 3, 5, 8]
    assert one(spark, {"b": [1], "a": [0, 2]}, T.inverted_abstract, "map<string,array<int>>") == "a b a"
    assert [one(spark, x, W.appraisal, "double")[:3] for x in (0.0, 30.0, 50.0, 51.0)] == ["Gre", "Low", "Mod", "Hig"]


def test_rewrite(spark):
    assert one(spark, "In order to win, utilize it.  Therefore go!", lambda c: W.tone_rewrite(c, "Formal")) == "From a formal perspective, to win, use it. as a result go!"
    assert one(spark, "x", lambda c: W.tone_rewrite(c, "odd")) == "In clearer terms, x" and one(spark, " ", lambda c: W.tone_rewrite(c, "formal")) == ""
    assert one(spark, '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}', W.chat_text) == "a\nb"
    assert one(spark, '{"choices":[{"message":{"content":" hi "}}]}', W.chat_text) == "hi" and one(spark, "{}", W.chat_text) == ""


def test_html(spark):
    body = "word " * 80
    page = f"<html><title>A &amp; B</title><nav>menu</nav><div class='x'>side</div><article><h1>T</h1><p>{body}&eacute;</p></article><script>var a='<p>';</script></html>"
    got = H.main_text(spark.createDataFrame([(page,), (None,), ("<p>tiny</p>",)], "html string"), "html").collect()
    assert [r.main_text for r in got] == [f"T {body}é", "", "tiny"]
    assert one(spark, page, H.title) == "A & B"
    data = '<script>{"articleBody": "' + "x\\u00e9 " * 200 + '"}</script><p>short</p>'
    assert H.main_text(spark.createDataFrame([(data,)], "html string"), "html").first().main_text.startswith("xé xé")


def test_ranges(spark):
    rows = spark.createDataFrame([(1, 5, 9), (1, 0, 3), (1, 3, 4), (1, 8, 12), (1, 2, 2), (2, 1, 2)], "k int, start int, end int")
    assert sorted(tuple(r) for r in intervals.union_rows(rows, ["k"]).collect()) == [(1, 0, 4), (1, 5, 12), (2, 1, 2)]
    assert {r.k: r.covered for r in intervals.covered(rows, ["k"]).collect()} == {1: 11, 2: 1}
    got = one(spark, [(5, 9), (0, 3), (3, 4), (8, 40), (-3, -1)], lambda c: intervals.merge_ranges(c, F.lit(12)), "array<struct<s:int,e:int>>")
    assert [tuple(r) for r in got] == [(0, 4), (5, 12)]


def test_bound_never_drops_a_pair_above_the_floor():
    rnd = random.Random(3)
    words = ["model", "result", "data", "the", "of", "a", "learning", "student", "quick", "brown"]
    for _ in range(300):
        a = [rnd.choice(words) for _ in range(rnd.randint(1, 40))]
        b = a[: rnd.randint(0, len(a))] + [rnd.choice(words) for _ in range(rnd.randint(1, 30))]
        left, right = (S._Span(" ".join(x), tuple(Y.content(x))) for x in (a, b))
        prior, floor = rnd.random(), rnd.choice([0.3, 0.48, 0.6, 0.9])
        whole, cut = S.pair_parts(left, right, prior, 0.0), S.pair_parts(left, right, prior, floor)
        assert (cut == whole) if whole[0] >= floor else (cut is None or cut[0] < floor)


def test_cosine_of_rows(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "y", 4), (2, "z", 1)], "l int, t string, n int")
    b = spark.createDataFrame([(7, "x", 1), (8, "q", 2)], "r int, t string, n int")
    assert [tuple(r) for r in S.cosine_of_rows(a, b, "l", "r", "t", "n").collect()] == [(1, 7, pytest.approx(0.6))]
