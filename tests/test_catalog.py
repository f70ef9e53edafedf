"""Named queries on tables made for a test, against brute force."""

import random
from collections import Counter
from math import sqrt

import pytest

import __spark_entry__ as entry
from loomspan.functions import plain as Y


def folder(spark, path, documents, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def grams_of(text):
    norm = " ".join(Y.tokens(text or ""))
    return Counter(norm[i : i + 4] for i in range(max(len(norm) - 3, 1))) if norm else Counter()


def test_char_cosine_takes_whole_texts(spark, tmp_path):
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = "zebra quartz vexing sphinx of black jumps over"
    lengths = [1, 3, 4, 5, *range(99, 107), 203, 204, 999, 1000, 1001, 1002, 1003, 1004, 1005, 2003, 2004, 3199, 3204]
    documents = [(0, letters(4000) + " " + passage), (1, None), (2, ""), *((10 + i, letters(n)) for i, n in enumerate(lengths))]
    benchmark = [(0, passage), (1, letters(5000)), (2, "abc"), (3, "a"), (4, "")]
    got = {(r.doc_id, r.item_id): r.cosine for r in entry.queries()["char_cosine"](spark, folder(spark, tmp_path, documents, benchmark)).collect()}
    norm = lambda c: sqrt(sum(n * n for n in c.values()))
    want = {}
    for d, text in documents:
        for i, item in benchmark:
            a, b = grams_of(text), grams_of(item)
            if dot := sum(n * b[g] for g, n in a.items()):
                want[d, i] = dot / (norm(a) * norm(b))
    assert (0, 0) in want and got == pytest.approx(want, abs=1e-6)


def test_verbatim_containment_of_few_tokens(spark, tmp_path):
    long = ["a" * 45, "b" * 30 + " " + "c" * 30, "d" * 20 + " e " + "f" * 20, "g" * 15 + " h i " + "j" * 25, "one two three four five six seven eight nine", "k" * 39]
    documents = [(i, f"Some words x{t}y and more") for i, t in enumerate(long)] + [(10, None), (11, " ".join(long[:4]))]
    got = {(r.doc_id, r.item_id) for r in entry.queries()["verbatim_containment"](spark, folder(spark, tmp_path, documents, list(enumerate(long)))).collect()}
    texts = [(d, " ".join(Y.tokens(t or ""))) for d, t in documents]
    assert got == {(d, i) for d, t in texts for i, b in enumerate(long) if len(b) >= 40 and b in t} and len(got) == 9


def test_concept_counts_of_stopwords_and_empty_texts(spark, tmp_path):
    documents = [(0, "The and of the"), (1, None), (2, ""), (3, "The methods and the models analyzing results"), (4, "Method, METHODS; approach."), (5, "..."), (6, "and a method")]
    benchmark = [(0, "the of and"), (1, "methods of analysis"), (2, None)]
    sf = folder(spark, tmp_path, documents, benchmark)
    counts = lambda rows: {k: Counter(Y.content(Y.tokens(t or ""))) for k, t in rows}
    docs, items = counts(documents), counts(benchmark)
    assert docs[0]["the"] == 2 and "and" not in docs[6]
    got = {r.concept: (r.n, r.docs) for r in entry.queries()["concept_freq"](spark, sf).collect()}
    assert got == {c: (sum(d[c] for d in docs.values()), sum(c in d for d in docs.values())) for c in set().union(*docs.values())}
    got = {(r.doc_id, r.item_id): r.jaccard for r in entry.queries()["concept_jaccard"](spark, sf).collect()}
    assert got == {(d, i): pytest.approx(len(a.keys() & b.keys()) / len(a.keys() | b.keys()), abs=1e-6) for d, a in docs.items() for i, b in items.items() if a.keys() & b.keys()}
