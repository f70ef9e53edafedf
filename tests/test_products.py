"""Inner products of texts by blocks against brute force, and where their floor lies."""

import random
from math import sqrt

import pytest

import __spark_entry__ as entry
from loomspan.operators import products as X


def test_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 7)
    monkeypatch.setattr(X, "BATCH", 20)
    rnd = random.Random(5)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    text = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 9)))
    left, right = [(i, text()) for i in range(60)] + [(60, None), (None, "wax")], [(str(i), text()) for i in range(31)]
    made = lambda counted, floor=0.0: {(r.a, r.b): (r.dot, r.left_square, r.right_square) for r in X.of_texts(spark.createDataFrame(left, "a long, text string"), spark.createDataFrame(right, "b string, text string"), "a", "b", counted, floor).collect()}
    for counted in (X.concept_counts, X.concept_set, X.gram_counts):
        want = {}
        for a, x in left[:-1]:
            for b, y in right:
                u, v = counted(x), counted(y)
                if dot := sum(n * v.get(t, 0) for t, n in u.items()):
                    want[a, b] = (dot, sum(n * n for n in u.values()), sum(n * n for n in v.values()))
        assert made(counted) == want
        assert made(counted, 0.605) == {k: v for k, v in want.items() if v[0] / sqrt(v[1] * v[2]) >= 0.605}


def test_rows_of_one_key_count_as_one(spark):
    frame = spark.createDataFrame([(1, "alpha beta"), (1, "alpha")], "a long, text string")
    assert [tuple(r) for r in X.of_texts(frame, spark.createDataFrame([(7, "alpha")], "b long, text string"), "a", "b", X.concept_counts).collect()] == [(1, 7, 2.0, 5.0, 1.0)]
    assert sorted(tuple(r) for r in X.terms(frame, "a").collect()) == [(1, "alpha", 2), (1, "beta", 1)]


def test_floor_is_of_the_rounded_cosine(spark, tmp_path):
    # 780 of one term and 1351 of another against the first alone: 0.4999999 is shown as 0.5, and SQL asks what is shown
    spark.createDataFrame([(0, "alpha " * 780 + "omega " * 1351), (1, "alpha " * 10 + "omega " * 18)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha"), (1, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = 780 / sqrt(780**2 + 1351**2)
    got = [tuple(r) for r in entry.queries()["token_cosine_above"](spark, str(tmp_path)).collect()]
    assert exact < 0.5 and [x[:3] for x in got] == [(0, 0, 0.5)]


def test_only_texts_with_references_are_profiled(spark, monkeypatch):
    from loomspan.operators import references as R

    seen, whole = [], R.profiles
    monkeypatch.setattr(R, "profiles", lambda docs, key, text: (seen.append(sorted(r[0] for r in docs.select(key).collect())), whole(docs, key, text))[1])
    docs = spark.createDataFrame([(i, f"a text of some words number {i} that nobody else has") for i in range(4)], "doc_id long, text string")
    refs = spark.createDataFrame([(2, 9, "text", "a text of some words number 2")], "doc_id long, ref_id long, title string, text string")
    assert [(r.doc_id, r.ref_id, r.position) for r in R.rerank(docs, refs).collect()] == [(2, 9, 1)] and seen == [[2]]


def test_candidates_by_blocks_equal_the_index(spark, monkeypatch):
    from loomspan.operators import index
    from loomspan.operators import spans as P

    monkeypatch.setattr(X, "BLOCK", 3)
    rnd = random.Random(8)
    words = [f"w{chr(97 + i)}x" for i in range(12)]
    text = lambda: " ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 7))) + "." for _ in range(rnd.randint(0, 4)))
    docs = spark.createDataFrame([(i, text()) for i in range(20)] + [(20, None)], "doc_id long, text string")
    refs = spark.createDataFrame([(i, text()) for i in range(13)], "ref_id long, text string")
    columns = ["doc_id", "span_id", "ref_id", "ref_span", "hits", "rank"]
    theirs = P.sentences(refs, "ref_id", featured=True).withColumnRenamed("doc_id", "ref_id").withColumnRenamed("span_id", "ref_span")
    want = index.candidates(P.sentences(docs, featured=True), theirs, most=5).select(columns)
    got = X.candidates(docs, refs, lambda t: P.sentences_of(t, 3), "doc_id", "ref_id", most=5).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_keywords_move_nothing(spark):
    from loomspan.operators import search

    docs = spark.createDataFrame([(0, "beta alpha gamma beta 12345 gamma delta the"), (1, None), (2, "a b c")], "doc_id long, text string")
    out = search.keywords(docs, top=2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(0, "beta alpha"), (1, ""), (2, "")]


def test_source_prior_equals_the_check_and_joins_no_terms(spark, tmp_path):
    from loomspan.operators import spans as P
    from loomspan.plans import catalog, overlap

    rnd = random.Random(2)
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    text = lambda n: " ".join(" ".join(rnd.choices(words, k=8)) + "." for _ in range(n))
    spark.createDataFrame([(i, text(i)) for i in range(9)] + [(9, None), (10, "\n\n".join(text(1) for _ in range(270)) + "\n\nonly here stands qqq zzz yyy vvv")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, text(1)), (1, "qqq zzz yyy vvv uuu ttt"), (2, None), (3, "wax")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, refs = spark.read.parquet(f"{tmp_path}/documents.parquet"), catalog._refs(spark, str(tmp_path))
    items = P.spans(refs, "ref_id", featured=True).withColumnRenamed("doc_id", "ref_id").join(refs.drop("text"), "ref_id").selectExpr("*", "CAST(NULL AS long) AS group_id")
    want = {(r.doc_id, r.title): round(r.prior, 6) for r in overlap.source_priors(P.spans(docs, featured=True), items, False).collect()}
    out = entry.queries()["source_prior"](spark, str(tmp_path))
    assert {(r.doc_id, r.title): r.prior for r in out.collect()} == pytest.approx(want, abs=1e-6) and (10, "Item 0") in want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
