"""Chunks compared within the row against the tables of chunks."""

import random

import pytest

from loomspan.operators import chunks as C


def test_rows_equal_tables(spark):
    rnd = random.Random(11)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)] + ["an", "1234567"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    sizes = [(0, 300), (1, 1), (259, 261), (900, 1600), (6000, 9000), (9000, 450)]
    rows = [(i, text(a), text(b)) for i, (a, b) in enumerate(sizes)] + [(9, None, text(500)), (10, text(700), None)]
    frame = spark.createDataFrame(rows, "pair_id long, text string, reference_text string")
    a, b = C.word_chunks(frame, "pair_id", "text"), C.word_chunks(frame, "pair_id", "reference_text")
    pairs = C.chunk_pairs(a, b)
    want = {tuple(r) for r in pairs.collect()}
    out = C.text_pairs(frame)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 20
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    left = {r.pair_id: (r.text, r.used) for r in C.joined(a, C.selected(a, pairs, "research_chunk")).collect()}
    right = {r.pair_id: (r.text, r.used) for r in C.joined(b, C.selected(b, pairs, "reference_chunk")).collect()}
    got = {r.pair_id: r for r in C.reduce_pairs(frame, long=800).collect()}
    assert {i for i, r in got.items() if r.used_chunking} == {3, 4, 5}
    for i, t, r in rows:
        if got[i].used_chunking:
            assert (got[i].text, got[i].research_used, got[i].reference_text, got[i].reference_used) == (*left[i], *right[i])
        else:
            assert (got[i].text, got[i].reference_text, got[i].research_chunks) == (t, r, 0)


@pytest.mark.parametrize("n", [0, 1, 260, 261, 450, 451, 40_000])
def test_chunk_places(n):
    cut = C.chunks_of(["x"] * n)
    assert len(cut) <= C.MOST and all(a == i * C.STRIDE for i, (a, _) in enumerate(cut)) and (n == 0 or n > 34_000 or cut[-1][1] == n)
