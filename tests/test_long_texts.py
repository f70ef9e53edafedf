"""Texts beyond the lengths at which queries once stopped reading."""

import duckdb

import __spark_entry__ as entry
from loomspan.functions import plain as Y
from loomspan.operators import matching
from loomspan.plans import overlap


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def both(spark, path, name):
    """The rows of a query and of its SQL, in one order of columns."""
    found = entry.queries()[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    said = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect())), sorted(said)


def spelled(n, first):
    """n different words of letters."""
    return [first + "".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(n)]


def far_passage(n=40_000):
    """Two texts of n and some words that have nothing but their last 500 words in common."""
    end = spelled(500, "common")
    return " ".join(spelled(n, "left") + end), " ".join(spelled(n, "right") + end)


def test_chunk_pairs_read_whole_texts(spark, tmp_path):
    """chunks from the 181st on are compared, too."""
    got, said = both(spark, documents(spark, tmp_path, far_passage()), "chunk_pairs")
    assert got == said and len(got) >= 2 and min(r[1] for r in got) > 200 and min(r[2] for r in got) > 200


def test_long_doc_reduce_reads_whole_texts(spark, tmp_path):
    """alike chunks beyond the 180th are kept."""
    got, said = both(spark, documents(spark, tmp_path, far_passage()), "long_doc_reduce")
    assert got == said
    row = dict(zip(entry.queries()["long_doc_reduce"](spark, str(tmp_path)).columns, got[0], strict=True))
    assert row["research_chunks"] == row["reference_chunks"] == 213 and row["text"].endswith(spelled(500, "common")[-1])


PASSAGE = ["Rivers carry winter sediments towards northern valleys", "farmers measure every flood before planting barley there", "reservoirs collapse where engineers forget spring thaws", "older villages keep wooden boats under their granaries"]


def one_paragraph(first, n=1000):
    """A paragraph of n sentences, and the passage after them."""
    words = spelled(5 * n, first)
    return ". ".join([*(" ".join(words[5 * i : 5 * i + 5]) for i in range(n)), *PASSAGE]) + "."


def with_benchmark(spark, path):
    """A folder whose one document has the one item at its end."""
    spark.createDataFrame([(0, ". ".join(PASSAGE) + ".")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return documents(spark, path, [one_paragraph("left")])


def test_overlap_reads_whole_paragraphs(spark, tmp_path):
    """windows from the 181st of a paragraph on are met, and all spans say which concepts a text has."""
    sf = with_benchmark(spark, tmp_path)
    row = entry.queries()["doc_overlap_pct"](spark, sf).first()
    text = one_paragraph("left")
    assert row["mode"] == "external" and row.n_matches == 1 and row.plag_pct == round(100 * (text.count(". ".join(PASSAGE)) * len(". ".join(PASSAGE) + ".")) / len(text), 1)
    match = entry.queries()["hybrid_matches"](spark, sf).first()
    own, theirs = (set(Y.content(Y.tokens(t))) for t in (text, " ".join(PASSAGE)))
    assert match.score == 97.0 and match.source_relevance == round(100 * len(own & theirs) / len(own | theirs), 1)


def test_file_compare_reads_whole_paragraphs(spark, tmp_path):
    """of two paragraphs of a thousand sentences, what both have at their ends is met."""
    sf = documents(spark, tmp_path, [one_paragraph("left"), one_paragraph("right")])
    row = entry.queries()["file_compare"](spark, sf).first()
    size = len(". ".join(PASSAGE) + ".")
    assert row.n_matches == 1 and row.plag_pct == round(100 * size / len(one_paragraph("left")), 1)


def test_a_source_is_searched_to_its_end(spark, monkeypatch):
    """a span that stands beyond the first 300,000 letters of its source stands in it; within a task and joined."""
    said = "Rivers carry winter sediments, towards northern valleys; farmers measure every flood before planting."
    refs = spark.createDataFrame([(0, ". ".join(" ".join(w) for w in zip(*[iter(spelled(60_000, "left"))] * 6, strict=True)) + ".\n\n" + said.replace(" ", ", ") + " Their children count boats and nets along muddy shores every autumn.")], "ref_id long, text string")
    for rows in (matching.ROWS, -1):
        monkeypatch.setattr(matching, "ROWS", rows)
        matches = overlap.check(spark.createDataFrame([(1, said)], "doc_id long, text string"), refs)[0].collect()
        assert [(r.score, r.coverage_ratio) for r in matches] == [(97.0, 100.0)]
        monkeypatch.undo()


def test_match_labels_read_whole_paragraphs(spark, tmp_path):
    """a match beyond the 180th window has its label."""
    assert [tuple(r) for r in entry.queries()["match_labels"](spark, with_benchmark(spark, tmp_path)).collect()] == [(0, "Exact Match", 1, 97.0)]
