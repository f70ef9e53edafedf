"""Spans, chunks, references, search, sources and the analysis itself."""

import io
import json
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.functions import plain as Y
from loomspan.operators import chunks, references, search
from loomspan.operators import spans as P
from loomspan.plans import oracle, overlap, retrieval
from loomspan.sources import files, providers
from loomspan.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["normalize_text", "query_keywords", "sentence_spans", "paragraph_windows", "shingle_candidates", "token_cosine", "interval_coverage", "reference_dedup", "blend_sources", "chunk_pairs", "tone_rewrite", "url_kind", "source_prior", "lexical_score", "paragraph_of_sentence", "char_cosine", "verbatim_containment", "concept_freq", "concept_jaccard", "suggestions", "document_shingles", "page_reference_dedup", "topic_sources", "token_cosine_above", "char_cosine_above", "long_doc_reduce", "search_queries"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle.ORACLE_SQL[name])
    got = entry.queries()[name](spark, SF).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.fetchall())))


def test_sentences_have_exact_places():
    text = "One two three. A!? four five six\nseven eight nine ten"
    assert [(s[0], text[s[2] : s[3]]) for s in P.sentences_of(text, 3)] == [(0, "One two three."), (2, " four five six"), (3, "seven eight nine ten")]


def test_paragraphs_and_windows():
    text = "\n\na b c d e f\ng\n\n\nshort one\n \n" + "Word one two three four five six seven. " * 40
    got = P.paragraphs_of(text, 6)
    assert [text[s[2] : s[3]] for s in got[:1]] == ["a b c d e f\ng"]
    windows = got[1:]
    assert {s[1] for s in windows} == {"window"} and windows[-1][4].endswith("seven.") and len(windows) == 19
    assert all(Y.collapse(text[s[2] : s[3]]) == s[4] for s in got)
    assert [s[0] for s in got] == list(range(len(got)))


def test_spans_fall_back_to_sentences(spark):
    df = spark.createDataFrame([(1, "only four words here"), (2, None), (3, "a b c d e f g")], "doc_id long, text string")
    got = {(r.doc_id, r.kind) for r in P.spans(df, featured=True).collect()}
    assert got == {(1, "sentence"), (3, "paragraph")}


TEXT = "The committee reviewed several proposals about regional water storage and agreed that new reservoirs should be built along the northern valley before winter arrives."
OTHER = "Completely unrelated remarks concerning violins, oboes, clarinets, trumpets and seasoned percussionists performing midnight serenades across distant islands together."


def test_check(spark):
    targets = spark.createDataFrame([(1, TEXT), (2, OTHER), (3, ""), (4, None), (5, TEXT + "\n\n" + OTHER)], "doc_id long, text string")
    refs = spark.createDataFrame([(1, "T", "u", TEXT, "S"), (2, "Z", "", "short", "S")], "ref_id long, title string, url string, text string, source string")
    matches, results = overlap.check(targets, refs)
    by = {r.doc_id: r for r in results.collect()}
    assert by[1].plag_pct == 100.0 and by[1].mode == "external" and by[1].n_matches == 1
    assert by[2].plag_pct == 0.0 and by[2].orig_pct == 100.0
    assert [by[i].mode for i in (3, 4)] == ["empty", "empty"]
    assert by[5].plag_pct == pytest.approx(100 * len(TEXT) / (len(TEXT) + 2 + len(OTHER)), abs=0.1)
    rows = {r.doc_id: r for r in matches.collect()}
    assert set(rows) == {1, 5} and rows[1].match_type == "Exact Match" and rows[1].source_title == "T (S)" and rows[1].coverage_ratio == 100.0
    spark.catalog.clearCache()


def test_offline(spark):
    text = "One two three four. Something else entirely here. One two three four."
    targets = spark.createDataFrame([(1, text)], "doc_id long, text string")
    refs = spark.createDataFrame([(1, "")], "ref_id long, text string")
    r = overlap.check(targets, refs)[1].first()
    assert r["mode"] == "offline" and r["n_matches"] == 2 and 0 < r["plag_pct"] < 100
    rep = overlap.repetitions(targets).collect()
    assert {x.score for x in rep} == {78.0} and len(rep) == 2
    spark.catalog.clearCache()


def test_compare_keeps_pairs_apart(spark):
    pairs = spark.createDataFrame([(1, TEXT, TEXT), (2, OTHER, TEXT), (3, TEXT, "")], "pair_id long, reference_text string, text string")
    got = {r.pair_id: (r.plag_pct, r["mode"]) for r in overlap.compare(pairs).collect()}
    assert got == {1: (100.0, "external"), 2: (0.0, "external"), 3: (0.0, "empty")}
    spark.catalog.clearCache()


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(700))), (2, "few words"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk, r.start, r.end) for r in chunks.word_chunks(df).collect())
    assert got == [(1, 0, 0, 260), (1, 1, 190, 450), (1, 2, 380, 640), (1, 3, 570, 700), (2, 0, 0, 2)]
    long = " ".join(f"term{i}" for i in range(6000))
    pairs = spark.createDataFrame([(1, long, long), (2, "a b", "c d")], "pair_id long, reference_text string, text string")
    rows = {r.pair_id: r for r in chunks.reduce_pairs(pairs).collect()}
    assert rows[1].used_chunking and rows[1].research_used == 14 and rows[1].research_words == 6000 and rows[1].research_words_used <= 14 * 260
    assert not rows[2].used_chunking and rows[2].text == "c d"


def test_references(spark):
    refs = spark.createDataFrame([(1, "A", "http://X ", "t1", "Crossref"), (2, "B", "http://x", "t2", "Crossref"), (3, "C", "", "Same text", "Wikipedia"), (4, "c", None, "same   TEXT", "Wikipedia"), (5, "D", "u5", "x", "Wikipedia")], "ref_id long, title string, url string, text string, source string")
    assert sorted(r.ref_id for r in references.deduplicate(refs).collect()) == [1, 3, 5]
    blended = [(r.ref_id, r.position) for r in references.blend(refs, providers.WEB_SOURCES, 4).orderBy("position").collect()]
    assert blended == [(1, 1), (3, 2), (4, 3), (5, 4)]
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    own = spark.createDataFrame([(1, 1, "Violins", OTHER), (1, 2, "Water", TEXT)], "doc_id long, ref_id long, title string, text string")
    got = {r.ref_id: r for r in references.rerank(docs, own).collect()}
    assert got[2].position == 1 and got[2].score > 80 > got[1].score
    pages = spark.createDataFrame([("u5", "Page D", "x " + "long page text " * 30)], "url string, page_title string, page_text string")
    expanded = {r.ref_id: r for r in references.expand(refs, pages, providers.WEB_SOURCES).collect()}
    assert expanded[5].title == "Page D" and expanded[5].text.startswith("x long") and expanded[1].text == "t1"


def test_search(spark):
    docs = spark.createDataFrame([(1, TEXT + "\n\n" + OTHER), (2, "tiny text only"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.position): r.query for r in search.search_queries(docs).collect()}
    assert got[1, 1] == '"' + " ".join(Y.tokens(TEXT)[:18]) + '"' and got[2, 1] == "tiny text" and (3, 1) not in got
    assert {r.doc_id: r.keywords for r in search.keywords(docs).collect()}[2] == "tiny text only".replace(" only", "")


def payload(spark, value, query="q"):
    return spark.createDataFrame([(query, value if isinstance(value, str) else json.dumps(value))], "query string, payload string")


def test_providers(spark):
    row = lambda df: [(r.title, r.url, r.text) for r in df.orderBy("rank").collect()]
    page = "<a class='result-link' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa&amp;r=1'>T <b>1</b></a><td class='result-snippet'>" + "s" * 40 + "</td><a class='result-link' href='http://y'>U</a><td class='result-snippet'>no</td>"
    assert row(providers.duckduckgo(payload(spark, page))) == [("T 1", "https://x.org/a", "s" * 40)]
    assert row(providers.crossref(payload(spark, {"message": {"items": [{"title": ["A"], "abstract": "<p>x &amp; y</p>", "DOI": "10/1"}, {"abstract": ""}, {"abstract": "z", "URL": "u"}]}}))) == [("A", "https://doi.org/10/1", "x & y"), ("Untitled", "u", "z")]
    assert row(providers.openalex(payload(spark, {"results": [{"display_name": "A", "id": "i", "abstract_inverted_index": {"b": [1], "a": [0]}}, {"display_name": "B"}]}))) == [("A", "i", "a b")]
    assert row(providers.semantic_scholar(payload(spark, {"data": [{"title": "A", "abstract": "w " * 60, "externalIds": {"DOI": "d"}}, {"abstract": "short"}]}))) == [("A", "https://doi.org/d", ("w " * 60).strip())]
    assert row(providers.serpapi(payload(spark, {"organic_results": [{"title": "", "link": "l", "snippet": "t" * 50}, {"link": "", "snippet": "t" * 50}]}))) == [("Untitled", "l", "t" * 50)]
    assert row(providers.grokipedia(payload(spark, {"items": [{"title": "A", "link": "l", "summary": "t" * 50}]}))) == [("A", "l", "t" * 50)]
    assert row(providers.grokipedia(payload(spark, '<a href="/p">Title long</a><p>' + "u" * 70 + "</p>"))) == [("Title long", "https://grokipedia.com/p", "u" * 70)]
    extracts = spark.createDataFrame([("T", json.dumps({"query": {"pages": {"1": {"extract": "e" * 120}}}}))], "title string, payload string")
    assert row(providers.wikipedia(payload(spark, ["q", ["T", "U"], ["", ""], ["http://t", "http://u"]]), extracts)) == [("T", "http://t", "e" * 120)]
    assert row(providers.crossref(payload(spark, "no json"))) == []
    papers = {"a": providers.crossref(payload(spark, {"message": {"items": [{"title": ["A"], "abstract": "x"}]}}))}
    assert retrieval.topic_references(papers).count() == 1


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  caf\xc3\xa9 \xff ok ")
    (tmp_path / "b.docx").write_bytes(docx(["One", "Two"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.TXT").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"p")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, str(tmp_path), pdf=lambda b: ["page one", "page two"]).collect()}
    assert got == {"a.txt": "café  ok", "b.docx": "One\nTwo", "c.docx": "", "d.TXT": "", "e.pdf": "page one\npage two"}


def test_pdf_pages(spark):
    boxes = spark.createDataFrame([(1, 0, 5.0, 10.04, "world"), (1, 0, 1.0, 10.0, "hello"), (1, 0, 1.0, 20.0, "next")], "doc_id long, page int, x0 double, y0 double, word string")
    assert files.page_lines(boxes).first().text == "hello world\nnext"
    pages = spark.createDataFrame([(1, i, f"page {i} " + "x" * 30) for i in range(10)] + [(2, 0, "short")], "doc_id long, page int, text string")
    got = files.pages_text(pages, most_pages=3, most_chars=50).collect()
    assert len(got) == 1 and got[0].text.startswith("page 0") and len(got[0].text) <= 52


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    refs = spark.createDataFrame([(1, TEXT)], "ref_id long, text string")
    seen = []
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = live.check_stream(stream, refs, lambda df, n: seen.extend(r.plag_pct for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and seen == [100.0]


def test_entry(spark):
    assert entry.queries().keys() >= entry.oracle_sql().keys() and callable(entry.entry)
