"""Pages of files read one at a time, and sentences swept over paragraphs."""

import json

import pandas as pd
from pyspark.sql import functions as F

from loomspan.functions import html as H
from loomspan.functions import plain as Y
from loomspan.functions import text as T
from loomspan.operators import spans as P
from loomspan.plans import catalog, retrieval
from loomspan.sources import files, providers

ROUGH = ["  a\t b \n\n\n\n c ", "co-\n operate\r\nnow\r12\r\nend", " 12 \n\n 345", "ﬁne “x” – y", "", " x　", "a\n \n \nb", "12345\n1234\n", "x-\n-y", " \n ", "é-\na", "tail 7\n7"]


def test_plain_forms_equal_the_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ROUGH)], "i int, t string").select("t", T.clean_block(F.col("t")).alias("c")).collect()
    assert all(Y.clean_block(r.t) == r.c for r in rows)
    sizes = spark.createDataFrame([(n, m) for n in (0, 1, 2, 5, 39, 40, 41, 50, 99, 1000) for m in (0, 1, 2, 3, 40)], "n int, m int")
    assert all(Y.sample_indexes(r.n, r.m) == r.x for r in sizes.select("n", "m", T.sample_indexes(F.col("n"), F.col("m")).alias("x")).collect())


def reader_of(log):
    """Payloads like ``3:120`` are three pages of 120 letters; what is extracted is noted in a folder."""

    def reader(content):
        if content == b"broken":
            raise ValueError("no file")
        n, size = map(int, content.decode().split(":"))

        def page(i):
            (log / f"{n}-{size}-{i}").touch()
            if size == 13:
                raise ValueError("no page")
            return f"p{i} ".ljust(size, "x")

        return n, page

    return reader


def test_pages_are_read_until_letters_run_out(spark, tmp_path):
    reader = reader_of(tmp_path)
    made = [(1, b"200:100"), (2, b"3:50"), (3, b"broken"), (4, None), (5, b""), (6, b"0:9"), (7, b"2:13"), (8, b"500:5"), (9, b"1:300")]
    payloads = spark.createDataFrame(pd.DataFrame(made, columns=["doc_id", "content"]), "doc_id long, content binary")
    got = files.read_pages(payloads, reader, most_pages=40, most_chars=250).collect()
    assert [(r.n_pages, r.page) for r in got if r.doc_id == 1] == [(200, i) for i in Y.sample_indexes(200, 40)[:3]]
    assert len(list(tmp_path.glob("200-100-*"))) == 3  # the other 197 pages were never extracted
    assert sorted({r.doc_id for r in got}) == [1, 2, 8, 9] and sum(r.doc_id == 8 for r in got) == 40

    def brute(content):
        if not content or content == b"broken" or content == b"2:13":
            return ""
        n, size = map(int, content.decode().split(":"))
        out, held = [], 0
        for i in Y.sample_indexes(n, 40):
            t = Y.clean_block(f"p{i} ".ljust(size, "x"))
            if held < 250 and len(t) >= 20:
                out.append(t[: 250 - held])
                held += len(out[-1])
        return Y.clean_block("\n\n".join(out))

    assert {r.doc_id: r.text for r in files.pdf_texts(payloads, reader, most_chars=250).collect()} == {i: brute(c) for i, c in made}
    other = lambda content: (1, lambda i: "read by the other one, at length")
    got = {r.doc_id: r.text for r in files.pdf_texts(payloads, reader, other, most_chars=250).collect()}
    assert got[1] == brute(b"200:100") and got[9] == brute(b"1:300")
    assert {got[i] for i in (2, 3, 6, 7, 8)} == {"read by the other one, at length"} and got[4] == got[5] == ""
    assert files.pdf_texts(payloads.where("doc_id < 0"), reader, other).count() == 0


def test_paragraphs_of_sentences(spark):
    rows = [(1, s, s * 10, s * 10 + 9) for s in range(12)] + [(2, 0, 5, 8), (None, 0, 1, 2)]
    sents = spark.createDataFrame(rows, "doc_id long, span_id int, start int, end int")
    paras = [(1, 0, 0, 20), (1, 1, 20, 60), (1, 2, 40, 80), (1, 3, 60, 80), (1, 4, 95, 101), (1, 5, 110, 111), (3, 0, 0, 9), (None, 0, 0, 9)]
    own = spark.createDataFrame(paras, "doc_id long, span_id int, start int, end int")
    want = {(d, i): min((k for e, k, a, z in paras if e == d and a <= s < z), default=-1) for d, i, s, _ in rows if d is not None}
    got = {(r.doc_id, r.span_id): r.paragraph_id for r in P.paragraph_ids(sents, own).collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == want and len(got) == len(rows)
    none = P.paragraph_ids(sents, own.limit(0)).collect()
    assert len(none) == len(rows) and {r.paragraph_id for r in none} == {-1}


def test_pdf_files_among_read_pages(spark):
    long = "<title>A page</title>" + "<p>" + "some words of a page here, " * 30 + "</p>"
    reader = lambda content: (2, lambda i: content.decode() * 20)
    rows = [
        ("https://x.org/a%20b.pdf", None, None, b"text of a file "), ("https://x.org/get", "application/pdf", None, b"served as a file "), ("https://x.org/few.pdf", None, None, b"x"),
        ("https://x.org/page", "text/html", long, None), ("https://x.org/short", "text/html", "<p>x</p>", None), ("ftp://x.org/c.pdf", None, None, b"text of a file "), ("https://x.org/none.pdf", None, None, None),
    ]
    pages = spark.createDataFrame(rows, "url string, content_type string, html string, content binary")
    got = {r.url: (r.page_title, r.page_text) for r in files.readable(pages, reader).collect()}
    whole = lambda t: Y.clean_block("\n\n".join([Y.clean_block(t * 20)] * 2))
    assert got["https://x.org/a%20b.pdf"] == ("a b.pdf", whole("text of a file ")) and got["https://x.org/get"] == ("get", whole("served as a file "))
    assert got["https://x.org/few.pdf"] == got["https://x.org/none.pdf"] == got["https://x.org/short"] == ("", "")
    assert got["https://x.org/page"][0] == "A page" and "some words of a page" in got["https://x.org/page"][1] and len(got) == 6


def test_pages_of_a_service(spark):
    def body(names):
        return json.dumps({"results": [{"display_name": n, "id": n, "abstract_inverted_index": {"w": [0]}} for n in names]})

    rows = [("q", 1, body("abc")), ("q", 2, body("de")), ("r", 1, body("")), ("r", 2, body("f")), ("s", 1, body("g")), ("s", 2, body("hij"))]
    found = providers.openalex(spark.createDataFrame(rows, "query string, page int, payload string"))
    assert sorted((r.query, r.rank, r.title) for r in found.collect()) == [("q", i, t) for i, t in enumerate("abcde")] + [("s", i, t) for i, t in enumerate("ghij")]
    one = lambda name, sizes: spark.createDataFrame([(q, i, f"{name}{q}{i}", "", "t", name) for q, n in sizes.items() for i in range(n)], "query string, rank int, title string, url string, text string, source string")
    for most in (1, 2, 3, 4):
        before = one("Crossref", {"q": 0 if most > 1 else 2, "s": 1})
        got = retrieval.gated({"Crossref": before, "OpenAlex": found, "Later": one("Later", {"q": 1, "s": 1})}, most)
        own = {(r.query, r.title) for r in got.where("service = 'OpenAlex'").collect()}
        counts = {"q": 0 if most > 1 else 2, "s": 1}
        expected = set()
        for q, pages in (("q", ("abc", "de")), ("s", ("g", "hij"))):
            n = counts[q]
            if n < most:
                for k, names in enumerate(pages):
                    if k and n >= 2 * most:
                        break
                    expected |= {(q, t) for t in names}
                    n += len(names)
        assert own == expected, (most, own, expected)


def test_doubles_of_a_service(spark):
    items = [{"title": "A", "url": u, "snippet": s * 60} for u, s in (("l", "t"), ("L ", "u"), ("m", "t"))]
    links = "".join(f'<a href="/{u}">Title {i} long</a><p>{"u" * 70}</p>' for i, u in enumerate("xxyz"))
    rows = [("q", json.dumps({"results": items})), ("r", json.dumps({"results": items[1:]})), ("h", links)]
    payloads = spark.createDataFrame(rows, "query string, payload string")
    got = sorted((r.query, r.rank, r.url) for r in providers.grokipedia(payloads, 3).collect())
    home = providers.HOME
    assert got == [("h", 0, f"{home}/x"), ("h", 2, f"{home}/y"), ("q", 0, "l"), ("q", 2, "m"), ("r", 0, "L"), ("r", 1, "m")]


def test_entity_functions_get_few_rows_at_once(spark):
    """No Arrow columns, which would hold thousands of pages in a worker; awkward values stay right."""
    rows = [(1, "a &amp; b \U0001f600&#x1F600; &#xD800; &nosuch; é"), (2, None), (3, ""), (4, "plain"), (5, "x\x00&lt;y")]
    own = spark.createDataFrame(rows, "id long, html string")
    got = {r.id: (r.plain, r.bodies) for r in own.select("id", H.unescape("html").alias("plain"), H.json_bodies(F.array(F.lit("tea \\u00e9 &amp; \\ud83d\\ude00 \\ud83d"))).alias("bodies")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "a & b \U0001f600\U0001f600 � &nosuch; é", 2: None, 3: "", 4: "plain", 5: "x\x00<y"}
    assert {tuple(v[1]) for v in got.values()} == {("tea é & \U0001f600 �",)}
    pages = catalog.expand_references(spark, "/root/testdata/sf0.001")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
