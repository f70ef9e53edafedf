"""The whole check, and main texts of pages, against slow plain-Python versions."""

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from html import unescape
from math import sqrt

import pytest
from pyspark.sql import functions as F

from loomspan.functions import html as H
from loomspan.functions import plain as Y
from loomspan.functions import text as T
from loomspan.operators import spans as P
from loomspan.plans import overlap, retrieval
from loomspan.sources import files

SF = "/root/testdata/sf0.001"


def cut(text):
    return P.paragraphs_of(text, 6) or P.sentences_of(text, 3)


def cosine(a, b):
    dot = sum(n * b[k] for k, n in a.items())
    return min(1.0, dot / sqrt(sum(n * n for n in a.values())) / sqrt(sum(n * n for n in b.values()))) if dot else 0.0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def grams(norm):
    return Counter(norm[i : i + 4] for i in range(max(1, len(norm) - 3))) if norm else Counter()


def blocks(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()


def united(ranges, size):
    marks = [False] * size
    for s, e in ranges:
        marks[s:e] = [True] * (min(e, size) - s)
    edges = [i for i in range(size + 1) if (i < size and marks[i]) != (i > 0 and marks[i - 1])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def plain_check(text, refs, least):
    """(plag_pct, number of matches, scores by span) of one text against (title, url, source, text) rows."""
    own, theirs = cut(text), [(r[:3], s) for r in refs for s in cut(r[3])]
    mine = set().union(*(Y.content(s[5]) for s in own[:260])) if own else set()
    concepts = defaultdict(set)
    for key, s in theirs:
        concepts[key] |= set(Y.content(s[5]))
    blob = {}
    for r in refs:
        blob.setdefault(r[:3], " ".join(Y.tokens(r[3])))
    covered, scores = [False] * len(text), {}
    for s in own:
        content, norm, raw = Y.content(s[5]), " ".join(s[5]), s[4]
        hits = []
        for place, (key, r) in enumerate(theirs):
            other = Y.content(r[5])
            n = 3 * len(set(Y.shingles(content)) & set(Y.shingles(other))) + len(set(content) & set(other))
            if n >= 2:
                hits.append((-n, place, key, r, other))
        found = []
        for _, place, key, r, other in sorted(hits, key=lambda h: h[:2])[:48]:
            r_norm = " ".join(r[5])
            token, concept = cosine(Counter(content), Counter(other)), jaccard(set(content), set(other))
            base = 0.34 * token + 0.18 * cosine(grams(norm), grams(r_norm)) + 0.18 * SequenceMatcher(None, norm, r_norm).ratio() + 0.18 * concept + 0.12 * (1 - sqrt(max(0.0, 1 - token * token)))
            longest = max((b.size for b in blocks(norm, r_norm)), default=0) / max(1, len(norm))
            score = 0.68 * base + 0.20 * longest + 0.12 * jaccard(set(Y.shingles(content)), set(Y.shingles(other)))
            score = min(1.0, score * (0.92 + 0.16 * jaccard(mine, concepts[key])))
            if score >= 0.82 * least:
                found.append((score, key, [(b.a, b.a + b.size) for b in blocks(raw.lower(), r[4].lower()) if b.size >= 16]))
        if not found or (best := max(found, key=lambda f: f[0]))[0] < least:
            continue
        score, key, ranges = best
        every = [x for f in found if f[1] == key and f[0] >= max(0.86 * least, 0.42 * score) for x in f[2]]
        ranges = united(every or ranges, len(raw))
        if len(norm) >= 40 and norm in blob[key]:
            ranges, score = [(0, len(raw))], max(score, 0.97)
        share = sum(e - a for a, e in ranges) / max(1, len(raw))
        if (not ranges and score >= 0.84) or (share < 0.22 and score >= 0.90):
            ranges = [(0, len(raw))]
        placed = [(s[2] + a, min(s[3], s[2] + e)) for a, e in ranges] or [(s[2], s[3])]
        for a, e in placed:
            covered[a : min(e, len(text))] = [True] * (min(e, len(text)) - a)
        scores[s[0]] = score
    pct = sum(covered) / max(1, len(text)) * 100
    return (0.1 if scores and round(pct, 1) == 0 else pct), len(scores), scores


def test_check_of_documents(spark):
    """The check behind hybrid_matches and doc_overlap_pct, on documents with items whole, altered and cut."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = [r.text for r in items.orderBy("item_id").collect()]
    words = [x.split() for x in item]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 200 and 3000").orderBy("doc_id").limit(16).collect()]
    altered = [" ".join("changed" if k % 6 == 5 else w for k, w in enumerate(x)) for x in words]
    halves = [" ".join(x[: len(x) // 2] + y[len(y) // 2 :]) for x, y in zip(words, words[1:], strict=False)]
    made = [*docs, *(f"{d}\n\n{x}" for d, x in zip(docs, [*item[:4], *altered[:5], *halves[:5]], strict=False)), item[9] + " " + docs[0], "", "two words"]
    some = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    refs = items.select(F.col("item_id").alias("ref_id"), F.concat(F.lit("Item "), (F.col("item_id") % 30).cast("string")).alias("title"), F.lit("").alias("url"), F.lit("Benchmark").alias("source"), "text")
    matches, results = overlap.check(some, refs)
    texts = {r.doc_id: r.text for r in overlap.target_texts(some, "doc_id", "text").collect()}
    rows = [(r.title, r.url, r.source, r.text) for r in overlap.reference_rows(refs).orderBy("ref_id").collect()]
    want = {d: plain_check(t, rows, 0.58) for d, t in texts.items()}
    assert sum(n > 0 for _, n, _ in want.values()) >= 5
    got = {r.doc_id: r for r in results.collect()}
    assert {d: (r.plag_pct, r.n_matches) for d, r in got.items()} == {d: (pytest.approx(p, abs=0.051), n) for d, (p, n, _) in want.items()}
    found = {(r.doc_id, r.span_id): r.score for r in matches.collect()}
    assert found == {(d, i): pytest.approx(100 * x, abs=0.051) for d, (*_, scores) in want.items() for i, x in scores.items()}
    overlap.release(results)


def test_compare_of_pairs(spark):
    """file_compare: each text meets its own reference only, however common their terms are."""
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 2500 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    rows = [(i, a, b) for i, (a, b) in enumerate([(docs[0], docs[0]), (docs[1], docs[2]), (docs[3], docs[3][: len(docs[3]) // 2] + docs[4]), (docs[5] + "\n\n" + docs[6], docs[6]), ("", docs[7]), (docs[8], "")])]
    pairs = spark.createDataFrame(rows, "pair_id long, reference_text string, text string")
    got = {r.pair_id: r for r in overlap.compare(pairs).collect()}
    texts = {r.doc_id: r.text for r in overlap.target_texts(pairs, "pair_id", "text").collect()}
    refs = {r.ref_id: r.text for r in overlap.reference_rows(pairs.select(F.col("pair_id").alias("ref_id"), F.col("reference_text").alias("text"))).collect()}
    for i, reference, text in rows:
        if reference and text:
            pct, n, _ = plain_check(texts[i], [("Local File", "", "Local File", refs[i])], 0.60)
            assert (got[i].plag_pct, got[i].n_matches) == (pytest.approx(pct, abs=0.051), n)
    assert got[0].plag_pct == 100.0 and got[5].mode == "empty" and got[4].mode == "offline"


def plain_main_text(page):
    flat = lambda x: " ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split())
    body = re.sub(r"<(script|style|noscript|svg|header|footer|nav|aside)[^>]*>.*?</\1>", " ", page, flags=re.I | re.S)
    found = []
    for name, rest in (("article", ""), ("main", ""), ("section", H.MARKED), ("div", H.MARKED)):
        for m in re.finditer(rf"<{name}{rest}(.*?)</{name}>" if rest else rf"<{name}[^>]*>(.*?)</{name}>", body, re.I | re.S):
            text = flat(m[1])
            found.append((len(text) + 220 * len(re.findall(r"<p\b", m[1], re.I)) + 120 * len(re.findall(r"<h[1-3]\b", m[1], re.I)), text))
    for script in re.findall(r"<script[^>]*>(.*?)</script>", page, re.I | re.S):
        if "articleBody" in script or '"text"' in script:
            for key in ("articleBody", "text"):
                for v in re.findall(rf'"{key}"\s*:\s*"((?:\\.|[^"\\])+)"', script, re.I | re.S):
                    text = " ".join(unescape(v.encode().decode("unicode_escape", "ignore")).split())
                    found.append((len(text) + 800, text))
    found = [f for f in found if len(f[1]) >= 320]
    return max(found, key=lambda f: f[0])[1] if found else flat(body)


def test_main_text_of_pages(spark):
    words = "word " * 100
    awkward = [
        f"<article>{'x ' * 200}<pre></pre><pre></pre><pre></pre><pre></pre><pre></pre></article><main><p>{'y ' * 300}</p></main>",
        f"<article><picture></picture>{words}</article><article><p>{words}</p></article>",
        f'<div id = "content">{words}</div><section class="my-entry"><h2>t</h2><h4>u</h4>{words}</section>',
        f'<script>{{"articleBody": "a <b>{words}</b> \\u00e9 \\q \\x4 &amp; {words}"}}</script><article>{words}</article>',
        f'<script>{{"ARTICLEBODY": "{words}"}}</script><p>short',
        f'<script>"text" : "{words * 2}"</script><script>"articleBody":"{words * 2}!"</script>',
        f'<script>x = "text</script><p>a "text": "b {words}" c',
        f"<navigation>lost {words}</nav><p>kept",
        "",
        "<p>&lt;b&gt;   x",
    ]
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + awkward
    got = H.main_text(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string"), "html")
    assert {r.i: r.main_text for r in got.collect()} == {i: plain_main_text(p) for i, p in enumerate(pages)}


def test_issues_are_collapsed_first(spark):
    df = spark.createDataFrame([(["a  b", "a b", None, " ", "c\n", "c", "d"],), (["x"],), ([],)], "i array<string>")
    assert [r[0] for r in df.select(T.issue_summary(F.col("i"))).collect()] == ["a b; c; d", "x", ""]


def test_service_choice(spark):
    """First accepted service; else the best score, an earlier service before a later, the last one last."""
    item = "The committee reviewed several proposals about regional water storage and agreed that new reservoirs should be built along the northern valley."
    other = "Violins and oboes performed midnight serenades across distant islands together with seasoned percussionists and their trumpets."
    docs = spark.createDataFrame([(i, item) for i in range(4)], "doc_id long, text string")
    rows = [(0, 1, "DuckDuckGo", other), (0, 2, "Wikipedia", item), (0, 3, "SerpApi", item), (1, 4, "DuckDuckGo", other), (1, 5, "SerpApi", item), (2, 6, "Wikipedia", other), (2, 7, "SerpApi", other), (3, 8, "SerpApi", other), (3, 9, "elsewhere", item)]
    web = spark.createDataFrame([(d, r, f"t{r}", f"u{r}", t, s) for d, r, s, t in rows], "doc_id long, ref_id long, title string, url string, text string, source string")
    got = {(r.doc_id, r.source): r.taken for r in retrieval.web_choice(docs, web).collect()}
    assert {k for k, taken in got.items() if taken} == {(0, "Wikipedia"), (1, "SerpApi"), (2, "Wikipedia"), (3, "SerpApi")} and len(got) == 8
    refs = retrieval.web_references(docs, web).collect()
    assert {(r.doc_id, r.ref_id, r.position) for r in refs} == {(0, 2, 1), (1, 5, 1), (2, 6, 1), (3, 8, 1)}


def test_files_to_comparison(spark, tmp_path):
    text = "One passage of many words that stands in both of the files, long enough to be a paragraph of its own."
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_text("")
    read = files.read_files(spark, str(tmp_path), lambda content: ["x"], lambda content: [text]).withColumn("path", F.element_at(F.split("path", "/"), -1))
    pairs = spark.createDataFrame([(1, "a.txt", "b.pdf"), (2, "a.txt", "c.txt"), (3, "none", "a.txt")], "pair_id long, reference_path string, path string")
    got = {r.pair_id: (r.plag_pct, r.mode) for r in overlap.compare_files(pairs, read).collect()}
    assert got == {1: (100.0, "external"), 2: (0.0, "empty"), 3: (0.0, "offline")}
    assert {r.path: r.text for r in files.read_files(spark, str(tmp_path), lambda content: ["x" * 130], None).collect()}.popitem()


def test_pages_and_cache(spark):
    long = "words of the file " * 30
    rows = [("http://x/a%20b.pdf", None, long), ("http://x/c.pdf", None, "short"), ("http://x/d", f"<title>T</title><p>{long}", None), ("http://x/e", "<p>few", None)]
    got = [tuple(r) for r in H.reference_from_page(spark.createDataFrame(rows, "url string, html string, pdf string"), pdf="pdf").select("title", "status").collect()]
    assert got == [("a b.pdf", "ok"), ("c.pdf", "too little text in the PDF"), ("T", "ok"), ("http://x/e", "too little text")]
    boxes = spark.createDataFrame([(1, 0, 1.0, 10.0, "few"), (2, 0, 1.0, 10.0, "enough letters in a line")], "doc_id long, page int, x0 double, y0 double, word string")
    plain = spark.createDataFrame([(1, 0, "the page's own text"), (2, 0, "unused"), (3, 0, "no words")], "doc_id long, page int, text string")
    assert {r.doc_id: r.text for r in files.page_lines(boxes, plain=plain).collect()} == {1: "the page's own text", 2: "enough letters in a line", 3: "no words"}
    cached = F.struct(F.lit("topic").alias("mode"), F.lit("q").alias("query"), F.lit("k").alias("key"))
    cases = [("topic", "q", "k", cached, False), ("topic", "r", "k", cached, True), ("web", "q", "k", cached, True), ("topic", "q", "other", cached, True), ("topic", "q", "k", F.when(F.lit(False), cached), True)]
    row = spark.range(1).select(*[retrieval.stale(F.lit(m), F.lit(q), F.lit(k), before).alias(f"c{i}") for i, (m, q, k, before, _) in enumerate(cases)]).first()
    assert list(row) == [c[-1] for c in cases]
    url = F.struct(F.lit("url").alias("mode"), F.lit("q").alias("query"), F.lit("k").alias("key"))
    assert spark.range(1).select(retrieval.stale(F.lit("url"), F.lit("q"), F.lit("k"), url)).first()[0]
