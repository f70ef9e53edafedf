"""Every operator against a brute-force version, on small tables with awkward rows."""

import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup, fingerprints, language_id, line_dedup, mixing, sentencepiece_scan, simhash, suffix_dedup, url_filter, warc
from loomspan.llm.common import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, hash long, host string, entry string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, lang="en"):
    """Documents with extra columns whose names the operators use themselves."""
    return [(i, t, lang if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, 2, "x", "y") for i, t in enumerate(texts)]


def awkward():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéßñ漢😀") for _ in range(rnd.randint(1, 7)))
    base = [" ".join(word() for _ in range(rnd.choice([1, 2, 3, 40, 300]))) for _ in range(40)]
    return ["", None, " \t\n", "a", "A", "Same Text", "same text", *base, *base[:10], base[30] + " tail", "x" * 3000, "ab " * 900, base[-1] * 30, base[-1] * 30, "\x00\u2028 é\u0301 ▁ ▁▁ z", "one\r\n\r\ntwo   three"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = rows_of(awkward())
    rows += [rows[8], (None, "null id", "en", "s1", 7, 1, 2, "x", "y"), (None, "null id", "en", "s1", 7, 1, 2, "x", "y")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def same(a, b):
    assert collections.Counter(a) == collections.Counter(b)


def test_empty_tables(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert fingerprints.compare_edited(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
    assert sentencepiece_scan.encode(empty, sentencepiece_scan.read_model()).count() == 0
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.build_derivatives(warc.responses(pages), "page_id").count() == 0
    assert line_dedup.site_line_dedup(pages, line_dedup.page_lines(F.col("html")), url_filter.host_of(F.col("url"))).count() == 0
    assert url_filter.url_filter(pages, url_filter.default_rules(empty.sparkSession)).count() == 0


def removal(texts, length):
    raws = [t.encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs):
    rows = pairs(docs)
    want = [(d, *x) for (d, _), x in zip(rows, removal([t for _, t in rows], 400), strict=True)]
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()], want)


def test_suffix_dedup_over_chunks(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    letters = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    shared = [letters(n) for n in (399, 400, 401, 700, 1500)]
    texts = [letters(rnd.randint(0, 900)).join(rnd.choice(shared) for _ in range(rnd.randint(0, 5))) for _ in range(30)] + ["".join(shared)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    made = []
    for a in range(0, len(texts), 7):  # the workers' module keeps its chunk, so the function runs here
        made.append([(i, t.encode()) for i, t in enumerate(texts[a : a + 7], a)])
    import pyarrow as pa

    run, _ = suffix_dedup.runs_of(400, 96)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in m]), pa.array([t for _, t in m], pa.binary())], names=["row", "text"]) for m in made]
    starts = collections.Counter()
    for b in run(iter(batches)):
        for row, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            starts.update((row, (place >> 16) + k) for k in range(place >> 8 & 255))
    want = collections.Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 399))
    assert starts == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == [(i, *x) for i, x in enumerate(removal(texts, 400))]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, keep):
    rows = pairs(docs)
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    best = {t: (max if keep == "max" else min)((x for x in ds if x is not None), default=None) for t, ds in groups.items()}
    got = exact_dedup.exact_dedup(docs, keep=keep, runs=8, fan=2).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(d, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows])
    kept = [r for r in got if r.kept]
    same([r.text_sha256 for r in kept], [hashlib.sha256(t.encode()).hexdigest() for t in groups])
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_stage(spark, docs):
    got = exact_dedup.stage(spark, docs, SF)
    assert got.columns == docs.columns
    same([r.text or "" for r in got.collect()], {t for _, t in pairs(docs)})


def filled(sizes, weights):
    """The contract's targets by slow and plain rounds of sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    capped = set()
    while True:
        left = total - sum(target[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] if s in over else v for s, v in share.items()}
        if not over or len(capped) + len(over) == len(names):
            return target
        capped |= set(over)


def test_mixing(docs):
    got = mixing.mix(docs, block=8, shard_rows=10).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    want = filled(size, mixing.WEIGHTS)
    same([(r.doc_id, r.size) for r in got], [(d, len(WORD.findall(t))) for d, t in pairs(docs)])
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 8 * 12, (s, taken[s], t)
    same([(r.row, r.taken) for r in got], [(r.row, r.taken) for r in mixing.mix(docs, block=8, shard_rows=10).collect()])


def test_apportion_is_sainte_lague():
    rnd = random.Random(1)
    for _ in range(200):
        votes = [rnd.choice([0, 1, 5, rnd.randint(1, 1000)]) for _ in range(rnd.randint(1, 12))]
        seats = rnd.randint(0, 60)
        most = [rnd.choice([seats, rnd.randint(0, 9)]) for _ in votes]
        plain = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] and plain[i] < most[i]]
            if not open_:
                break
            i = min(open_, key=lambda i: (-votes[i] / (2 * plain[i] + 1), i))
            plain[i] += 1
        got = mixing.apportion(np.array(votes), seats, np.array(most)).tolist()
        assert sum(got) == sum(plain)
        quotient = lambda i, n: votes[i] / (2 * n - 1)
        for i, (a, b) in enumerate(zip(got, plain, strict=True)):  # alike but for exact ties
            if a > b:
                assert any(q > p and quotient(i, a) == pytest.approx(quotient(j, q)) for j, (p, q) in enumerate(zip(got, plain, strict=True)))


def test_mixing_stage(spark, docs):
    got = mixing.stage(spark, docs, SF)
    assert got.columns == docs.columns
    count = collections.Counter((r.doc_id, r.text) for r in got.collect())
    most = collections.Counter(docs.select("doc_id", "text").rdd.map(tuple).collect())
    assert count and all(n <= 3 * most[k] for k, n in count.items())


URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/x?y/fr/", "https://example.net/en/1", "https://blog.EXAMPLE.net/en/", "https://example.net/en", "http://badexample.net/en/", "http://x.example.com/de/a#b", "http://example.com/fr/", "http://w.org/fr/a", "http://org/fr/", "http://.net/", "http://a..net/", "x://y://z.net/", "http://a.net?/", "http://example.community/de/", "http://example.com/de/\nq", "http://ex ample.net/en/"]


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: (len(x[0]), x[0]), default=(None, default))
    return host, path, rule, verdict


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_url_filter(spark, ranges):
    rnd = random.Random(ranges)
    rules = [*url_filter.RULES, ("a.net", "/", "allow"), ("b.a.net", "/p/", "block"), ("net", "/p/q/r/", "allow")]
    urls = [*URLS, *("http://" + ".".join(rnd.choices(["a", "b", "net", "org", "example", "com"], k=rnd.randint(1, 4))) + rnd.choice(["/", "/p/", "/p/q/r/s", "/en/", "/de/x", ""]) for _ in range(300)), *["http://b.a.net/p/1"] * 100]
    pages = spark.createDataFrame([(None if i == 3 else i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges)
    same([tuple(r) for r in got.collect()], [(None if i == 3 else i, *judged(u, rules)) for i, u in enumerate(urls)])


def weights(text):
    return collections.Counter(WORD.findall(text) or [""])


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).sort("doc_id")).collect()}
    texts = {d: t for d, t in pairs(docs) if d is not None}
    order = sorted(texts, reverse=True)
    wrong = []
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, other = texts[d], texts[after]
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        wrong += [got[d].near_edited - jaccard(t, edited), got[d].near_next - jaccard(t, other)]
        assert len(got[d].fingerprint) == 8 * fingerprints.SLOTS
        if t == edited:
            assert got[d].near_edited == 1.0 and got[d].fingerprint == got[d].edited_fingerprint
    assert abs(np.mean(wrong)) < 0.03 and np.std(wrong) < 0.1
    by_text = collections.defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_awkward_ids(docs):
    assert fingerprints.compare_edited(docs).count() == docs.count()
    one = docs.where("doc_id = 20")
    r = fingerprints.compare_edited(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    found = fingerprints.fingerprint(docs, size=8)
    assert found.count() == docs.count()


def test_fingerprint_weighs_counts(spark):
    """The collision rate follows the weights, not the sets of words."""
    a, b = "a " * 30 + "b", "a " * 10 + "b " * 5
    df = spark.createDataFrame([(0, a), (1, b)], "k long, text string")
    got = [r["sample"] for r in fingerprints.signatures(df, ["k"], "text", 400).sort("k").collect()]
    assert np.mean([x == y for x, y in zip(*got, strict=True)]) == pytest.approx(jaccard(a, b), abs=0.08)


def test_line_dedup(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        host = "hot.example" if i < 40 else f"h{i % 5}.example"
        lines = ["menu", "menu", *(f"line {rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 6))), *(["footer"] if rnd.random() < 0.5 else [])]
        rows.append((i if i else None, f"http://{host}/{i}", lines, 7, "x"))
    rows += [rows[5], (70, None, None, 1, "y"), (71, None, ["a", None, "a"], 1, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, ls array<string>, n long, host string")
    got = line_dedup.site_line_dedup(pages, F.filter("ls", lambda x: x.isNotNull()), url_filter.host_of(F.col("url")))
    per = collections.defaultdict(list)
    for r in rows:
        host = r[1].split("/")[2] if r[1] else ""
        per[host].append([x for x in r[2] or [] if x is not None])
    want = []
    for r in rows:
        host = r[1].split("/")[2] if r[1] else ""
        pages_of = per[host]
        seen = collections.Counter(x for p in pages_of for x in set(p))
        own = [x for x in r[2] or [] if x is not None]
        kept = [x for x in own if seen[x] <= 0.3 * len(pages_of)]
        want.append((r[0], host, len(pages_of), len(own), len(own) - len(kept), "\n".join(kept)))
    same([tuple(x) for x in got.collect()], want)


def bits_of(text, width=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius):
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("tile", [4096, 5])
def test_simhash(docs, tile):
    rows = pairs(docs)
    prints = [bits_of(t) for _, t in rows]
    group = components(prints, 3)
    least = {g: min((d for (d, _), x in zip(rows, group, strict=True) if x == g and d is not None), default=None) for g in group}
    got = simhash.near_dedup(docs, tile=tile).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)])


@pytest.mark.parametrize("tile", [4096, 7])
def test_near_links_connect_all(spark, tile):
    rnd = random.Random(9)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(rnd.randint(0, 6)):
            for _ in range(rnd.randint(1, 4)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    values |= {0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 64) - 2}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, tile)
    got = {r.node: r.component for r in connected_components(links).collect()}
    group = components(values, 3)
    want = {v: min(signed[i] for i, g in enumerate(group) if g == x) for v, x in zip(signed, group, strict=True)}
    assert {v: got.get(v, v) for v in signed} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 201)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200} | {300 + i: 300 for i in range(50)}


def test_language_model_is_kneser_ney():
    """Probabilities sum to one, and those in the arrays equal a plain recursive computation."""
    texts = ["abracadabra cabra", "barca abac", "cadabra rabac"]
    sym = [language_id.padded(language_id.symbols(t)) for t in texts]
    model = language_id.fit({"x": texts, "y": ["zzz abra"]})
    grams = [collections.Counter(tuple(int(c) for c in s[i - n + 1 : i + 1]) for s in sym for i in range(3, len(s))) for n in range(1, 5)]
    counts = [collections.Counter(g[1:] for g in grams[n]) if n < 4 else grams[3] for n in range(1, 5)]

    def p(gram):
        n = len(gram)
        c = counts[n - 1]
        one, two = (sum(v == k for v in c.values()) for k in (1, 2))
        cut = one / (one + 2 * two) if one and two else 0.5
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        total, lam = sum(own.values()), cut * len(own) / sum(own.values()) if own else 1.0
        if n == 1:
            return (c[gram] - cut) / total + lam / (len(c) + 1) if gram in c else 1e-6
        return (max(0, c[gram] - cut) / total if gram in own else 0.0) + lam * p(gram[1:])

    text = language_id.padded(language_id.symbols("cabra dab"))
    loss = model.losses(text)[:, 0]
    assert np.allclose(loss, [-np.log(p(tuple(int(c) for c in text[i - 3 : i + 1]))) for i in range(3, len(text))], rtol=1e-4)
    seen = {g[0] for g in counts[0]}
    assert sum(p((*g[:-1], s)) for g in [next(iter(grams[3]))] for s in seen) == pytest.approx(1, abs=0.02)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs, per_language=40)
    got = language_id.predict(docs, model, keep=("lang",)).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(held) > 0.95 and not any(r.rejected for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in model.langs for r in got)


def test_language_id_of_awkward_texts(spark, docs):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(train, per_language=30)
    long = "The and of there " * 90_000
    extra = spark.createDataFrame([(500, long), (501, "123 !!"), (502, None), (503, "漢字漢字漢字漢字漢字漢字漢字"), (504, long[:17])], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(extra, model).collect()}
    assert got[500].lang_pred == "en" and got[500].entropy == pytest.approx(got[504].entropy, rel=0.1)
    assert [got[i].lang_pred for i in (501, 502)] == ["und", "und"] and got[501].rejected and got[501].score == 0
    assert got[503].rejected and not got[500].rejected
    assert language_id.predict(docs, model).count() == docs.count()
    kept = language_id.stage(spark, train, SF)
    assert kept.columns == train.columns and kept.count() == train.count()


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    own, library = sentencepiece_scan.Pieces(sentencepiece_scan.read_model()), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    rnd = random.Random(6)
    sets = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeinrst ", "a ", "01 -=.,", "éèàüñçß the", "漢字かな кир", "\t\n x▁", "=-*/ "]
    for n in (0, 1, 5, 20, 100, 300):
        for s in sets:
            for _ in range(12):
                t = "".join(rnd.choice(s) for _ in range(n))
                assert own.encode(t).tolist() == library.encode(t), t
    got = sentencepiece_scan.encode(docs, sentencepiece_scan.read_model(), part=200)
    same([(r.doc_id, tuple(r.ids), r.n_tokens) for r in got.collect()], [(d, tuple(x := library.encode(t)), len(x)) for d, t in pairs(docs)])
    back = sentencepiece_scan.decode(got, sentencepiece_scan.read_model())
    same([(r.doc_id, r.text) for r in back.collect()], [(d, t.replace("▁", " ")) for d, t in pairs(docs)])


def test_sentencepiece_unigram_scan():
    """With scores as weights the scan over chunks finds the best sum, as a plain Viterbi does."""
    own = sentencepiece_scan.Pieces(sentencepiece_scan.read_model())
    own.bpe = False
    rnd = random.Random(8)
    for _ in range(40):
        t = "".join(rnd.choice("thenaiosr") for _ in range(rnd.randint(1, 260)))
        best = [0.0] + [-np.inf] * len(t)
        for p in range(len(t)):
            for node in own.nodes_at(t, p):
                best[p + len(node)] = max(best[p + len(node)], best[p] + own.weight(node))
        path = own.scan(t)
        assert "".join(path) == t and sum(map(own.weight, path)) == pytest.approx(best[-1])


PAGE = '<html><head><title>A &amp; B</title><meta name="d" content="x"><script>var a="<p>";</script></head><body><nav><a href="/n?a=1&amp;b=2">N</a></nav><p>Über\n  uns</p><!-- no --><div>zwei<br>drei</div></body></html>'


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE, "x"), (2, None, None, "y"), (None, "http://h/b", "", "z"), (4, "http://h/c", "x" * 100_000, "w")], "page_id long, url string, html string, block string")
    sent = warc.responses(pages)
    made = warc.build_derivatives(sent, "page_id")
    rows = {(r.source_id, r.warc_type): r for r in made.collect()}
    assert len(rows) == 8
    header = {r.page_id: dict(warc.fields(r.header.encode())) for r in sent.collect()}
    for (i, kind), r in rows.items():
        named = {h.name: h.value for h in r.headers}
        assert r.refers_to == named["WARC-Refers-To"] == header[i]["WARC-Record-ID"] and r.record_id != r.refers_to
        assert r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block) and named["WARC-Type"] == kind
        assert named["WARC-IP-Address"] == "192.0.2.1" and r.date == header[i]["WARC-Date"]
    assert bytes(rows[1, "conversion"].block).decode() == "A & B\nN\nÜber uns\nzwei\ndrei"
    told = json.loads(bytes(rows[1, "metadata"].block))
    assert told["title"] == "A & B" and told["links"] == [{"element": "a", "url": "/n?a=1&b=2"}] and told["metas"] == [{"name": "d", "content": "x"}]
    assert told["payload-digest"] == warc.digest(PAGE.encode()) == rows[1, "conversion"].payload_digest
    warc.write_warc(made, str(tmp_path / "w"))
    again = warc.read_warc(spark, str(tmp_path / "w")).collect()
    same([bytes(r.block) for r in again], [bytes(r.block) for r in rows.values()])


def test_warc_reads_members_and_codings():
    import gzip

    body = b"<p>caf\xe9</p>"
    packed = gzip.compress(body)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-A: b\r\n c\r\n\r\n" + f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha1:Q\r\nX-Own: kept\r\nContent-Length: " + str(len(http)).encode()
    record = head + b"\r\n\r\n" + http + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    split = list(warc.split_records(gzip.compress(record) + gzip.compress(other) + gzip.compress(record[:40])))
    assert [e for *_, e in split] == [None, None, "truncated"] and warc.derivatives(warc.fields(split[1][0]), split[1][1]) == []
    meta, text = warc.derivatives(warc.fields(split[0][0]), split[0][1])
    assert text["block"].decode() == "café" and text["payload_digest"] == "sha1:Q" and text["refers_to"] == "<urn:uuid:1>"
    assert {"name": "X-Own", "value": "kept"} in text["headers"] and ["X-A", "b c"] in json.loads(meta["block"])["http-headers"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == docs.columns
        if name == "exact dedup":
            assert after.count() == after.select("text").distinct().count() == before.select("text").distinct().count()
        if name == "SimHash near-dedup":
            group = {r.doc_id: r.component_id for r in simhash.near_dedup(before).collect()}
            same([r.doc_id for r in after.collect()], [min(d for d in group if group[d] == g) for g in set(group.values())])
        before = after
    assert {"doc_id", "ids", "n_tokens"} <= set(before.columns) and corpus_pipeline.run(spark, SF).count() == before.count()


@pytest.mark.parametrize("module", [exact_dedup, url_filter, line_dedup])
def test_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(module.ORACLE_SQL)
    got = module.query(spark, SF).select(want.columns)
    same([tuple(r) for r in got.collect()], [tuple(r) for r in want.fetchall()])
