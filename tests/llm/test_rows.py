"""Rows whose ids are null or repeated, and small sources."""

import collections
import gzip
import hashlib
import json
import math
import random
import struct
import uuid

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import fingerprints, language_id, line_dedup, mixing, sentencepiece_scan, simhash, suffix_dedup, warc

SF = "/root/testdata/sf0.001"


def text_of(seed):
    return " ".join(f"{seed}word{i}" for i in range(30))


def test_simhash_stage_drops_rows(spark, tmp_path):
    rows = [(None, "a"), (5, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "c"), (9, "c"), (9, "d"), (1, "e"), (1, "e"), (2, "e"), (None, "f")]
    made = spark.createDataFrame([(i, text_of(t)) for i, t in rows], "doc_id long, text string")
    made.repartition(3).write.parquet(str(tmp_path / "d"))
    got = simhash.stage(spark, spark.read.parquet(str(tmp_path / "d")), SF)
    assert got.columns == ["doc_id", "text"]
    want = [(5, "a"), (None, "b"), (3, "c"), (9, "d"), (1, "e"), (None, "f")]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, text_of(t)) for i, t in want)


def test_mixing_of_small_sources(spark, tmp_path):
    """All but one source are capped at three times their words, and every source meets its target."""
    sizes = {"a": [10], "b": [20], "c": [100], "d": [33, 1, 0, 31], "e": [3000, 2000, 500]}
    rows = [(100 * i + j, " ".join(["w"] * n), s) for i, (s, own) in enumerate(sizes.items()) for j, n in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d"))).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert [taken[s] for s in "abcd"] == [30, 60, 300, 195]
    assert all(abs(taken[s] - target[s]) <= 1 + target[s] / 1000 for s in sizes) and sum(taken.values()) == 5695


def test_sentencepiece_chunks_meet_as_matrices():
    """Chunks cut anywhere, their matrices combined pairwise or one after another, traced apart: the library's ids."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    own = sentencepiece_scan.Pieces(sentencepiece_scan.read_model())
    rnd = random.Random(3)
    for letters in ("etaoin shrdlu", "ab", "abcdefghijklmnopqrstuvwxyz", " a▁", "é漢 -=.,x"):
        text = "".join(rnd.choice(letters) for _ in range(700))
        for size in (1, 9, 64, 333, 1000):
            chunks = list(own.chunks(text, size))
            own.rows = own.matrices = 0
            made = [own.matrix(w, a, z) for _, w, a, z in chunks]
            assert own.matrices == len(chunks) and own.rows >= len(chunks)
            states = sentencepiece_scan.chosen_states(made)
            ids = b"".join(own.trace(w, a, z, own.states(w, a)[x], own.states(w, z)[y]) for (_, w, a, z), x, y in zip(chunks, states, states[1:], strict=False))
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text)
            folded = made[0]
            for m in made[1:]:
                folded = sentencepiece_scan.combined(folded, m)
            tree = made
            while len(tree) > 1:
                tree = [sentencepiece_scan.combined(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
            assert np.array_equal(folded, tree[0])
    own.rows = 0
    own.encode("ordinary words of an ordinary text")
    assert own.rows >= 4  # a row, the whole matrix, for each new word


def test_sentencepiece_words_are_cut_and_kept(monkeypatch):
    """Signs are no part of the words before them, and words asked for lately outlast the others."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    own = sentencepiece_scan.Pieces(sentencepiece_scan.read_model())
    assert own.unit.findall(" tion&&& of,%%% x². a.b") == [" tion", "&&&", " of", ",%%%", " x².", " a", ".b"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(" aetionABé²³.,%&$#*!-_()\"'\n\t1▁中\U0001f600") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert [x.tolist() for x in own.encoded(texts)] == library.encode(texts)
    assert all("".join(own.unit.findall(t)) == t for t in texts)
    assert sentencepiece_scan.units(["ab", "a", "b"]).findall("ab ab!") == ["ab", " ab", "!"]
    monkeypatch.setattr(sentencepiece_scan, "WORDS", 8)
    own, made = sentencepiece_scan.Pieces(sentencepiece_scan.read_model()), []
    own.words.made = lambda w, f=own.words.made: made.append(w) or f(w)
    for k in range(20):
        assert next(own.encoded([f"often q{'abcdefghijklmnopqrst'[k]}z"])).tolist() == library.encode(f"often q{'abcdefghijklmnopqrst'[k]}z")
        assert len(own.words) <= 4 and len(own.words.aside) <= 4
    assert made.count(" often") == 1 and len(made) == 21


def test_sentencepiece_unigram_matrices():
    """With scores as weights the chunks of a document have the best sum, as a plain Viterbi does."""
    own = sentencepiece_scan.Pieces(sentencepiece_scan.read_model())
    own.bpe = False
    rnd = random.Random(4)
    for _ in range(12):
        text = "".join(rnd.choice("thenaiosr  ") for _ in range(rnd.randint(2, 300)))
        marked = own.marked(text)
        best = [0.0] + [-np.inf] * len(marked)
        for p in range(len(marked)):
            for node in own.nodes_at(marked, p):
                best[p + len(node)] = max(best[p + len(node)], best[p] + own.weight(node))
        made = [own.matrix(w, a, z) for _, w, a, z in own.chunks(text, 41)]
        states = sentencepiece_scan.chosen_states(made)
        assert sum(m[x, y] for m, x, y in zip(made, states, states[1:], strict=False)) == pytest.approx(best[-1])


def test_sentencepiece_of_nulls(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (1, None), (2, ""), (3, "word " * 500), (4, "x" * 700)]
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, lang string, source string, ids long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sentencepiece_scan.encode(docs, sentencepiece_scan.read_model(), keep=("lang",), part=100)
    assert got.columns == ["doc_id", "lang", "ids", "n_tokens"]
    back = sentencepiece_scan.decode(got, sentencepiece_scan.read_model(), keep=("doc_id", "lang"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in rows)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in sentencepiece_scan.decode(none, sentencepiece_scan.read_model()).collect()] == [""]
    assert sentencepiece_scan.stage(spark, docs, SF).count() == len(rows)


def test_line_dedup_goes_by_the_ratio_alone(spark):
    """A line on two of four pages is dropped, one on a single page of four is not; a large host is split."""
    rows = [(1, "a", ["two", "one"]), (2, "a", ["two", "x"]), (3, "a", ["y", "y"]), (4, "a", []), (None, "b", ["alone", None]), (5, None, None)]
    rows += [(i, "hot", ["menu", f"own {i}"]) for i in range(10, 4000)]
    pages = spark.createDataFrame(rows, "page_id long, host string, ls array<string>").repartition(3)
    got = {r.page_id: r for r in line_dedup.site_line_dedup(pages, F.col("ls"), F.col("host")).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["one", "x", "y\ny", ""]
    assert (got[None].text, got[None].n_lines, got[None].n_dropped) == ("", 1, 1) and (got[5].host, got[5].n_lines) == ("", 0)
    assert all(got[i].text == f"own {i}" and got[i].host_pages == 3990 for i in range(10, 4000)) and len(got) == len(rows)
    left = line_dedup.site_line_dedup(pages, F.col("ls"), F.col("host"), min_pages=2).where("host = 'b'").first()
    assert left.text == "alone" and left.n_dropped == 0


@pytest.mark.parametrize("cluster", [1024, 3])
def test_mixing_takes_what_blocks_say(spark, tmp_path, cluster):
    """Every document's taken words and copies, counted word by word over the blocks of its shard."""
    rnd = random.Random(cluster)
    rows = [(i if i % 17 else None, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 200])), rnd.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for i in range(400)]
    rows += rows[5:8]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.mix(docs, block=16, shard_rows=12, cluster=cluster).collect()
    ids = F.coalesce("doc_id", F.lit(-1))
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", key.alias("key"), F.regexp_count("text", F.lit(mixing.WORD)).alias("size"), F.xxhash64(ids, F.lit(7)).alias("order")).withColumn("deal", F.xxhash64(ids, F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.col("size").cast("long")), F.lit(8))).collect()
    per = collections.defaultdict(list)
    for r in own:
        per[r.key].append(r)
    names = sorted(per, key=lambda k: (k == "-", k.encode()))
    total = [sum(r.size for r in per[k]) for k in names]
    target = mixing.fill(np.array([mixing.WEIGHTS[i % 3] for i in range(len(names))]), 3.0 * np.array(total), float(sum(total)))
    quota = mixing.apportion(target, sum(total), 3 * np.array(total))
    want = {}
    for k, q in zip(names, quota.tolist(), strict=True):
        n = -(-len(per[k]) // 12)
        shards = [sorted((r for r in per[k] if r.deal % n == s), key=lambda r: (r.order, r.doc_id is not None, r.doc_id or 0, r.row)) for s in range(n)]
        used = [s for s in range(n) if shards[s]]
        words = {s: sum(r.size for r in shards[s]) for s in used}
        clusters = sorted({s // cluster for s in used})
        held = [sum(words[s] for s in used if s // cluster == c) for c in clusters]
        for c, cq in zip(clusters, mixing.apportion(np.array(held), q, 3 * np.array(held)).tolist(), strict=True):
            mine = [s for s in used if s // cluster == c]
            sizes = np.array([words[s] for s in mine])
            for s, sq in zip(mine, mixing.apportion(sizes, cq, 3 * sizes).tolist(), strict=True):
                h = spark.range(1).select(F.xxhash64(F.lit(s), F.lit(k), F.lit(7)), F.xxhash64(F.lit(k), F.lit(s), F.lit(7))).first()
                w = words[s]
                taken = np.zeros(w, int)
                if w:
                    n_blocks = max(1, int(np.floor(w / 16 + 0.5)))
                    taken += sq // w
                    left = sq % w
                    whole = left * n_blocks // w
                    rest = left - whole * w // n_blocks
                    order = sorted(range(n_blocks), key=lambda b: (mixing.STEPS[h[0] % len(mixing.STEPS)] * b + h[1]) % n_blocks)
                    for i, b in enumerate(order[: whole + 1]):
                        a, z = b * w // n_blocks, (b + 1) * w // n_blocks
                        taken[a : z if i < whole else min(z, a + rest)] += 1
                at = 0
                for r in shards[s]:
                    want[r.row] = int(taken[at : at + r.size].sum()), int(taken[at]) if r.size else 0
                    at += r.size
    assert {r.row: (r.taken, r.copies) for r in got} == want
    assert sum(r.taken for r in got) == pytest.approx(sum(total), abs=2 * len(names) * 40)


def test_mixing_steps_are_primes():
    assert all(pow(b, p - 1, p) == 1 for p in mixing.STEPS for b in (2, 3, 5, 7, 11, 13))


def test_mixing_stage_of_awkward_rows(spark, tmp_path):
    rows = [(None, "a b", "x", 1), (None, "a b", "x", 1), (2, None, None, 2), (2, "c " * 90, None, 2), (3, "", "y", 3), (4, "d " * 50, "y", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _row long").select("doc_id", "text", "source", F.col("_row").alias("size")).write.parquet(str(tmp_path / "d"))
    got = mixing.stage(spark, spark.read.parquet(str(tmp_path / "d")), SF)
    assert got.columns == ["doc_id", "text", "source", "size"]
    count = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert count and set(count) <= {(i, t) for i, t, *_ in rows if t} and all(v <= 3 * sum(1 for r in rows if r[:2] == k) for k, v in count.items())
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.stage(spark, empty, SF).count() == 0


def test_language_ceilings_come_from_texts_not_learned():
    """The held-back texts alone decide the ceilings, and a text in none of the languages is above them."""
    rnd = random.Random(11)
    speak = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(60))
    samples = {"a": [speak(["the", "an", "er", "ing"]) for _ in range(60)], "b": [speak(["ou", "eau", "que", "les"]) for _ in range(60)]}
    model = language_id.fit(samples)
    learned = [x for i, x in enumerate(samples["a"]) if i % language_id.HOLD_BACK]
    alone = language_id.kneser_ney([language_id.symbols(t) for t in learned])
    # what is in the arrays comes from the learned texts only
    assert set(alone[3][0].tolist()) <= set(model.keys[3].tolist())
    held = np.array([model.losses(language_id.padded(language_id.symbols(t)))[:, 0].mean() for t in samples["a"][:: language_id.HOLD_BACK]])
    assert model.ceiling[0] == pytest.approx(max(held.max(), held.mean() + 8 * held.std()) * 1.25 + 0.5)
    foreign = model.losses(language_id.padded(language_id.symbols("zxkw vvrq jjpf xkcd " * 5))).mean(axis=0)
    assert (foreign > model.ceiling).all()


def test_language_stage_of_awkward_rows(spark, tmp_path):
    train = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, "x") for r in train] + [(None, train[0].text, None, "x")] * 2 + [(train[0].doc_id, train[0].text, "en", "x"), (901, None, "en", "x"), (902, "", "en", "x"), (903, "12 !", None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = language_id.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(rows[:-3])


def record(block, length=None, name="response"):
    return f"WARC/1.0\r\nWARC-Type: {name}\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_warc_goes_on_after_broken_records(packed):
    """One record without a length and one that is cut short do not cost the others."""
    http = b"HTTP/1.1 200 OK\r\n\r\n<p>x</p>"
    made = [record(http), record(http, "many"), record(http), record(b"hi", 20), record(b"WARC/1.0 within a block\r\n\r\nWARC/"), record(b""), record(http)[:60]]
    data = b"".join(gzip.compress(x) for x in made) if packed else b"".join(made)
    got = [(block, error) for _, block, error in warc.split_records(data)]
    assert got == [(http, None), (http, "no length"), (http, None), (b"hi", "truncated"), (b"WARC/1.0 within a block\r\n\r\nWARC/", None), (b"", None), (b"", "truncated")]
    assert list(warc.split_records(b"")) == [] and list(warc.split_records(b"no records here")) == []
    if packed:
        broken = gzip.compress(made[0]) + gzip.compress(made[2])[:-30] + gzip.compress(made[5])
        assert [e for *_, e in warc.split_records(broken)][0] is None and list(warc.split_records(broken))[-1][1:] == (b"", None)


def test_warc_bounds_what_it_unpacks(monkeypatch):
    monkeypatch.setattr(warc, "UNPACKED", 1000)
    small, large = gzip.compress(b"a" * 1000), gzip.compress(b"a" * 1001)
    headers = [("Content-Encoding", "gzip")]
    assert warc.decoded(small, headers) == b"a" * 1000 and warc.decoded(large, headers) == large
    assert warc.decoded(small[:-9], headers) == small[:-9] and warc.decoded(b"", headers) == b""


def test_warc_query_by_a_direct_computation(spark):
    """Ids, links between records and digests of the registered query, computed anew from the pages."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = warc.query(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r.page_id]
        payload = page.html.encode()
        origin = f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{r.page_id} {page.url}'.encode()).hexdigest())}>"
        assert r.refers_to == origin and r.target_uri == page.url
        assert r.record_id == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.warc_type} {origin}')}>"
        assert r.payload_digest == warc.digest(payload) and r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        named = {h["name"]: h["value"] for h in json.loads(r.headers)}
        assert named["WARC-Refers-To"] == origin and named["WARC-IP-Address"] == "192.0.2.1" and named["WARC-Block-Digest"] == r.block_digest


def test_warc_of_nulls_and_repeated_rows(spark):
    header, block = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x"
    rows = [(1, header, block, "k"), (1, header, block, "k"), (None, header, None, "k"), (3, None, block, "k"), (4, None, None, None)]
    made = warc.build_derivatives(spark.createDataFrame(rows, "id long, header string, block binary, refers_to string"), "id").collect()
    assert collections.Counter((r.source_id, r.warc_type) for r in made) == {(1, "metadata"): 2, (1, "conversion"): 2, (None, "metadata"): 1}
    assert len({r.record_id for r in made if r.source_id == 1}) == 2


def chained(*values):
    """The engine's hash of several values: each hashed with the hash of those before as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<d", v) if isinstance(v, float) else int(v[0]).to_bytes(v[1], "little", signed=True), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_samples_are_the_least_of_all_draws(spark):
    """Every draw of every term from its hashes, and every sample as the digest of the least draw."""
    rnd = random.Random(12)
    texts = ["", " \t ", "a", "a a a b", *(" ".join(rnd.choice(["ab", "cd", "é", "漢", "x", "y", "zz"]) for _ in range(n)) for n in (3, 30, 200))]
    size = 7
    found = {r.k: r["sample"] for r in fingerprints.signatures(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"], "text", size).collect()}
    counts = [collections.Counter(t.split() or [""]) for t in texts]
    pairs = sorted({(w, n) for c in counts for w, n in c.items()})
    rows = [(w, n, signed(chained(w, (0, 4)))) for w, n in pairs]
    made = spark.createDataFrame(rows, "w string, n int, term long").select("w", "n", "term", F.xxhash64("w", F.lit(0)).alias("again"), F.array(*[fingerprints.slot(F.col("term"), F.log(F.col("n").cast("double")), k) for k in range(size)]).alias("draws")).collect()
    draws = {}
    for r in made:
        assert r.term == r.again
        for k, draw in enumerate(r.draws):
            h, g = chained((r.term, 8), (2 * k, 4)), chained((r.term, 8), (2 * k + 1, 4))
            u = lambda x, low, bits: ((x >> low & (1 << bits) - 1) + 0.5) / (1 << bits)
            gamma, c, b = -math.log(u(h, 0, 21) * u(h, 21, 21)), -math.log(u(g, 0, 32) * u(g, 32, 32)), u(h, 42, 22)
            level = math.floor(math.log(r.n) / gamma + b)
            assert draw == pytest.approx(math.log(c) - gamma * (level - b + 1), rel=1e-9, abs=1e-9)
        draws[r.w, r.n] = r.draws
    for i, c in enumerate(counts):
        assert found[i] == [chained(min(draws[w, n][k] for w, n in c.items())) & 0xFFFFFFFF for k in range(size)]


def test_mixing_deals_rows_without_id_over_shards(spark, tmp_path):
    """One id on all rows, or none: many shards all the same, and the quota whole but for a word a shard."""
    rows = [(None, " ".join(["w"] * (1 + i % 40)), "a") for i in range(600)] + [(7, " ".join(["w"] * (1 + i % 40)), "b") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d")), shard_rows=20).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30 and all(r.taken <= 3 * r.size for r in own)


def test_suffix_buckets_of_one_passage_are_dealt(spark, tmp_path, monkeypatch):
    """Many texts with their own beginnings and ends around one passage: the same removals, no bucket with a row of each."""
    rnd = random.Random(7)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage, other = own(1500), own(700)
    texts = [own(rnd.randrange(100, 300)) + passage + own(rnd.randrange(100, 300)) for _ in range(300)]
    texts += [own(150) + other[:650] + own(100), own(90) + other + own(100), other] + texts[:3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    length = 400
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {}
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        want[k] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest())
    for runs in (suffix_dedup.RUNS, 900):
        monkeypatch.setattr(suffix_dedup, "RUNS", runs)
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    monkeypatch.undo()
    run, schema = suffix_dedup.runs_of(length, suffix_dedup.WINDOW)
    raw = docs.select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    largest = raw.mapInArrow(run, schema).groupBy("shared").count().agg(F.max("count")).first()[0]
    assert largest <= suffix_dedup.KINDS * raw.rdd.getNumPartitions()


@pytest.mark.parametrize("by", ["query", "operator"])
def test_suffix_rows_keep_their_numbers_when_splits_change(spark, tmp_path, by):
    """Cores that join between the two reads of the table change its splits, not the removals."""
    rnd = random.Random(11)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = own(450)
    edge = lambda i: chr(33 + i // 3)  # noqa: E731 (no two passages have the same neighbours)
    texts = [own(60_000) + edge(i) + (passage if i % 3 == 0 else "") + edge(i) + own(100) for i in range(60)] + [None, "", passage]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "documents.parquet")
    made.write.option("parquet.block.size", 400_000).option("parquet.page.size", 50_000).option("compression", "uncompressed").parquet(path)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1000)
        spark.conf.set("spark.sql.files.minPartitionNum", 2)
        few = spark.read.parquet(path).rdd.getNumPartitions()
        found = suffix_dedup.query(spark, str(tmp_path)) if by == "query" else suffix_dedup.remove_repeats(spark.read.parquet(path))
        spark.conf.set("spark.sql.files.minPartitionNum", 7)
        assert spark.read.parquet(path).rdd.getNumPartitions() > few
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: (len(t or ""), 450 * (passage in (t or "")), int(passage in (t or ""))) for i, t in enumerate(texts)}
