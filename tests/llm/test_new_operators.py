"""Incremental aggregates, toxicity and hard negatives against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import maintenance, negatives, toxicity
from loomspan.llm.language_id import symbols

SF = "/root/testdata/sf0.001"


# -- incremental aggregates


def states(lives, batches):
    """batch -> group -> the six aggregates, by looking at all lives of a group in every batch."""
    out = {}
    for t in range(batches):
        by = collections.defaultdict(list)
        for g, item, v, begin, end in lives:
            by[g] += [(item, v)] if begin <= t and (end is None or t < end) else []
        out[t] = {}
        for g, rows in by.items():
            values = sorted(v for _, v in rows if v is not None)
            out[t][g] = (len(rows), len({i for i, _ in rows if i is not None}), sum(values), *((values[0], values[-1], values[len(values) // 2]) if values else (None, None, None)))
    return out


def expected_changes(lives, batches):
    after, none = states(lives, batches), (0, 0, 0, None, None, None)
    out = []
    for t in range(batches):
        for g in {x[0] for x in lives}:
            old, new = after[t - 1].get(g, none) if t else none, after[t].get(g, none)
            if old != new:
                out.append((t, g, *[x for pair in zip(old, new) for x in pair]))
    return out


def changes_of(spark, lives, batches):
    rows = spark.createDataFrame([(*x, 0, "x") for x in lives], "g string, item string, value long, begin int, end int, batch int, k string").repartition(3)
    found = maintenance.maintained(rows, ["g"], batches)
    names = [f"{a}_{n}" for n in maintenance.NAMES for a in ("old", "new")]
    return [tuple(r) for r in found.select("batch", "g", *names).collect()]


def test_aggregates_of_random_lives(spark):
    rnd = random.Random(1)
    lives = []
    for _ in range(1500):
        begin = rnd.randrange(8)
        value = rnd.choice([None, 7, 7, 7, rnd.randrange(50), rnd.randrange(-9000, 100_000), rnd.choice([2**62, -(2**62) // 512])])
        lives.append((rnd.choice(["a", "a", "b", ""]), rnd.choice([None, "", "i", str(rnd.randrange(40))]), value if value is None or abs(value) < 2**40 or rnd.random() < 0.002 else 5, begin, rnd.choice([None, begin, begin + 1, begin + 3, 12])))
    lives += lives[:200]
    lives += [("only null", "x", None, 2, 4), ("late", "x", 3, 8, None), ("touch", "x", 1, 1, 3), ("touch", "x", 1, 3, 5), ("never", "y", 1, 2, 2)]
    got, want = changes_of(spark, lives, 8), expected_changes(lives, 8)
    assert collections.Counter(got) == collections.Counter(want)


def test_any_rank_by_distributed_descent(spark):
    """Small stretches, so that ranks go down through the tables of nodes first."""
    rnd = random.Random(2)
    lives = [("g", None, rnd.choice([rnd.randrange(-300, 300), rnd.randrange(10**6), -(10**12), 10**15, 4]), begin, begin + rnd.choice([1, 2, 9])) for begin in range(5) for _ in range(200)]
    rows = spark.createDataFrame(lives, "g string, item string, value long, begin int, end int")
    elements = maintenance.elements_of(rows, ["g"], 5).cache()
    asked, want = [], {}
    for t in range(5):
        values = sorted(v for _, _, v, begin, end in lives if begin <= t < end)
        for k in [0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1]:
            asked.append(("g", t, f"k{k}", k))
            want[t, f"k{k}"] = values[k]
    asked = spark.createDataFrame(asked, "g string, batch int, name string, k long")
    for stretch in (4, 100, 10**6):
        got = {(r["batch"], r["name"]): r["value"] for r in maintenance.ranked(elements, asked, ["g"], 5, stretch).collect()}
        assert got == want


def test_wavelet_matrices_select():
    rnd = np.random.default_rng(3)
    for codes in (1, 2, 7, 64):
        bits = (codes - 1).bit_length()
        entered, weight = rnd.integers(0, codes, 200), rnd.integers(1, 4, 200)
        left = entered[:100]
        pair = (maintenance.WaveletMatrix(entered, weight, bits), np.array([200])), (maintenance.WaveletMatrix(left, weight[:100], bits), np.array([100]))
        present = np.sort(np.repeat(entered[100:], weight[100:]))
        for k in (0, len(present) // 2, len(present) - 1):
            assert maintenance.select(*pair, bits, np.array([k]))[0] == present[k]


def test_aggregates_query_on_rows_and_nothing(spark, tmp_path):
    """Null ids, texts, sources and sizes, repeated rows; an empty table."""
    rows = [(None, "a", None, None, 3), (None, None, "en", "s", None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (7, "same", "en", "s", 9), (8, "same", "en", "s", -4), (9, "x" * 10_000, None, "s", 10_000)]
    rows += [(i, f"t{i % 9}", "en", "s", i % 5) for i in range(100, 160)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, batch int, value string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    lives = []
    for i, text, lang, source, n in rows:
        h = zlib.crc32(("" if i is None else str(i)).encode())
        b, q = h % 20, h // 20 % 4
        group = (source or "", lang or "")
        lives.append((group, text, n, b, b + q))
        if q % 3 == 0:
            lives.append((group, text, None if n is None else n + q, b + q, None))
    names = [f"{a}_{n}" for n in maintenance.NAMES for a in ("old", "new")]
    got = [tuple(r) for r in maintenance.query(spark, str(tmp_path)).select("batch", "source", "lang", *names).collect()]
    assert collections.Counter(got) == collections.Counter((t, *g, *rest) for t, g, *rest in expected_changes(lives, 20))
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert maintenance.query(spark, str(tmp_path / "none")).count() == 0


# -- toxicity


def padded_symbols(text):
    return [1] * (toxicity.ORDER - 2) + [int(x) for x in toxicity.codes()[symbols(text)]]


def plain_model(toxic, ordinary):
    """(class, n-gram) -> probability, by recursion over dictionaries of counts."""
    tops = []
    for texts in (toxic, ordinary):
        count = collections.Counter()
        for t in texts:
            s = padded_symbols(t)
            count.update(tuple(s[i : i + toxicity.ORDER]) for i in range(len(s) - toxicity.ORDER + 1))
        tops.append(count)
    levels = [{toxicity.ORDER: top} for top in tops]
    for c in (0, 1):
        for n in range(toxicity.ORDER - 1, 0, -1):
            levels[c][n] = collections.Counter(g[1:] for g in levels[c][n + 1])
    for n in range(1, toxicity.SHARED + 1):
        both = set(levels[0][n + 1]) | set(levels[1][n + 1])
        for c in (0, 1):
            levels[c][n] = collections.Counter(g[1:] for g in both)

    def discount(c, n):
        one, two = (sum(v == k for v in levels[c][n].values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    contexts = [{n: collections.defaultdict(list) for n in range(1, toxicity.ORDER + 1)} for _ in (0, 1)]
    for c in (0, 1):
        for n in contexts[c]:
            for g, v in levels[c][n].items():
                contexts[c][n][g[:-1]].append(v)
    cut = [{n: discount(c, n) for n in range(1, toxicity.ORDER + 1)} for c in (0, 1)]

    def p(c, g):
        n = len(g)
        if n == 0:
            return 1 / (len(levels[c][1]) + 1)
        if n == 1 and g not in levels[c][1]:
            return toxicity.LEAST
        seen = contexts[c][n].get(g[:-1])
        low = p(c, g[1:])
        if not seen:
            return low
        d = cut[c][n]
        return max(levels[c][n].get(g, 0) - d, 0) / sum(seen) + sum(min(v, d) for v in seen) / sum(seen) * low

    return p


def test_models_equal_dictionaries():
    rnd = random.Random(4)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))
    toxic = [" ".join(word("abcdé") for _ in range(30)) for _ in range(5)]
    ordinary = [" ".join(word("abcdfß漢") for _ in range(30)) for _ in range(6)]
    model = toxicity.kneser_ney([toxicity.sequence(t) for t in toxic], [toxicity.sequence(t) for t in ordinary])
    p = plain_model(toxic, ordinary)
    for text in ("ab cd", toxic[0], ordinary[0], "zz ab zz", "ABé,ab"):
        s = padded_symbols(text)
        got = model.loglik(toxicity.grams(toxicity.padded(toxicity.sequence(text))))
        for i in range(len(s) - toxicity.ORDER + 1):
            for c in (0, 1):
                assert got[i, c] == pytest.approx(math.log(p(c, tuple(s[i : i + toxicity.ORDER]))), abs=1e-3)
        sums = toxicity.features_of(model, [toxicity.sequence(text), toxicity.sequence("")])
        assert sums[0, 0] == len(s) - toxicity.ORDER + 1 and not sums[1].any()
        assert sums[0, 1] == pytest.approx(got[:, 0].sum(), abs=1e-2)


def test_words_far_likelier_in_toxic_texts_are_summed(monkeypatch):
    seqs = [toxicity.sequence(t) for t in ("idiot idiot", "plain words here")]
    model = toxicity.kneser_ney([seqs[0]] * 3, [seqs[1]] * 3)
    texts = ["plain idiot words", "here here", "idiotic " * 50, "", "x" * 300]
    whole = toxicity.features_of(model, [toxicity.sequence(t) for t in texts])
    for i, t in enumerate(texts):
        keys = toxicity.grams(toxicity.padded(toxicity.sequence(t)))
        if not len(keys):
            continue
        ratio = model.loglik(keys)
        ratio = ratio[:, 0] - ratio[:, 1]
        ends = [k for k, x in enumerate(keys) if int(x) & 4095 == 1]
        words = [ratio[a:z].sum() for a, z in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends])]
        for k, least in enumerate(toxicity.EXCESS):
            assert whole[i, 3 + k] == pytest.approx(sum(max(0, w - least) for w in words), abs=1e-2)
    monkeypatch.setattr(toxicity, "BATCH", 17)  # parts end with words
    assert np.allclose(toxicity.features_of(model, [toxicity.sequence(t) for t in texts[:4]]), whole[:4], atol=1e-2)


def toxic_corpus(spark, folder, n=240):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "ou", "re"]) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rnd.choice(["zogwort", "blikfrap"]) if bad and rnd.random() < 0.08 else word() for _ in range(rnd.randint(40, 120))]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, int(bad)))
    rows += [(None, "zogwort " * 5, "en", None), (1000, None, None, None), (1001, "", "en", "s"), (1002, "123 --", "en", "s"), (1003, "zogwort " + f"{rows[1][1]} {rows[2][1]} " * 300, "en", "s"), rows[0], rows[0]]
    labels += [(1000, 1), (None, 1), (3, None), (6, 0)]  # no text, no id, no label, two labels
    spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, source string, score double, _t string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return rows, dict(labels[:n])


def test_toxicity_query(spark, tmp_path):
    rows, labels = toxic_corpus(spark, str(tmp_path))
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    right = 0
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        right += r.predicted == labels.get(r.doc_id) if held else 0
    total = sum(r.doc_id in labels for r in got if r.held_out)
    assert total > 40 and right >= 0.97 * total
    of = {r.doc_id: r for r in got}
    assert of[None].predicted == 1 and of[1000].score == of[1001].score == of[1002].score and of[1001].predicted == 0
    assert of[1000].toxic_loglik is None and of[1003].toxic_loglik is not None and of[1003].predicted == 0


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.learn(docs, one)).collect()} == {1.0}
    none = docs.where("false")
    assert toxicity.scored(none, toxicity.learn(none, labels)).count() == 0


# -- hard negatives


def plain_negatives(rows):
    """By sorting all rows for every anchor."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        rest = sorted((-dot(v, w), j is None, j or 0, m, j, other) for m, (j, other, w) in enumerate(kept) if m != n)
        for s, *_, j, _ in [x for x in rest if x[-1] == label][:5]:
            fit = [(-t, k) for t, *_, k, other in rest if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fit, 1)]
    return out


def mine(spark, rows, path):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, cell string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(map(tuple, negatives.query(spark, str(path)).select(names).collect()))


def test_hard_negatives_of_awkward_rows(spark, tmp_path):
    rnd = np.random.default_rng(7)
    vectors = np.float32(rnd.normal(size=(900, 6)) * 0.3)
    rows = [(i, [float(x) for x in v], int(rnd.integers(10))) for i, v in enumerate(vectors)]
    same = [float(x) for x in vectors[100]]
    rows += [(1000 + i, same, i % 2) for i in range(300)]  # one vector on a quarter of the rows
    rows += [(200, rows[200][1], rows[200][2]), (200, rows[200][1], rows[200][2]), (300, same, 3)]  # an anchor three times, an id on two rows
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 1), (2400, same, None), (None, same, 1), (None, same, 2), (2500, [], 1), (2600, [0.5, 0.5], 4)]
    assert mine(spark, rows, tmp_path) == collections.Counter(plain_negatives(rows))


def test_hard_negatives_of_clusters_and_nothing(spark, tmp_path):
    """Tight clusters: groups are copied part of the blocks only, and the result is whole."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(12, 8)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rnd.normal(size=8) * 0.05], i // 12 % 3) for i in range(2400)]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert mine(spark, rows, tmp_path / "a") == collections.Counter(plain_negatives(rows))
    assert not mine(spark, [r for r in rows if r[0] % 100], tmp_path / "b")
    empty = spark.createDataFrame([], "vec_id long, label long, vector array<int>")
    assert negatives.mined(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_that_no_group_wants_are_not_copied(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, 0, [1000 * (i % 2), int(rnd.integers(5)), 7]) for i in range(600)]
    made = spark.createDataFrame([(i, i, label, v, float(sum(x * x for x in v))) for i, label, v in rows], "row long, vec_id long, label long, vector array<int>, norm double").cache()
    space = negatives.Space(made, 16)
    cells = negatives.blocks(made, space, True)
    assert cells.agg(F.sum("n")).first()[0] == 600
    back = sorted(x for r in cells.collect() for x in negatives.unpacked(r.rows)[1])
    assert back == list(range(600))
    anchors = made.where("vec_id = 1").select("row", "vec_id", "label", "vector").withColumn("asks", F.array().cast("array<struct<positive_id:bigint,score:bigint>>"))
    found = negatives.first_positives(cells, anchors, space, 5)
    assert found.count() == 5
    groups = spark.createDataFrame([(0, 0, bytearray(b""))], "label long, grp long, rows binary")
    wanted = spark.createDataFrame([(0, 0, c, 0.0, 50.0, 0.0) for c in range(16)], "label long, grp long, cell int, lo double, hi double, far double")
    near = negatives.met(groups, wanted, cells, ["label", "cell"]).where("side = 1").count()
    assert near == cells.where("lo <= 50").count() and negatives.met(groups, wanted.withColumn("far", F.lit(1e9)), cells, ["label", "cell"]).where("side = 1").count() == 0


def test_products_are_exact_or_refused():
    a = np.array([[2**31 - 1, -(2**31)]], np.int32)
    assert negatives.products(a[:, :1], a[:, :1]).tolist() == [[(2**31 - 1) ** 2]]
    with pytest.raises(OverflowError):
        negatives.products(a, a)
