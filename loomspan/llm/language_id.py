"""Language identification with interpolated Kneser-Ney character models.

A text is lower-cased, every run of characters that are not letters becomes one blank, and each
position is scored by the character before which up to ``ORDER`` - 1 characters stand. The models of
all languages live in one set of sorted arrays: per order, the sorted 64-bit keys of the n-grams seen
and, beside each key, one row of log-probabilities (or back-off weights) with a column per language.
A position is looked up at the highest order, those not found at the next lower one. The language
with the lowest cross-entropy per character wins. The model is fitted on a bounded sample of the
labelled rows; its arrays are bounded by that sample's characters and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import table

ORDER = 4
UNKNOWN = "und"
BATCH = 1 << 20  # characters scored at once
HOLD_BACK = 10  # one training text in so many calibrates the rejection


@lru_cache(1)
def classes() -> np.ndarray:
    """Code point to itself for letters, else 1, the blank."""
    return np.array([c if chr(c).isalpha() else 1 for c in range(0x110000)], np.uint32)


def symbols(text: str) -> np.ndarray:
    """Letters of the lower-cased text, runs of anything else as one blank, a blank at either end.

    Empty if the text has no letter.
    """
    got = classes()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = got == 1
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    got = got[keep]
    return got if len(got) > 1 else got[:0]


def grams(sym: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each position from ``ORDER`` - 1 on: 16 bits a character, the latest lowest.

    Code points beyond 16 bits are folded; the last character of a key is the one predicted.
    """
    s = (sym ^ (sym >> np.uint32(16)) * np.uint32(0x9E5)).astype(np.uint64) & np.uint64(0xFFFF)
    out = np.zeros(max(0, len(s) - ORDER + 1), np.uint64)
    for i in range(n):
        out |= s[ORDER - 1 - i : len(s) - i] << np.uint64(16 * i)
    return out


def padded(sym: np.ndarray) -> np.ndarray:
    """With leading blanks, so that every symbol after the first blank is predicted once."""
    return np.concatenate([np.full(ORDER - 2, 1, sym.dtype), sym])


@dataclass
class Model:
    """Sorted n-gram keys with a row of log-probabilities, and context keys with back-off weights."""

    langs: list[str]
    keys: list[np.ndarray]  # by order, 1 first
    logp: list[np.ndarray]
    contexts: list[np.ndarray]  # by order, contexts of the n-grams
    backoff: list[np.ndarray]
    floor: float  # log-probability of a character never seen
    ceiling: np.ndarray  # per language: cross-entropy above which a text is rejected

    def losses(self, sym: np.ndarray) -> np.ndarray:
        """Minus log-probability of every predicted symbol, a column per language."""
        out = np.zeros((max(0, len(sym) - ORDER + 1), len(self.langs)), np.float32)
        open_ = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            key = grams(sym, n)[open_]
            at = np.minimum(np.searchsorted(self.keys[n - 1], key), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == key
            out[open_[hit]] -= self.logp[n - 1][at[hit]]
            open_ = open_[~hit]
            if n > 1:
                ctx = key[~hit] >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.contexts[n - 1], ctx), len(self.contexts[n - 1]) - 1)
                hit = self.contexts[n - 1][at] == ctx
                out[open_[hit]] -= self.backoff[n - 1][at[hit]]
        out[open_] -= np.float32(self.floor)
        return out


def kneser_ney(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: keys and interpolated probabilities of the n-grams seen in the texts of one language,

    followed by the contexts with their interpolation weights. Orders below the highest use the number
    of distinct characters that stand before an n-gram in place of its count.
    """
    parts = [np.unique(np.concatenate([grams(padded(s), n) for s in texts]), return_counts=True) for n in range(1, ORDER + 1)]
    probs: list[tuple[np.ndarray, np.ndarray]] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        keys, counts = parts[n - 1]
        if n < ORDER:  # continuation counts
            inner = parts[n][0] & np.uint64((1 << 16 * n) - 1)
            keys, counts = np.unique(inner, return_counts=True)
        one, two = (counts == 1).sum(), (counts == 2).sum()
        cut = one / (one + 2 * two) if one and two else 0.5
        ctx, where, followers = np.unique(keys >> np.uint64(16) if n > 1 else np.zeros(len(keys), np.uint64), return_inverse=True, return_counts=True)
        total = np.bincount(where, counts, len(ctx))
        lam = cut * followers / total
        p = (counts - cut) / total[where]
        if n == 1:
            p = p + lam[where] / (len(keys) + 1)  # one share is left for characters never seen
        else:
            low = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 16 * (n - 1)) - 1))]
            p = p + lam[where] * low
        below = keys, p
        probs.append(below)
        weights.append((ctx, lam))
    return probs + weights


def fit(samples: dict[str, list[str]]) -> Model:
    """The models of all languages in shared sorted arrays, from up to some thousand texts each.

    Every ``HOLD_BACK``-th text is not learned from but calibrates when a text is rejected; languages
    with too few texts for that are calibrated on the texts learned from.
    """
    langs = sorted(samples)
    syms = {x: [s for t in samples[x] if len(s := symbols(t))] for x in langs}
    langs = [x for x in langs if syms[x]]
    enough = {x: len(syms[x]) >= 2 * HOLD_BACK for x in langs}
    by = {x: kneser_ney([s for i, s in enumerate(syms[x]) if not enough[x] or i % HOLD_BACK]) for x in langs}
    floor = float(np.log(1e-6))
    model = Model(langs, [], [], [], [], floor, np.full(len(langs), np.inf))
    for n in range(ORDER):
        keys = np.unique(np.concatenate([by[x][n][0] for x in langs]))
        ctxs = np.unique(np.concatenate([by[x][ORDER + n][0] for x in langs]))
        logp, back = np.zeros((len(keys), len(langs))), np.zeros((len(ctxs), len(langs)))
        for i, x in enumerate(langs):
            (k, p), (c, lam) = by[x][n], by[x][ORDER + n]
            back[np.searchsorted(ctxs, c), i] = np.log(lam)
            row = np.searchsorted(keys, k)
            if n:  # n-grams that only other languages have: this one's weight and its shorter n-gram
                low = np.minimum(np.searchsorted(model.keys[n - 1], keys & np.uint64((1 << 16 * n) - 1)), len(model.keys[n - 1]) - 1)
                found = model.keys[n - 1][low] == keys & np.uint64((1 << 16 * n) - 1)
                at = np.minimum(np.searchsorted(c, keys >> np.uint64(16)), len(c) - 1)
                own = np.where(c[at] == keys >> np.uint64(16), np.log(lam[at]), 0.0)
                logp[:, i] = own + np.where(found, model.logp[n - 1][low, i], floor)
            else:
                logp[:, i] = floor
            logp[row, i] = np.log(p)
        model.keys.append(keys)
        model.logp.append(logp.astype(np.float32))
        model.contexts.append(ctxs)
        model.backoff.append(back.astype(np.float32))
    # Calibration: a text is foreign to a language when its cross-entropy is far outside what texts of
    # that language show that the model has not seen, widened for short texts where the mean is loose.
    for i, x in enumerate(langs):
        own = np.array([model.losses(padded(s))[:, i].mean() for s in syms[x][:: HOLD_BACK if enough[x] else 1]])
        model.ceiling[i] = max(own.max(), own.mean() + 8 * own.std()) * 1.25 + 0.5
    return model


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, chars: int, held_out: int = 2) -> DataFrame:
    """The labelled rows that may be learned from: crc32(id) mod 4 is not ``held_out``, text and lang are there."""
    seen = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held(F.col(id_col), held_out), F.lit(False)))
    return seen.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, chars).alias("text"), F.xxhash64(id_col).alias("k"), F.col(id_col).alias("id"))


def held(id_col, remainder: int = 2):
    return F.crc32(id_col.cast("string")) % 4 == remainder


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, languages: int = 256, chars: int = 20_000) -> Model:
    """Fit on a sample: ``per_language`` rows of each of the ``languages`` most frequent labels, the

    first ``chars`` characters of each. These three bounds cap the sample that reaches the driver;
    which rows it holds is decided by a hash of the id, so refitting agrees.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, chars)
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not common:
        return Model([], [], [], [], [], 0.0, np.empty(0))
    # thinned by hash in one scan, to some four times the rows wanted, before the ranking looks at them
    part = {r["lang"]: int(min(1.0, 4 * per_language / r["count"]) * (1 << 20)) + 1 for r in common}
    limit = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])
    thin = rows.where(F.pmod("k", F.lit(1 << 20)) < F.try_element_at(limit, F.col("lang")))
    ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k", "id"))).where(F.col("n") <= per_language)
    picked: dict[str, list[str]] = {}
    for r in ranked.select("lang", "n", "text").orderBy("lang", "n").collect():
        picked.setdefault(r["lang"], []).append(r["text"])
    return fit(picked)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language and confidence of every whole text.

    Returns doc_id, held_out, lang_pred, score (0 to 1), entropy (nats per character under the chosen
    model, null if none) and rejected, then the ``keep`` columns. ``und`` with score 0 for a null text
    or one without a letter, and for every text if nothing could be learned; those are rejected, as are
    texts whose cross-entropy lies above the language's calibrated ceiling. The score is the chosen
    language's share in a softmax of the mean log-probabilities over 64 characters or the text's
    length, whichever is less. A null id is not held out. Repeated rows keep their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(0)
            means = np.full((len(texts), len(model.langs)), np.nan)
            sizes = np.zeros(len(texts), np.int64)
            rows, syms, held_chars = [], [], 0

            def flush():
                nonlocal rows, syms, held_chars
                if rows:
                    loss = model.losses(np.concatenate(syms))
                    # the n-grams that reach over a text's beginning are the first ORDER - 1 of it, but for the very first text
                    ends = np.cumsum([len(s) for s in syms]) - (ORDER - 1)
                    begins = np.append(0, ends[:-1] + ORDER - 1)
                    marks = np.stack([begins, ends], 1).ravel()
                    if marks[-1] == len(loss):
                        marks = marks[:-1]
                    means[rows] += np.add.reduceat(loss, marks, axis=0, dtype=np.float64)[::2]
                    rows, syms, held_chars = [], [], 0

            for i in range(len(texts)):
                t = texts[i].as_py()
                if not t or not model.langs:
                    continue
                s = symbols(t)
                if not len(s):
                    continue
                sizes[i], means[i] = len(s) - 1, 0
                s = padded(s)
                for a in range(0, len(s), BATCH):  # very long texts go in overlapping parts
                    part = s[max(0, a - ORDER + 1) : a + BATCH]
                    if len(part) < ORDER:
                        continue
                    if rows and (rows[-1] == i or held_chars + len(part) > BATCH):
                        flush()
                    rows.append(i)
                    syms.append(part)
                    held_chars += len(part)
            flush()
            known = sizes > 0
            means[known] /= sizes[known, None]
            best = np.zeros(len(texts), np.int64)
            entropy, score, rejected = np.full(len(texts), np.nan), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known.any():
                m = means[known]
                best[known] = m.argmin(axis=1)
                entropy[known] = m.min(axis=1)
                odds = np.exp(-(m - m.min(axis=1, keepdims=True)) * np.minimum(sizes[known], 64)[:, None])
                score[known] = 1 / odds.sum(axis=1)
                rejected[known] = entropy[known] > model.ceiling[best[known]]
            pred = [model.langs[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)]
            made = [pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, mask=~known), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[1:]], names=["lang_pred", "score", "entropy", "rejected", *b.schema.names[1:]])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    kinds = ", ".join(f"`_{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    made = rows.mapInArrow(run, "lang_pred string, score double, entropy double, rejected boolean, _id long" + (", " + kinds if kinds else ""))
    return made.select(F.col("_id").alias("doc_id"), F.coalesce(held(F.col("_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected", *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep) if c != id_col])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, with their own columns.

    Null texts and those without a letter are rejected; null and repeated ids are rows like others, and
    columns may have any names.
    """
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))
    found = predict(own, learn(docs), "_doc_id", "_text", ("doc",))
    return found.where("NOT rejected").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


#: A trained model: tested by held-out accuracy and against a direct computation.
ORACLE_SQL = None
