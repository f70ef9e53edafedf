"""Toxicity by class-conditional Kneser-Ney character models.

Two interpolated Kneser-Ney models, of toxic and of ordinary texts, predict each character of a text from
the four before it. The highest orders have each class's own counts; the ``SHARED`` lowest, to which both
back off, have the continuation counts of the two classes together, so an expression that is rare in both
is about as likely in either and says nothing. What is compared is length-normalised: the mean
log-likelihood of a character in either class, and, because a few expressions make a long text toxic and
their ratio would drown in the noise of the rest, the part of the ratio that words give which are far
likelier in toxic texts, per character as well. Texts held back from the counts calibrate the score.

The models live in sorted arrays of n-gram keys with a column per class, are fitted on a bounded sample of
the labelled rows and are broadcast; every whole text of the corpus is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table
from loomspan.llm.language_id import classes, held, symbols

ORDER = 5
SHARED = 3  # lowest orders, whose counts are of both classes together
BITS = 12  # of a key for each character
BLANK = 1
HOLD_BACK = 5  # one training text in so many calibrates the score
EXCESS = (3.0, 6.0)  # nats by which a word must be likelier in toxic texts to count on its own
BATCH = 1 << 20  # characters scored at once
LEAST = 1e-7  # probability of a character never seen


@lru_cache(1)
def codes() -> np.ndarray:
    """Twelve bits for each code point: Latin, Greek, Cyrillic and their neighbours as they are, others folded."""
    points = np.arange(0x110000, dtype=np.uint64)
    return np.where(classes() == BLANK, BLANK, np.where(points < 0xC00, points, 0xC00 + points % 1021)).astype(np.uint64)


def sequence(text: str | None) -> np.ndarray:
    """Codes of the letters, single blanks between and around words; empty if there is no letter."""
    return codes()[symbols(text)] if text else np.empty(0, np.uint64)


def padded(seq: np.ndarray) -> np.ndarray:
    """With leading blanks, so that every character after the first blank is predicted once."""
    return np.concatenate([np.full(ORDER - 2, BLANK, np.uint64), seq])


def grams(seq: np.ndarray) -> np.ndarray:
    """Keys of the ``ORDER``-grams of a padded sequence, the predicted character in the lowest bits."""
    if len(seq) < ORDER:
        return np.empty(0, np.uint64)
    out = np.zeros(len(seq) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        out |= seq[ORDER - 1 - i : len(seq) - i] << np.uint64(BITS * i)
    return out


def suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << BITS * n) - 1)


@dataclass
class Model:
    """By order, 1 first: n-gram keys with log-probabilities, contexts with back-off weights; a column per class, toxic first."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    weights: np.ndarray  # of the calibration: a constant, then one for each feature

    def loglik(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each predicted character in either class."""
        out = np.zeros((len(keys), 2), np.float32)
        rest = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            at = np.minimum(np.searchsorted(self.keys[n - 1], keys), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == keys
            out[rest[hit]] += self.logp[n - 1][at[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if n > 1:
                ctx = keys >> np.uint64(BITS)
                at = np.minimum(np.searchsorted(self.contexts[n - 1], ctx), len(self.contexts[n - 1]) - 1)
                known = self.contexts[n - 1][at] == ctx
                out[rest[known]] += self.backoff[n - 1][at[known]]
                keys = suffix(keys, n - 1)
        out[rest] += np.float32(np.log(LEAST))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -500, 500)))


def counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct highest-order keys of the sequences with their counts, some million characters at a time."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(grams(padded(t)))
        size += len(t)
        if size >= BATCH or i == len(texts) - 1:
            more, n = np.unique(np.concatenate(part), return_counts=True)
            both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            keys, counts, part, size = both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64), [], 0
    return keys, counts


def kneser_ney(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Model:
    """Both models in shared arrays; below the highest order a count is of the distinct n-grams one longer."""
    own = [[counted(texts)] for texts in (toxic, ordinary)]  # highest order first
    for side in own:
        for n in range(ORDER - 1, 0, -1):
            side.append(np.unique(suffix(side[-1][0], n), return_counts=True))
        side.reverse()
    merged = [np.unique(np.concatenate([side[n][0] for side in own])) for n in range(ORDER)]
    shared = [np.unique(suffix(merged[n + 1], n + 1), return_counts=True) for n in range(SHARED)]  # the back-off counts
    model = Model([], [], [], [], np.zeros(1 + 1 + len(EXCESS)))
    for n in range(ORDER):
        keys = merged[n]
        contexts, of = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        logp, back = np.zeros((len(keys), 2)), np.zeros((len(contexts), 2))
        for c in (0, 1):
            k, seen = shared[n] if n < SHARED else own[c][n]
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, k)] = seen
            one, two = (count == 1).sum(), (count == 2).sum()
            cut = np.minimum(count, one / (one + 2 * two) if one and two else 0.5)
            total = np.bincount(of, count, len(contexts))
            free = np.where(total > 0, np.bincount(of, cut, len(contexts)) / np.maximum(total, 1), 1.0)
            below = np.full(len(keys), 1 / (len(keys) + 1)) if n == 0 else np.exp(model.logp[n - 1][np.searchsorted(model.keys[n - 1], suffix(keys, n)), c])
            logp[:, c] = np.log(np.maximum((count - cut) / np.maximum(total[of], 1) + free[of] * below, LEAST * LEAST))
            back[:, c] = np.log(np.maximum(free, LEAST))
        model.keys.append(keys)
        model.logp.append(logp.astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(back.astype(np.float32))
    return model


def features_of(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """For each sequence: characters, sums of both log-likelihoods, and of the words' ratios beyond each excess.

    A word of more than ``BATCH`` letters counts in parts.
    """
    out = np.zeros((len(seqs), 3 + len(EXCESS)))
    rows: list[int] = []
    parts: list[np.ndarray] = []
    sizes: list[int] = []

    def flush() -> None:
        if not parts:
            return
        flat = np.concatenate(parts)
        lik = model.loglik(flat)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(lik, begins, axis=0, dtype=np.float64)
        np.add.at(out, (rows, 0), sizes)
        np.add.at(out, (rows, 1), sums[:, 0])
        np.add.at(out, (rows, 2), sums[:, 1])
        # a word ends with the blank that is predicted after it
        ends = suffix(flat, 1) == np.uint64(BLANK)
        starts = np.zeros(len(flat), bool)
        starts[1:] = ends[:-1]
        starts[begins] = True
        first = np.flatnonzero(starts)
        ratio = np.add.reduceat(lik[:, 0] - lik[:, 1], first, dtype=np.float64)
        row = np.asarray(rows)[np.searchsorted(begins, first, side="right") - 1]
        for k, least in enumerate(EXCESS):
            out[:, 3 + k] += np.bincount(row, np.maximum(ratio - least, 0), len(out))
        rows.clear(), parts.clear(), sizes.clear()

    held_back = 0
    for i, s in enumerate(seqs):
        if len(s) < 2:
            continue
        keys = grams(padded(s))
        a = 0
        while a < len(keys):
            z = min(len(keys), a + BATCH)
            if z < len(keys):  # cut after a blank if there is one
                last = np.flatnonzero(suffix(keys[a:z], 1) == np.uint64(BLANK))
                z = a + int(last[-1]) + 1 if len(last) else z
            if held_back + z - a > BATCH:
                flush()
                held_back = 0
            rows.append(i)
            parts.append(keys[a:z])
            sizes.append(z - a)
            held_back += z - a
            a = z
    flush()
    return out


def normalised(sums: np.ndarray) -> np.ndarray:
    """What the score is made of, each per character: the ratio of the likelihoods and the words' excesses."""
    size = np.maximum(sums[:, :1], 1)
    return np.concatenate([sums[:, 1:2] - sums[:, 2:3], sums[:, 3:]], axis=1) / size


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on scaled features, by Newton's steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    w = np.zeros(z.shape[1])
    damp = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - damp @ w
        move = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + damp, slope)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model | float:
    """The models and their calibration; the share of toxic rows alone where one of the classes is missing.

    ``share`` is how much of all training rows is toxic: the sample's classes are weighted to it. Every
    ``HOLD_BACK``-th text of a class is held back, or none where there are too few.
    """
    seqs = [[s for t in texts if len(s := sequence(t))] for texts in (toxic, ordinary)]
    if not seqs[0] or not seqs[1]:
        return share
    enough = min(map(len, seqs)) >= 4 * HOLD_BACK
    learn = [[s for i, s in enumerate(side) if not enough or i % HOLD_BACK] for side in seqs]
    back = [side[::HOLD_BACK] if enough else side for side in seqs]
    model = kneser_ney(*learn)
    x = normalised(features_of(model, back[0] + back[1]))
    y = np.repeat([1.0, 0.0], [len(back[0]), len(back[1])])
    share = min(max(share, 0.001), 0.999)
    weight = np.where(y == 1, share / len(back[0]), (1 - share) / len(back[1])) * len(y)
    weights = calibrated(x, y, weight)
    if enough:  # counted anew with the texts that were held back
        model = kneser_ney(*seqs)
    model.weights = weights
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = 1500, ordinary: int = 3000, chars: int = 20_000, held_out: int = 2) -> Model | float:
    """Fit on a sample: at most ``toxic`` and ``ordinary`` labelled rows, the first ``chars`` characters of each.

    These three bounds cap what reaches the driver; a hash of the id decides which rows it holds, so
    refitting agrees. Rows whose crc32(id) mod 4 is ``held_out`` are not looked at, nor those without id,
    text or label; an id with several labels is toxic if one of them says so.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != held_out))
    known = usable.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_y"))
    seen = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    most = {1: toxic, 0: ordinary}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in most.items()]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # as many rows as the parameters say, at most
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.substring(F.col(text_col), 1, chars).alias("_t")).where("_t IS NOT NULL").join(sample, "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    texts: dict[int, list[str]] = {1: [], 0: []}
    for r in sorted(rows.collect(), key=lambda r: r["_id"]):
        texts[r["_y"]].append(r["_t"])
    return fit(texts[1], texts[0], seen.get(1, 0) / max(1, sum(seen.values())))


def scored(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, then what the score is made of.

    ``toxic_loglik`` and ``ordinary_loglik`` are nats per character, ``excess`` the sum per character of what
    words far likelier in toxic texts give; null for a null text or one without a letter, whose score is
    that of no evidence. A null id is not held out; repeated rows keep their number; other columns may have
    any names and are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                seqs = [sequence(t) for t in b.column(1).to_pylist()]
                none = np.array([len(s) == 0 for s in seqs])
                if isinstance(model, float):
                    score, parts = np.full(len(seqs), model), np.zeros((len(seqs), 3))
                    none[:] = True
                else:
                    sums = features_of(model, seqs)
                    x = normalised(sums)
                    score = model.score(x)
                    parts = np.concatenate([sums[:, 1:3] / np.maximum(sums[:, :1], 1), x[:, 1:2]], axis=1)
                made = [pa.array(score), *(pa.array(parts[:, k], mask=none) for k in range(3))]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "score", "toxic_loglik", "ordinary_loglik", "excess"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    made = rows.mapInArrow(run, "doc_id long, score double, toxic_loglik double, ordinary_loglik double, excess double")
    return made.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_loglik", "ordinary_loglik", "excess")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))


#: A trained model: tested by held-out accuracy and against a direct computation.
ORACLE_SQL = None
