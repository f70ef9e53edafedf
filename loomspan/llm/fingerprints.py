"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by their number. For each of ``size`` slots every term draws
r and c from Gamma(2, 1) and b from the unit interval, all by hashes of term and slot alone. With
weight S it takes the level t = floor(ln S / r + b) and the value ln a = ln c - r (t - b + 1); the least
value over all terms is the text's sample of the slot. Two texts have the same sample exactly when the
same term at the same level is least in both, which happens with the generalised Jaccard similarity of
their weights as probability; the value itself names that pair, so keeping the minimum suffices and
each slot is one partial aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import shared_checkpoint, table

SLOTS = 32
BLANKS = " \t\n\x0b\x0c\r"


def slot(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a term in slot k; a Gamma(2, 1) draw is minus the logarithm of two uniform draws' product."""
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u = lambda x, low, bits: (F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + F.lit(0.5)) * F.lit(0.5**bits)
    r, b = -F.log(u(h, 0, 21) * u(h, 21, 21)), u(h, 42, 22)
    level = F.floor(log_weight / r + b)
    return F.log(-F.log(u(g, 0, 32) * u(g, 32, 32))) - r * (level - b + 1)


def words_of(text: Column) -> Column:
    """Words; of a text without any, the empty one."""
    return F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")


def least_values(terms: DataFrame, keys: list[str], size: int, *more: Column) -> DataFrame:
    """``keys`` and sample, an array of ``size`` 32-bit numbers, from rows of ``keys`` and _term, one per occurrence."""
    terms = terms.groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
    terms = terms.select(*keys, "_term", F.log(F.col("_n").cast("double")).alias("_log"))
    least = terms.groupBy(*keys).agg(*[F.min(slot(F.col("_term"), F.col("_log"), k)).alias(f"_s{k}") for k in range(size)], *more)
    names = [c for c in least.columns if not c.startswith("_s")]
    return least.select(*names, F.array(*[F.xxhash64(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(size)]).alias("sample"))


def signatures(texts: DataFrame, keys: list[str], text: str, size: int = SLOTS, seed: int = 0) -> DataFrame:
    """``keys`` and sample, one row per distinct ``keys``.

    No exchange is needed where ``texts`` is already dealt by a part of ``keys``.
    """
    words = texts.select(*keys, F.explode(words_of(F.col(text))).alias("_word"))
    return least_values(words.select(*keys, F.xxhash64("_word", F.lit(seed)).alias("_term")), keys, size)


def likeness(a: str, b: str, size: int = SLOTS) -> Column:
    """The share of slots with the same sample."""
    return reduce(lambda x, y: x + y, [(F.get(F.col(a), F.lit(k)) == F.get(F.col(b), F.lit(k))).cast("int") for k in range(size)]) / F.lit(float(size))


def written(sample: str) -> Column:
    """The sample as one string, eight hex digits a slot."""
    return F.array_join(F.transform(F.col(sample), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def successors(rows: DataFrame) -> DataFrame:
    """(row, next_row) in descending doc_id, nulls last and ties by row, the first after the last.

    ``rows`` has (row, doc_id). Sorted in ranges; what crosses from one range to the next is one row
    per range.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    dealt = shared_checkpoint(rows.select("row", "doc_id").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("next_row", F.lead("row").over(Window.partitionBy("part").orderBy(*order)))
    heads = dealt.groupBy("part").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "row")).alias("head"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(every)).alias("head"))
    return inside.join(follow, "part").select("row", F.coalesce("next_row", "head").alias("next_row"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLOTS, seed: int = 0) -> DataFrame:
    """(doc_id, fingerprint) of every row: ``size`` samples of eight hex digits. Null text counts as empty."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = signatures(own.select("row", "text"), ["row"], "text", size, seed)
    return own.select("row", "doc_id").join(found, "row").select("doc_id", written("sample").alias("fingerprint"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SLOTS) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both with the next document's.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document in descending id, the first following the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (shares of equal slots).
    Null texts count as empty; texts without words are alike to each other and to nothing else. Null
    ids come last, equal ids in the order of their rows, and each row keeps its place. A table of one
    row follows itself, an empty one gives no rows; other columns are left out. ``docs`` must be a
    table that rereads alike, as its rows are told apart by their place in it.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    follow = successors(own.select("row", "doc_id"))
    follow = shared_checkpoint(follow.join(own.select("row", F.length("text").cast("long").alias("n_chars")), "row"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # texts are dealt once, by row; of each only what its predecessor takes over is sent on
    texts = own.select("row", "text").repartition("row")
    taken = texts.select(F.col("row").alias("next_row"), "text").join(follow, "next_row").select("row", "n_chars", F.substring("text", F.lit(1), third).alias("head"))
    pair = texts.join(taken, "row")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    pair = pair.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), "head"))
    # The digest of the edited text travels with the words, as eight numbered parts of 32 bits: a third
    # kind of text. So texts are read, paired and dealt once for everything.
    sha = F.sha2("edited", 256)
    parts = F.concat_ws(" ", *[F.concat(F.lit(str(i)), F.substring(F.col("_sha"), 8 * i + 1, 8)) for i in range(8)])
    pair = pair.select("row", "text", "edited", sha.alias("_sha"))
    both = pair.select("row", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in enumerate((F.col("text"), F.col("edited"), parts))])).alias("x"))
    words = both.select("row", "x.kind", F.explode(words_of(F.col("x.text"))).alias("_word"))
    number = F.conv(F.substring("_word", 2, 8), 16, 10).cast("long") + F.shiftleft(F.substring("_word", 1, 1).cast("long"), 32)
    words = words.select("row", "kind", F.when(F.col("kind") == 2, number).otherwise(F.xxhash64("_word", F.lit(0))).alias("_term"))
    part = lambda i: F.max(F.when((F.col("kind") == 2) & (F.shiftright("_term", 32) == i), F.col("_term").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"part{i}")
    found = least_values(words, ["row", "kind"], size, *[part(i) for i in range(8)])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    found = found.groupBy("row").agg(of(0, "sample").alias("sample"), of(1, "sample").alias("edited"), *[of(2, f"part{i}").alias(f"part{i}") for i in range(8)])
    digest = F.concat(*[F.lower(F.lpad(F.hex(f"part{i}"), 8, "0")) for i in range(8)])
    first = shared_checkpoint(found.select("row", "sample", "edited", digest.alias("edited_sha256")))
    near = follow.join(own.select("row", "doc_id"), "row").join(first, "row")
    near = near.join(first.select(F.col("row").alias("next_row"), F.col("sample").alias("next")), "next_row")
    return near.select("doc_id", "n_chars", "edited_sha256", written("sample").alias("fingerprint"), written("edited").alias("edited_fingerprint"), likeness("sample", "edited", size).alias("near_edited"), likeness("sample", "next", size).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


#: The draws have no SQL twin; tested against brute force and the exact similarity.
ORACLE_SQL = None
