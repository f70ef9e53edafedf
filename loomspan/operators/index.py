"""Candidate pairs by an inverted index over shingles and concepts, and bounds of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L


def postings(spans: DataFrame, keys: list[str], concepts: bool = True, group: str | None = None) -> DataFrame:
    """keys, term, weight, n: a row for each distinct shingle and concept of a span; terms are digests.

    ``n`` is how often a concept stands in the span, 0 for a shingle. With a ``group`` column a term is a
    digest of the group, too, so that only spans of a group meet.
    """
    own = [F.col(group)] if group else []
    digest = lambda kind, x: F.xxhash64(F.lit(kind), x, *own)
    entry = lambda term, weight, n: F.struct(term.alias("term"), F.lit(weight).alias("weight"), n.alias("n"))
    found = F.transform("shingles", lambda x: entry(digest("s", x), L.SHINGLE_HIT, F.lit(0)))
    if concepts:
        found = F.concat(found, F.transform(F.arrays_zip("concepts", "counts"), lambda x: entry(digest("c", x["concepts"]), L.CONCEPT_HIT, x["counts"])))
    return spans.select(*keys, F.inline(found))


#: Postings that are broadcast: at some 30 bytes each, a few megabytes. More are merged by term.
SMALL = 200_000


def candidates(targets: DataFrame, references: DataFrame, concepts: bool = True, most: int = L.CANDIDATES, least: int = L.MIN_HITS, grouped: bool = False) -> DataFrame:
    """doc_id, span_id, ref_id, ref_span, hits, rank: the ``most`` references of a span with the most hits.

    ``targets`` are featured spans by (doc_id, span_id), ``references`` featured spans by (ref_id, ref_span)
    or their postings (``postings``). Ties go to the earlier reference span. A shingle counts three, a concept
    one; ``shared`` concepts and ``runs`` (shingles) are what the hits are made of, ``dot`` is the inner product
    of the concepts' counts. If ``grouped``, a target meets only the references whose group_id is its
    doc_id: the group is part of the term. One join on the term; where the references' postings are few
    (``SMALL``, counted) they are broadcast, and if the targets lie by (doc_id, span_id) nothing else
    moves. Otherwise both sides are merged by term, and frequent terms split by the adaptive skew join.
    """
    theirs = references if "term" in references.columns else postings(references, ["ref_id", "ref_span"], concepts, "group_id" if grouped else None)
    theirs = theirs.where(F.col("weight") == L.SHINGLE_HIT) if not concepts else theirs
    theirs = theirs.select("ref_id", "ref_span", "term", F.col("n").alias("_n"))
    theirs = F.broadcast(theirs) if theirs.limit(SMALL + 1).count() <= SMALL else theirs
    met = postings(targets, ["doc_id", "span_id"], concepts, "doc_id" if grouped else None).join(theirs, "term")
    hits = met.groupBy("doc_id", "span_id", "ref_id", "ref_span").agg(F.sum("weight").cast("int").alias("hits"), F.count_if(F.col("weight") == L.CONCEPT_HIT).alias("shared"), F.sum(F.col("n").cast("long") * F.col("_n")).alias("dot")).where(F.col("hits") >= least)
    hits = hits.withColumn("runs", ((F.col("hits") - L.CONCEPT_HIT * F.col("shared")) / L.SHINGLE_HIT).cast("long"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "span_id").orderBy(F.desc("hits"), "ref_id", "ref_span"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most)


def sizes(spans: DataFrame, keys: list[str], side: str) -> DataFrame:
    """keys and what a bound needs of a span: numbers of concepts and runs, norm, letters, reach."""
    norm = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return spans.select(*keys, F.struct(F.size("concepts").alias("concepts"), F.size("shingles").alias("runs"), norm.alias("norm"), F.length("norm").alias("letters"), "reach").alias(side))


def bound(left: Column, right: Column) -> Column:
    """What the score of a pair cannot exceed, from counts alone: token, concept and run parts are exact.

    What compares letters is bounded by the shorter text, and the longest block, where no run is shared, by
    the stretches with fewer than three whole content terms in them.
    """
    w, p = L.SPAN_WEIGHTS, L.PAIR_WEIGHTS
    share = lambda n, a, b: n / F.greatest(F.lit(1), a + b - n)
    token = F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.greatest(F.lit(1), left["norm"]).cast("double") * F.greatest(F.lit(1), right["norm"])))
    angle = 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - token * token))
    letters = 2 * F.least(left["letters"], right["letters"]) / F.greatest(F.lit(1), left["letters"] + right["letters"])  # all of the shorter text at most
    base = w["token"] * token + w["char"] + w["sequence"] * letters + w["concept"] * share(F.col("shared"), left["concepts"], right["concepts"]) + w["angle"] * angle
    within = F.when(F.col("runs") > 0, F.least(left["letters"], right["letters"])).otherwise(F.least(left["reach"], right["reach"]))
    block = F.least(F.lit(1.0), within / F.greatest(F.lit(1), left["letters"]))
    most_prior = 0.92 + 0.16
    return (p["span"] * F.least(F.lit(1.0), base) + p["longest"] * block + p["shingle"] * share(F.col("runs"), left["runs"], right["runs"])) * most_prior


def promising(found: DataFrame, targets: DataFrame, references: DataFrame, floor: float) -> DataFrame:
    """The candidates whose score may reach ``floor``; only their texts need to be looked at."""
    both = found.join(sizes(targets, ["doc_id", "span_id"], "_left"), ["doc_id", "span_id"]).join(sizes(references, ["ref_id", "ref_span"], "_right"), ["ref_id", "ref_span"])
    return both.where(bound(F.col("_left"), F.col("_right")) + 1e-6 >= floor).drop("_left", "_right")
