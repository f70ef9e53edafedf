"""Reuse analysis: targets against references, pairs of texts, and repetition within a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L
from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.operators import containment, index, intervals, matching
from loomspan.operators import spans as P
from loomspan.session import settled, spread


#: Spans of a target whose concepts the query ``source_prior`` counts; the check counts those of all.
PRIOR_SPANS = 260
#: Title, url and source of the reference of a pair.
LOCAL = "Local File", "", "Local File"


def target_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    own = P.pinned(spread(df.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))), _c=T.normalize_extracted(F.col("_t")))
    return P.pinned(own, text=T.strip(T.repair_spaced(F.col("_c")))).select("doc_id", "text")


def reference_rows(refs: DataFrame) -> DataFrame:
    """ref_id, title, url, source, text with defaults; columns that are missing count as null."""
    has = lambda c, d: F.coalesce(F.col(c).cast("string") if c in refs.columns else F.lit(None).cast("string"), F.lit(d))
    group = F.col("group_id") if "group_id" in refs.columns else F.lit(None).cast("long")
    own = refs.select("ref_id", group.alias("group_id"), has("title", "Reference").alias("title"), has("url", "").alias("url"), has("source", "API").alias("source"), has("text", "").alias("_t"))
    own = P.pinned(own, _c=T.normalize_extracted(F.col("_t")))
    return P.pinned(own, text=T.repair_spaced(F.col("_c"))).drop("_t", "_c")


@dataclass
class References:
    """References cleaned, and where a task cannot hold them cut and indexed: what many checks against them share.

    ``rows`` has ref_id, group_id, title, url, source, text; ``spans`` their featured spans, ``postings`` the
    terms of these, made when first asked for. ``save`` writes them as tables, the postings bucketed and sorted
    by term, so that a join on the term exchanges the targets' side alone; ``load`` reads them.
    """

    rows: DataFrame
    grouped: bool
    tables: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def of(cls, refs: DataFrame) -> References:
        return cls(settled(reference_rows(refs)), "group_id" in refs.columns)

    @cached_property
    def spans(self) -> DataFrame:
        if self.tables:
            return self.tables[0]
        spans = P.spans(self.rows.select(F.col("ref_id").alias("_r"), "text"), "_r", featured=True).withColumnRenamed("doc_id", "ref_id").withColumnRenamed("span_id", "ref_span")
        return settled(spans.drop("kind", "tokens").join(self.rows.drop("text"), "ref_id"))

    @cached_property
    def postings(self) -> DataFrame:
        return self.tables[1] if self.tables else index.postings(self.spans, ["ref_id", "ref_span"], True, "group_id" if self.grouped else None)

    @cached_property
    def bounded(self) -> bool:
        """Whether a task can hold what a target meets."""
        return matching.bounded(self.rows, self.grouped)

    def save(self, name: str, buckets: int = 64) -> None:
        """As tables ``name``_rows, ``name``_spans and ``name``_postings of the session's catalog, replacing such."""
        self.rows.withColumn("grouped", F.lit(self.grouped)).write.mode("overwrite").saveAsTable(f"{name}_rows")
        self.spans.write.mode("overwrite").saveAsTable(f"{name}_spans")
        self.postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_postings")

    @classmethod
    def load(cls, spark: SparkSession, name: str) -> References:
        rows = spark.table(f"{name}_rows")
        one = rows.select("grouped").first()
        return cls(rows.drop("grouped"), bool(one and one[0]), (spark.table(f"{name}_spans"), spark.table(f"{name}_postings")))

    def kept_texts(self) -> DataFrame:
        """group_id, title, url, source, kept: the first text of each source, normalized."""
        key = ["group_id", "title", "url", "source"]
        first = self.rows.withColumn("group_id", F.col("group_id").cast("string")).groupBy(*key).agg(F.min_by("text", "ref_id").alias("text"))
        return first.select(*key, T.normalized(F.col("text")).alias("kept"))


def source_priors(targets: DataFrame, references: DataFrame, grouped: bool, most: int | None = PRIOR_SPANS) -> DataFrame:
    """doc_id, title, url, source, prior: how alike the concepts of a target and a source are.

    Of a target the first ``most`` spans count, all where it is None.
    Counted over shared concepts, so only pairs that share one have a row; the others' prior is 0.
    """
    key = ["title", "url", "source"]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("span_id"))
    own = targets if most is None else targets.withColumn("_n", first).where(F.col("_n") <= most)
    own = own.select("doc_id", F.explode("concepts").alias("c")).distinct()
    theirs = references.select(*key, "group_id", F.explode("concepts").alias("c")).distinct()
    if not grouped:
        theirs = theirs.drop("group_id").distinct()
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("_a"))
    part = [*key, "group_id"] if grouped else key
    counts = theirs.groupBy(*part).agg(F.count("*").alias("_b"))
    if grouped:  # a target is its own group, so the group is part of the key
        theirs, counts = theirs.withColumnRenamed("group_id", "doc_id"), counts.withColumnRenamed("group_id", "doc_id")
        part = ["doc_id", *key]
    shared = own.join(theirs, ["doc_id", "c"] if grouped else ["c"]).groupBy("doc_id", *key).agg(F.count("*").alias("_n"))
    out = shared.join(sizes, "doc_id").join(counts, part)
    return out.select("doc_id", *key, (F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n"))).alias("prior"))


def check(targets: DataFrame, refs: DataFrame | References, key: str = "doc_id", text: str = "text", min_score: float = L.MIN_SCORE, max_matches: int = 0, concepts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matches, results): the best source of each reused span, and a row per target.

    ``refs`` has ref_id, text and optionally title, url, source, or is a ``References``; with a group_id
    column a target meets only the references of its own group. A null text is empty. With
    ``concepts=False`` candidates share a shingle at least, which is what a corpus against itself affords;
    the result is then a subset. Numbers are unrounded fractions but for the percentages, rounded to one digit.
    """
    theirs = refs if isinstance(refs, References) else References.of(refs)
    floor = 0.82 * min_score
    if concepts and theirs.bounded:
        found = settled(matching.found(targets, theirs.rows, key, text, theirs.grouped, floor))
        matches, results = _told(found, min_score)
        kept = [found]
    else:
        matches, results, kept = _joined(targets, theirs, key, text, min_score, floor, concepts)
    shown = matches if max_matches <= 0 else matches.select("*").where(F.col("rank") <= max_matches)
    results.kept = shown.kept = [*kept, matches, *([] if theirs is refs else [theirs.rows, theirs.__dict__.get("spans")])]  # what release() lets go
    return shown, results


def _told(found: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Matches and results out of the rows of ``matching``."""
    docs, scored = found.where("m IS NULL"), found.where("m IS NOT NULL").select("doc_id", "m.*")
    matches = settled(_matches(_gathered(scored, min_score, ("raw", "norm", "start", "end", "inside")).select("*", *[f"b.{c}" for c in ("raw", "norm", "start", "end")], F.col("b.inside").alias("_inside")), min_score))
    size = F.greatest(F.col("_len"), F.lit(1))
    told = docs.select("doc_id", "_len", "_refs", F.col("_times").alias("n_rep"), T.half_even(F.col("_covered") / size * 100).alias("rep_pct"))
    return matches, _percentages(told, matches)


def _joined(targets: DataFrame, theirs: References, key: str, text: str, min_score: float, floor: float, concepts: bool) -> tuple[DataFrame, DataFrame, list]:
    """The same where a task cannot hold the references: featured spans are written and joined on their terms."""
    grouped = theirs.grouped
    texts = settled(target_texts(targets, key, text))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = settled(P.spans(texts, featured=True).drop("kind", "tokens").repartition(parts, "doc_id", "span_id"))
    found = index.candidates(own, theirs.postings, concepts, grouped=grouped)
    found = settled(index.promising(found, own, theirs.spans, floor).select("doc_id", "span_id", "ref_id", "ref_span", "rank"))
    right = theirs.spans.select("ref_id", "ref_span", "group_id", F.col("norm").alias("r_norm"), F.col("raw").alias("r_raw"), F.col("content").alias("r_content"), "title", "url", "source")
    pairs = found.join(right, ["ref_id", "ref_span"])
    left = own.select("doc_id", "span_id", F.col("norm").alias("l_norm"), F.col("raw").alias("l_raw"), F.col("content").alias("l_content"))
    # only texts with a promising pair need to know how alike they and a source are
    prior = source_priors(own.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), theirs.spans, grouped, None)
    pairs = pairs.join(left, ["doc_id", "span_id"]).join(prior, ["doc_id", "title", "url", "source"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    kept = ["doc_id", "span_id", "ref_id", "ref_span", "rank", "title", "url", "source", "prior", "r_raw"]
    scored = settled(S.scored_pairs(pairs, floor, kept))

    best = _gathered(scored, min_score).join(own.select("doc_id", "span_id", "raw", "norm", "start", "end"), ["doc_id", "span_id"])
    chosen = best.select("*", "b.title", "b.url", "b.source")
    asked = chosen.where(_named() & (F.length("norm") >= matching.ASKED)).select("doc_id", "span_id", "title", "url", "source", "norm")
    asked = asked.withColumn("group_id", F.col("doc_id").cast("string") if grouped else F.lit(None).cast("string"))
    inside = containment.contained(asked, theirs.kept_texts(), ["group_id", "title", "url", "source"], "norm", "kept").select("doc_id", "span_id", F.lit(True).alias("_inside"))
    matches = settled(_matches(best.join(inside, ["doc_id", "span_id"], "left"), min_score))
    # whether there is any reference span to compare with, for the target's group or for all
    if grouped:
        there = theirs.spans.select(F.col("group_id").alias("doc_id")).distinct().withColumn("_refs", F.lit(True))
        external = texts.join(there, "doc_id", "left")
    else:
        external = texts.join(theirs.spans.limit(1).agg((F.count("*") > 0).alias("_refs")), how="cross")
    # what a text repeats counts only where there is nothing to compare it with
    internal = repetition_results(external.where(~F.coalesce("_refs", F.lit(False))).select("doc_id", "text"))
    told = external.select("doc_id", F.length("text").alias("_len"), F.coalesce("_refs", F.lit(False)).alias("_refs")).join(internal, "doc_id", "left")
    return matches, _percentages(told, matches), [texts, own, found, scored]


def _named() -> Column:
    return (F.col("title") != "") | (F.col("url") != "") | (F.col("source") != "")


def _gathered(scored: DataFrame, min_score: float, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, span_id, b, all_ranges: the best pair of each span that reaches the score, and the ranges of its source's."""
    w = Window.partitionBy("doc_id", "span_id")
    first = F.row_number().over(w.orderBy(F.desc("score"), "rank"))
    source = F.struct("title", "url", "source")
    scored = scored.withColumn("_first", first).withColumn("_best", F.max(F.when(F.col("_first") == 1, F.struct(F.col("score").alias("score"), source.alias("key")))).over(w))
    same = (source == F.col("_best.key")) & (F.col("score") >= F.greatest(F.lit(0.86 * min_score), 0.42 * F.col("_best.score")))
    return scored.groupBy("doc_id", "span_id").agg(
        F.max(F.when(F.col("_first") == 1, F.struct("score", "ref_id", "ref_span", "title", "url", "source", "prior", "r_raw", "token_cos", "sequence", "concept", "longest_ratio", "ranges", *more))).alias("b"),
        F.flatten(F.collect_list(F.when(same, F.col("ranges")))).alias("all_ranges"),
    ).where(F.col("b.score") >= min_score)


def _matches(best: DataFrame, min_score: float) -> DataFrame:
    """The rows of matches; ``best`` has doc_id, span_id, raw, norm, start, end, b, all_ranges, _inside."""
    best, named = best.select("*", "b.title", "b.url", "b.source"), _named()
    size = F.greatest(F.length("raw"), F.lit(1))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length("raw").alias("e")))
    verbatim = F.coalesce(F.col("_inside"), F.lit(False))
    merged = F.when(named & (F.size("all_ranges") > 0), intervals.merge_ranges(F.col("all_ranges"), F.length("raw"))).otherwise(F.col("b.ranges"))
    best = best.withColumn("_ranges", F.when(verbatim, whole).otherwise(merged)).withColumn("score", F.when(verbatim, F.greatest(F.col("b.score"), F.lit(0.97))).otherwise(F.col("b.score")))
    best = best.withColumn("_share", intervals.ranges_length(F.col("_ranges")) / size)
    full = ((F.size("_ranges") == 0) & (F.col("score") >= 0.84)) | ((F.col("_share") < 0.22) & (F.col("score") >= 0.90))
    best = best.withColumn("ranges", F.when(full, whole).otherwise(F.col("_ranges"))).withColumn("share", F.when(full, F.lit(1.0)).otherwise(F.col("_share")))
    moved = F.transform("ranges", lambda r: F.struct((F.col("start") + r["s"]).alias("s"), F.least(F.col("end"), F.col("start") + r["e"]).alias("e")))
    best = best.withColumn("absolute_ranges", F.filter(moved, lambda r: r["e"] > r["s"]))
    percent = lambda c: T.half_even(c * 100)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("coverage_ratio"), F.desc("score_pct"), "span_id"))
    return best.select(
        "doc_id", "span_id", F.col("raw").alias("plagiarized_paragraph"), T.match_label(F.col("score")).alias("match_type"),
        F.concat("title", F.lit(" ("), "source", F.lit(")")).alias("source_title"), F.col("url").alias("source_url"), F.col("start").alias("text_start"), F.col("end").alias("text_end"),
        F.col("ranges").alias("highlight_ranges"), "absolute_ranges", F.substring("b.r_raw", 1, 1400).alias("source_excerpt"), percent(F.col("share")).alias("coverage_ratio"),
        percent(F.col("b.prior")).alias("source_relevance"), percent(F.col("score")).alias("score_pct"), percent(F.col("b.token_cos")).alias("token_cosine"), percent(F.col("b.sequence")).alias("sequence"),
        percent(F.col("b.concept")).alias("concept_overlap"), percent(F.col("b.longest_ratio")).alias("longest_block"),
    ).withColumn("rank", rank).withColumnRenamed("score_pct", "score")


def release(results: DataFrame) -> None:
    """Let go of what ``check`` has written for its two tables, once these are no longer read: see ``settled``."""
    results.kept = []


def finished(frame: DataFrame) -> DataFrame:
    """One of the tables of ``check`` computed and written, and what was written for it let go."""
    out = settled(frame)
    release(frame)
    return out


def _percentages(told: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per target; ``told`` has doc_id, _len, _refs and, for those with nothing to meet, rep_pct and n_rep."""
    placed = F.when(F.size("absolute_ranges") > 0, F.col("absolute_ranges")).otherwise(F.array(F.struct(F.col("text_start").alias("s"), F.col("text_end").alias("e"))))
    rows = matches.select("doc_id", F.explode(placed).alias("_r")).select("doc_id", F.col("_r.s").alias("start"), F.col("_r.e").alias("end"))
    out = told.join(intervals.covered(rows, ["doc_id"]), "doc_id", "left").join(matches.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id", "left")
    n = F.coalesce("_n", F.lit(0))
    plag = T.half_even(F.coalesce(F.col("covered") / F.greatest(F.col("_len"), F.lit(1)) * 100, F.lit(0.0)))
    plag = F.when((n > 0) & (plag == 0), F.lit(0.1)).otherwise(plag)
    empty = F.col("_len") == 0
    mode = F.when(empty, "empty").when(~F.col("_refs"), "offline").otherwise("external")
    pct = F.when(empty, F.lit(0.0)).when(F.col("_refs"), plag).otherwise(F.coalesce("rep_pct", F.lit(0.0)))
    return out.select("doc_id", pct.alias("plag_pct"), F.when(empty, F.lit(0.0)).otherwise(T.half_even(F.greatest(F.lit(0.0), 100 - pct))).alias("orig_pct"), mode.alias("mode"), F.when(F.col("_refs") | empty, n).otherwise(F.coalesce("n_rep", F.lit(0))).cast("long").alias("n_matches"))


def repetitions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences that a text has more than once: doc_id, text_start, text_end, raw, norm, times, score."""
    own = P.sentences(df, key, text, 3)
    times = F.count("*").over(Window.partitionBy("doc_id", F.xxhash64("norm"), "norm"))
    out = own.withColumn("times", times).where("times > 1")
    score = F.least(F.lit(0.98), 0.70 + (F.col("times") - 1) * 0.08)
    return out.select("doc_id", F.col("start").alias("text_start"), F.col("end").alias("text_end"), "raw", "norm", "times", F.lit("Internal Repetition").alias("match_type"), T.half_even(score * 100).alias("score"))


def repetition_results(texts: DataFrame) -> DataFrame:
    """doc_id, rep_pct, n_rep of the texts with repeated sentences."""
    rep = repetitions(texts)
    length = intervals.covered(rep.select("doc_id", F.col("text_start").alias("start"), F.col("text_end").alias("end")), ["doc_id"])
    count = rep.groupBy("doc_id").agg(F.count("*").alias("n_rep"))
    joined = texts.join(length, "doc_id").join(count, "doc_id")
    return joined.select("doc_id", T.half_even(F.col("covered") / F.greatest(F.length("text"), F.lit(1)) * 100).alias("rep_pct"), "n_rep")


def compare(pairs: DataFrame, key: str = "pair_id", reference: str = "reference_text", text: str = "text", min_score: float = L.COMPARE_SCORE) -> DataFrame:
    """pair_id, plag_pct, orig_pct, mode, n_matches: each text against its own reference."""
    return _compared(matching.found_in_rows(pairs, key, reference, text, LOCAL, 0.82 * min_score), key, min_score)


def compare_next(texts: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = L.COMPARE_SCORE) -> DataFrame:
    """The same for each text against the one whose key is one more, by the text's key as pair_id."""
    return _compared(matching.found_with_next(texts, key, text, LOCAL, 0.82 * min_score), "pair_id", min_score)


def _compared(found: DataFrame, key: str, min_score: float) -> DataFrame:
    found = settled(found)
    matches, results = _told(found, min_score)
    named = results.withColumnRenamed("doc_id", key)
    named.kept = [found, matches]
    return named


def compare_files(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for files: ``pairs`` has pair_id, reference_path, path; ``texts`` path and text, as files

    are read by ``sources.files``. A file that is not among them counts as empty.
    """
    of = lambda path, name: texts.select(F.col("path").alias(path), F.col("text").alias(name))
    return compare(pairs.join(of("reference_path", "reference_text"), "reference_path", "left").join(of("path", "text"), "path", "left"))


def snapshot(targets: DataFrame, refs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, matches: the quick look that retrieval accepts sources by."""
    found = check(targets, refs, key, text, L.SNAPSHOT_SCORE, 6)[1]
    seen = found.select("doc_id", F.col("plag_pct").alias("score"), F.least("n_matches", F.lit(6)).alias("matches"))
    seen.kept = found.kept
    return seen
