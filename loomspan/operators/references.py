"""References: removal of doubles, blending of kinds, and ranking by overlap with a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L
from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.operators import spans as P
from loomspan.session import settled


def reference_key(title: str = "title", url: str = "url", text: str = "text") -> Column:
    """The address, or without one the title and the beginning of the text; never empty."""
    address = F.lower(T.collapse(F.col(url)))
    own = F.concat(F.lower(T.collapse(F.col(title))), F.lit("|"), T.normalized(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 240)))
    return F.when(address != "", address).otherwise(own)


def deduplicate(refs: DataFrame, limit: int = 0, groups: tuple[str, ...] = ()) -> DataFrame:
    """The first reference, by ref_id, of each key; of those the first ``limit`` if it is positive."""
    own = refs.withColumn("_key", reference_key())
    first = F.row_number().over(Window.partitionBy(*groups, F.xxhash64("_key"), "_key").orderBy("ref_id"))
    own = own.withColumn("_first", first).where("_first = 1").drop("_first", "_key")
    if limit <= 0:
        return own
    if not groups:
        return own.orderBy("ref_id").limit(limit)
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("ref_id"))).where(F.col("_n") <= limit).drop("_n")


def blend(refs: DataFrame, web_sources: list[str], most: int = 24, web_most: int = 3) -> DataFrame:
    """At most ``most`` references: papers first, then up to three web pages, then the rest in order."""
    # the first ``most`` of either kind are all that can be taken; only these few are numbered
    web = F.coalesce(F.col("source").isin(web_sources), F.lit(False))
    own = refs.withColumn("_web", web)
    own = own.where("NOT _web").orderBy("ref_id").limit(most).unionByName(own.where("_web").orderBy("ref_id").limit(most))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_web").orderBy("ref_id")))
    own = own.withColumn("_pages", F.least(F.lit(web_most), F.sum(F.col("_web").cast("int")).over(Window.partitionBy(F.lit(0).cast("int")))))
    chosen = F.when(F.col("_web"), F.col("_n") <= web_most).otherwise(F.col("_n") <= F.greatest(F.lit(0), F.lit(most) - F.col("_pages")))
    part = F.when(~chosen, 2).when(F.col("_web"), 1).otherwise(0)
    own = own.withColumn("_part", part).orderBy("_part", "ref_id").limit(most)
    return own.withColumn("position", F.row_number().over(Window.orderBy("_part", "ref_id"))).drop("_web", "_n", "_pages", "_part")


def cleaned(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text as analysis starts from it, each step computed once per row."""
    df = P.pinned(df, _c=T.normalize_extracted(F.col(text)))
    return P.pinned(df, **{out: T.strip(T.repair_spaced(F.col("_c")))}).drop("_c")


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: normalized, terms, sample, headline, phrases to probe references with."""
    own = cleaned(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_raw")), "_raw", "_all")
    own = P.pinned(own, _flat=T.collapse(F.col("_all")))
    own = P.pinned(own, _t=F.when(F.length("_all") > 48_000, T.distributed_sample(F.col("_flat"), 42_000)).otherwise(F.col("_all"))).select("doc_id", "_t")
    spans = P.spans(own, "doc_id", "_t", min_words=8, sentence_words=8)
    w = Window.partitionBy("doc_id").orderBy("span_id")
    spans = spans.select("doc_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("doc_id")).alias("n"), F.size("tokens").alias("size"), F.array_join(F.slice("tokens", 1, 20), " ").alias("phrase"))
    fit = spans.where((F.col("size") >= 10) & (F.length("phrase") >= 50))
    places = F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 3), F.floor(F.col("n") * 2 / 3), F.col("n") - 1)
    fit = fit.withColumn("at", F.array_position(places, F.col("i").cast("long")))  # 0 where the span is not preferred
    best = fit.groupBy("doc_id", "phrase").agg(F.min(F.when(F.col("at") > 0, F.col("at"))).alias("at"), F.min("i").alias("i"))
    found = best.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "phrase")))).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNull(), F.struct("i", "phrase")))).alias("_q"),
    )
    p, q = F.transform("_p", lambda x: x["phrase"]), F.transform("_q", lambda x: x["phrase"])
    found = found.select("doc_id", F.when(F.size(p) >= 4, p).otherwise(F.slice(F.concat(p, q), 1, 6)).alias("phrases"))
    own = P.pinned(own, _k=T.tokens(F.col("_t")))
    own = P.pinned(own, _some=F.slice("_k", 1, 2600))
    out = own.select("doc_id", F.array_join("_k", " ").alias("normalized"), F.array_distinct(T.content_tokens(F.col("_some"))).alias("terms"), F.array_join(F.slice(T.tokens(T.collapse(F.regexp_extract(F.col("_t"), r"^[^\n\r]*", 0))), 1, 16), " ").alias("headline"))
    out = out.withColumn("sample", F.substring("normalized", 1, 3200)).withColumn("terms", F.when(F.col("normalized") == "", F.array().cast("array<string>")).otherwise(F.col("terms")))
    return out.join(found, "doc_id", "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))


def overlap_scores(docs: DataFrame, refs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ref_id, score (0 to 100), text_length for the pairs of ``refs``, which has doc_id.

    ``refs`` lists for each text the references to rank (doc_id, ref_id, title, text); texts meet theirs
    by an equi-join, never all by all.
    """
    # only texts that have references are looked at; what the plan reads several times is computed once, and
    # dealt out first: few rows, each of them costly, would be merged into one task
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs = settled(refs.select("doc_id", "ref_id", "title", "text").repartition(parts, "doc_id", "ref_id"))
    asked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).join(refs.select("doc_id").distinct(), "doc_id", "left_semi")
    prof = profiles(settled(asked.repartition(parts, "doc_id")), "doc_id", "_t")
    ref = P.pinned(cleaned(refs.select("doc_id", "ref_id", "title", "text"), "text", "_t"), _k=T.tokens(F.col("_t")))
    ref = ref.select("doc_id", "ref_id", T.normalized(F.col("title")).alias("_title"), F.array_join("_k", " ").alias("_norm"), F.slice("_k", 1, 2200).alias("_some"), F.length(T.collapse(F.col("text"))).alias("text_length"))
    ref = P.pinned(ref, _terms=F.array_distinct(T.content_tokens(F.col("_some"))), _sample=F.substring("_norm", 1, 3200))
    pairs = P.pinned(ref.join(prof, "doc_id"), _l=F.col("sample"), _r=F.col("_sample"), _norm2=F.col("_norm"), _phrases=F.col("phrases")).drop("sample", "_sample", "_norm", "phrases")
    pairs = pairs.withColumnsRenamed({"_l": "sample", "_r": "_sample", "_norm2": "_norm", "_phrases": "phrases"}).repartition(parts, "doc_id", "ref_id")
    aligned = F.when((F.col("headline") != "") & (F.col("_title") != ""), S.sequence_ratio(F.col("headline"), F.col("_title"))).otherwise(0.0)
    pairs = settled(pairs.withColumn("_lead", S.sequence_ratio(F.col("sample"), F.col("_sample"))).withColumn("_aligned", aligned))
    # the multiset cosine over 4-grams: exploded on the pair, so both sides meet on (pair, gram)
    pair = ["doc_id", "ref_id"]
    left = pairs.select(*pair, F.explode(T.char_grams(F.col("sample"))).alias("g")).groupBy(*pair, "g").agg(F.count("*").cast("double").alias("l"))
    right = pairs.select(*pair, F.explode(T.char_grams(F.col("_sample"))).alias("g")).groupBy(*pair, "g").agg(F.count("*").cast("double").alias("r"))
    both = left.join(right, [*pair, "g"], "full").groupBy(*pair).agg((F.sum(F.col("l") * F.col("r")) / F.sqrt(F.sum(F.col("l") * F.col("l")) * F.sum(F.col("r") * F.col("r")))).alias("_char"))
    out = pairs.join(both, pair, "left")
    w = L.RANK_WEIGHTS
    hits = F.size(F.filter("phrases", lambda p: F.contains(F.col("_norm"), p)))
    score = (
        w["phrase"] * hits / F.greatest(F.lit(1.0), F.size("phrases").cast("double")) + w["concept"] * S.jaccard(F.col("terms"), F.col("_terms")) + w["char"] * F.least(F.lit(1.0), F.coalesce("_char", F.lit(0.0)))
        + w["leading"] * F.col("_lead") + w["title"] * F.col("_aligned")
    )
    none = (F.col("normalized") == "") | (F.col("_norm") == "")
    return out.select(*pair, F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * 100))).alias("score"), "text_length")


def rerank(docs: DataFrame, refs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ref_id, score, position: references by score, then length, then order; in order if none scores."""
    own = overlap_scores(docs, refs, key, text)
    top = F.max("score").over(Window.partitionBy("doc_id"))
    own = own.withColumn("_s", F.when(top > 0, F.col("score")).otherwise(0.0)).withColumn("_l", F.when(top > 0, F.col("text_length")).otherwise(0))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_s"), F.desc("_l"), "ref_id"))
    return own.withColumn("position", place).drop("_s", "_l")


def expand(refs: DataFrame, pages: DataFrame, web_sources: list[str], least: int = 4) -> DataFrame:
    """Web references with the text of their page: alone if it has the snippet in it, else after it.

    ``pages`` has url, page_title, page_text, one row per address.
    """
    one = pages.groupBy("url").agg(F.min_by("page_title", "page_text").alias("page_title"), F.min("page_text").alias("page_text"))
    own = refs.join(one, "url", "left")
    take = F.col("source").isin(web_sources) & (F.length(F.coalesce("page_text", F.lit(""))) >= 260) & (T.collapse(F.col("url")) != "")
    snippet = T.collapse(F.col("text"))
    inside = F.contains(F.lower("page_text"), F.lower(snippet))
    text = F.when(take, F.when((snippet == "") | inside, F.col("page_text")).otherwise(F.concat(snippet, F.lit("\n\n"), "page_text"))).otherwise(F.col("text"))
    title = F.when(take & (F.length(F.coalesce("page_title", F.lit(""))) >= least), F.col("page_title")).otherwise(F.col("title"))
    return own.withColumn("snippet", F.when(take, snippet)).withColumn("title", title).withColumn("text", text).drop("page_title", "page_text")
