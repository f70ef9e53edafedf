"""Text functions as column expressions. A null text counts as empty throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of a value that it names more than once, evaluated once."""
    return F.get(F.transform(F.array(value), made), 0)


def repair_spaced(c) -> Column:
    """Joins letters that extraction has set apart, where most alphabetic tokens are single letters."""

    def repaired(t: Column) -> Column:
        words, single = F.regexp_count(t, F.lit("[A-Za-z]+")), F.regexp_count(t, F.lit("(?<![A-Za-z])[A-Za-z](?![A-Za-z])"))
        # 21 of 40 are the fewest: the words of a text with fewer single letters need not be counted
        spaced = _let(single, lambda s: (s >= 21) & _let(words, lambda n: (n >= 40) & (s >= 0.52 * n)))
        return F.when(spaced, F.regexp_replace(t, rf"(?<=\b[A-Za-z]){L.SPACE}+(?=[A-Za-z]\b)", "")).otherwise(t)

    return _let(_text(c), repaired)


def normalize_extracted(c) -> Column:
    """Ligatures, quotes, dashes and line ends made plain; hyphenated line breaks joined; page numbers blanked.

    What a text cannot have is not looked for: the letters replaced are not ASCII.
    """
    letters = lambda t: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), L.LETTERS.items(), t)
    t = _let(_text(c), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(letters(t)))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    broken = rf"([A-Za-z])-{L.SPACE}*\n{L.SPACE}*([A-Za-z])"
    t = _let(t, lambda t: F.when(F.contains(t, F.lit("-")) & F.contains(t, F.lit("\n")), F.regexp_replace(t, broken, "$1$2")).otherwise(t))
    return F.regexp_replace(t, rf"(?md)^{L.SPACE}*[0-9]{{1,4}}{L.SPACE}*$", "")


def strip(c) -> Column:
    """Without Unicode white space at either end."""
    ends = lambda t: F.substring(t, 1, 1).rlike(L.SPACE) | F.substring(t, -1, 1).rlike(L.SPACE)
    return _let(_text(c), lambda t: F.when(ends(t), F.regexp_replace(t, rf"^{L.SPACE}+|{L.SPACE}+\z", "")).otherwise(t))


def clean_block(c) -> Column:
    t = F.regexp_replace(normalize_extracted(c), "[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"))


def collapse(c) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), L.SPACE + "+", " "))


def cleaned(c) -> Column:
    """What analysis starts from."""
    return repair_spaced(normalize_extracted(c))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(L.TOKEN), F.lit(0))


def normalized(c) -> Column:
    return F.array_join(tokens(c), " ")


def stem(token: Column) -> Column:
    """Cuts the first suffix that fits off a token of more than three letters, once."""
    low = F.lower(token)
    out = None
    for s in (*L.SUFFIXES[0], *L.SUFFIXES[1]):
        fits = low.endswith(s) & (F.length(low) > len(s) + 2)
        cut = F.substring(low, F.lit(1), F.length(low) - len(s))
        out = F.when((F.length(low) <= 3), low).when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(low)


def canonical(token: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in L.VARIANTS.items() for x in p])
    return F.coalesce(F.try_element_at(known, token), token)


def content_tokens(toks: Column) -> Column:
    """Canonical stems that are no stopwords; all of them if none is left."""
    stems = F.transform(toks, stem)
    kept = F.filter(stems, lambda x: ~x.isin(L.STOPWORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(stems), canonical)


def shingles(toks: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens joined by blanks; fewer tokens make one run, none make none."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0))), lambda i: F.array_join(F.slice(toks, i + 1, n), " "))
    return F.when(F.size(toks) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def char_grams(norm: Column, n: int = 4) -> Column:
    """All runs of n characters, repeats included; a shorter text is one run, an empty one none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - n + 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(n)))
    return F.when(F.length(norm) == 0, F.array().cast("array<string>")).otherwise(runs)


def is_noise(c) -> Column:
    """Whether a paragraph is front matter, numbers or headings rather than running text."""
    t = collapse(c)
    low, toks = F.lower(t), tokens(t)
    n = F.size(toks)
    digits = F.size(F.filter(toks, lambda x: x.rlike("[0-9]")))
    upper = F.size(F.filter(F.split(t, " "), lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)))
    marked = reduce(lambda a, b: a | b, [low.contains(m) for m in L.NOISE_MARKS])
    letters = F.aggregate(toks, F.lit(0), lambda a, x: a + F.length(x))
    return (
        (t == "") | marked | (n == 0) | (digits >= 0.22 * n)
        | ((n <= 20) & (upper >= F.greatest(F.lit(4), F.floor(n / 2))))
        | ((n >= 10) & (letters < 3.7 * n) & (digits >= 2))
    )


def distributed_sample(c, most: int = 22000) -> Column:
    """A collapsed text as it is, or of a longer one the beginning, middle and end."""
    t = collapse(c)
    n, seg = F.length(t), max(900, most // 3)
    middle = F.greatest(F.floor(n / 2).cast("int") - seg // 2, F.lit(0))
    joined = F.concat_ws(" ", F.trim(F.substring(t, 1, seg)), F.trim(F.substring(t, middle + 1, F.lit(seg))), F.trim(F.substring(t, n - seg + 1, F.lit(seg))))
    return F.when(n <= most, t).otherwise(F.trim(F.substring(joined, 1, most)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def angle_similarity(cosine: Column) -> Column:
    x = clamp(cosine)
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))


def match_label(score: Column) -> Column:
    return F.when(score >= L.EXACT, "Exact Match").when(score >= L.NEAR, "Near Match").otherwise("Paraphrased Overlap")


def issue_summary(issues: Column, most: int = 3) -> Column:
    """The first distinct issues, white space collapsed, with dots where there are more."""
    kept = F.array_distinct(F.filter(F.transform(issues, collapse), lambda x: x != ""))
    return F.concat(F.array_join(F.slice(kept, 1, most), "; "), F.when(F.size(kept) > most, "; ...").otherwise(""))


def chunk_token_set(c) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$") & ~x.isin(L.CHUNK_STOPWORDS)))


def cache_key(c, most: int = 1200) -> Column:
    return F.substring(collapse(F.lower(_text(c))), 1, most)


def preview(c, most: int = 170) -> Column:
    t = _text(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def file_name(url) -> Column:
    """The last part of a URL's path with escapes resolved; a plus sign stays one."""
    path = F.coalesce(F.try_parse_url(_text(url), F.lit("PATH")), F.lit(""))
    last = F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.when(F.coalesce(last, F.lit("")) == "", "PDF Source").otherwise(last)


def is_pdf(url, content_type=None) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(_text(url), F.lit("PATH")), F.lit("")))
    by_type = F.lower(_text(content_type)).contains("application/pdf") if content_type is not None else F.lit(False)
    return path.endswith(".pdf") | by_type


def reference_mode(query) -> Column:
    """url for an address, topic for other words, web for none."""
    q = collapse(query)
    return F.when(F.lower(q).rlike("^https?://"), "url").when(q != "", "topic").otherwise("web")


def half_even(value: Column, digits: int = 1) -> Column:
    """Rounded to even by the shortest decimal that reads as the value; only for showing."""
    return F.bround(value, digits)


def sample_indexes(total: Column, most: Column) -> Column:
    """Evenly spaced page numbers from the first to the last, at most ``most``."""
    step = (total - 1) / F.greatest(most - 1, F.lit(1))
    spaced = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.bround(i * step).cast("int"))))
    every = F.sequence(F.lit(0), total - 1)
    return F.when((total <= 0) | (most <= 0), F.array().cast("array<int>")).when(total <= most, every).when(most == 1, F.array(F.lit(0))).otherwise(spaced)


def inverted_abstract(index: Column) -> Column:
    """A text from a map of words to their positions; of two words at a place the later in the map stays."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), (-i).alias("i"), x["w"].alias("w")))
    ordered = F.array_sort(numbered)
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["p"] != x["p"]))
    return collapse(F.array_join(F.filter(F.transform(first, lambda x: x["w"]), lambda w: w != ""), " "))
