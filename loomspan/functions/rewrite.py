"""Rule-based rewriting and presentation texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L
from loomspan.functions.text import collapse


def tone_rewrite(c, tone) -> Column:
    """Plainer phrases, and a first sentence that begins with the tone's words."""
    tone = F.lower(F.lit(tone) if isinstance(tone, str) else tone)
    sentences = F.filter(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda s: s != "")
    plain = F.transform(sentences, lambda s: reduce(lambda x, p: F.regexp_replace(x, rf"(?i)\b{p[0]}\b", p[1]), L.SWAPS, s))
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in L.TONES.items() for x in p]), tone), F.lit(L.DEFAULT_TONE))
    head = F.get(plain, F.lit(0))
    first = F.concat(prefix, F.lit(", "), F.lower(F.substring(head, 1, 1)), F.substring(head, F.lit(2), F.length(head)))
    rest = F.slice(plain, F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0)))
    return F.when(F.size(plain) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(first), rest), " "))


def rewrite_with_tone(c, tone, provided: Column | None = None) -> Column:
    """A provider's text where there is one, else the rules' text; empty for an empty text."""
    own = tone_rewrite(c, tone)
    best = own if provided is None else F.coalesce(F.nullif(collapse(provided), F.lit("")), own)
    return F.when(collapse(c) == "", "").otherwise(best)


# What is advised for each kind of match, and for any other.
ADVICE = {
    "Exact Match": "Quote and cite this source directly, or rewrite this passage from scratch in your own voice.",
    "Near Match": "Restructure sentence flow and add citation where the idea originates from the source.",
    "Paraphrased Overlap": "Keep the idea but vary argument structure and vocabulary, then cite the original source.",
}
OTHER_ADVICE = "Review this sentence and add citation or deeper rewrite to reduce similarity risk."
# Verdicts on a percentage of nothing, up to 30, up to 50, and above.
VERDICTS = [
    (0, "Great work. No overlap detected in the current reference set."),
    (30, "Low overlap. A few edits and citations should make this safer."),
    (50, "Moderate overlap. Rewrite key passages and add proper citations."),
]
HIGH_VERDICT = "High overlap detected. Heavy rewrite and attribution are required."


def suggestion(match_type: Column) -> Column:
    return reduce(lambda c, p: c.when(match_type == p[0], p[1]), list(ADVICE.items())[1:], F.when(match_type == "Exact Match", ADVICE["Exact Match"])).otherwise(OTHER_ADVICE)


def appraisal(percent: Column) -> Column:
    """The verdict on a reuse percentage; out of 0 to 100 counts as the nearer bound."""
    return reduce(lambda c, p: c.when(percent <= p[0], p[1]), VERDICTS[1:], F.when(percent <= 0, VERDICTS[0][1])).otherwise(HIGH_VERDICT)


def chat_text(payload: Column) -> Column:
    """The first choice's message, whether its content is a text or a list of parts."""
    plain = F.get_json_object(payload, "$.choices[0].message.content")
    parts = F.from_json(plain, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""), "\n")
    is_list = F.coalesce(F.ltrim(plain).startswith("["), F.lit(False)) & parts.isNotNull()
    return F.trim(F.coalesce(F.when(is_list, joined).otherwise(plain), F.lit("")))
