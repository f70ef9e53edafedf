"""Fixed values that results depend on: word lists, maps, patterns and weights."""

# Stopwords of the main list, in natural order.
STOPWORDS = (
    "a about after again against all am an and any are as at be because been before being below above between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not "
    "now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves"
).split()
# Stopwords of the chunk list, in natural order.
CHUNK_STOPWORDS = (
    "a about after all also an and any are as at be been but by can do for from had has have if in into is it its more most no not of on or our out over so such than "
    "that the their them then there these they this to too under up was we were what when which while with you your"
).split()
# Suffixes; the first of the first list that fits is cut, else the first of the second.
SUFFIXES = "ization ational fulness ousness iveness tional ement".split(), "ingly edly ments ment ation ities ity ing ers er ed ly es s".split()
# Canonical terms and their variants.
CANONICAL = {
    "analysis": "analyze analyses analytical",
    "methodology": "method methods approach approaches",
    "framework": "model models frameworks",
    "outcome": "result results outcomes",
    "finding": "evidence findings",
    "inference": "interpret interpretation infer",
    "compare": "comparison comparing compared",
    "evaluate": "evaluation evaluating evaluated",
    "learner": "student students",
    "learn": "learning education educational",
}
VARIANTS = {v: k for k, vs in CANONICAL.items() for v in vs.split()}
# Marks of paragraphs that are no running text.
NOISE_MARKS = ["copyright", "all rights reserved", "isbn", "library of congress", "cataloging", "printed in", "edition", "visit www", "http://", "https://", "www."]
# Phrases and what replaces them, in order.
SWAPS = [
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("in the event that", "if"),
    ("a large number of", "many"),
    ("has the ability to", "can"),
    ("it is important to note that", "notably,"),
    ("utilize", "use"),
    ("demonstrate", "show"),
    ("furthermore", "in addition"),
    ("therefore", "as a result"),
]
# What a rewritten text begins with, by tone.
TONES = {"professional": "From a professional standpoint", "creative": "Seen through a more imaginative lens", "formal": "From a formal perspective", "casual": "Put simply"}
DEFAULT_TONE = "In clearer terms"
# Characters of extracted text and their replacements.
LETTERS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", "​": ""}
# Patterns.
TOKEN = "[a-z0-9']+"
SENTENCE = "[^.!?\\n]+[.!?]?"
TAG = "<[^>]+>"
PARAGRAPH = r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*+"
#: Unicode white space as a class for Java patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
# Weights and limits of the scores.
SPAN_WEIGHTS = {"token": 0.34, "char": 0.18, "sequence": 0.18, "concept": 0.18, "angle": 0.12}
PAIR_WEIGHTS = {"span": 0.68, "longest": 0.20, "shingle": 0.12}
RANK_WEIGHTS = {"phrase": 0.42, "concept": 0.22, "char": 0.16, "leading": 0.12, "title": 0.08}
MIN_SCORE, SNAPSHOT_SCORE, COMPARE_SCORE = 0.58, 0.56, 0.60
CANDIDATES, SHINGLE_HIT, CONCEPT_HIT, MIN_HITS = 48, 3, 1, 2
EXACT, NEAR = 0.92, 0.78
