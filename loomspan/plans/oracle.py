"""The same queries as DuckDB SQL, built from the same fixed values."""

from __future__ import annotations

from functools import reduce

from loomspan.functions import lexicon as L
from loomspan.functions.rewrite import ADVICE, HIGH_VERDICT, OTHER_ADVICE, VERDICTS

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


def norm(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def stem(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 2} THEN left({x}, length({x}) - {len(s)})" for s in (*L.SUFFIXES[0], *L.SUFFIXES[1]))
    return f"CASE WHEN length({x}) <= 3 THEN {x} {cases} ELSE {x} END"


def canonical(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in L.VARIANTS.items()) + f" ELSE {x} END"


def content(x: str) -> str:
    stems = f"list_transform({tokens(x)}, lambda t: {stem('t')})"
    kept = f"list_filter({stems}, lambda s: s NOT IN ({', '.join(map(q, L.STOPWORDS))}))"
    return f"list_transform(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {stems} END, lambda c: {canonical('c')})"


def shingles(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN [] ELSE list_distinct(list_transform(range(0, greatest(len({x}) - 2, 1)), lambda i: array_to_string({x}[i + 1:i + 3], ' '))) END"


def grams(x: str) -> str:
    # four cuts into runs of four, each a place further on, are all runs of four
    cuts = " || ".join(f"regexp_extract_all(substr({x}, {i}), '.{{4}}')" for i in range(1, 5))
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < 4 THEN [{x}] ELSE {cuts} END"


def cleaned(x: str) -> str:
    t = reduce(lambda a, p: f"replace({a}, {q(p[0])}, {q(p[1])})", L.LETTERS.items(), f"coalesce({x}, '')")
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '([A-Za-z])-{SPACE}*\\n{SPACE}*([A-Za-z])', '\\1\\2', 'g')"
    return f"regexp_replace({t}, '(?m)^{SPACE}*[0-9]{{1,4}}{SPACE}*$', '', 'g')"


def pieces(name: str, key: str) -> str:
    """CTEs: every sentence pattern match of a table's texts with its place."""
    pattern = r"([.!?\n]*)([^.!?\n]+[.!?]?)"
    return f"""
raw_{name} AS (SELECT {key}, unnest(regexp_extract_all(text, '{pattern}', 1)) AS gap, unnest(regexp_extract_all(text, '{pattern}', 2)) AS s, unnest(range(0, len(regexp_extract_all(text, '{pattern}', 2)))) AS span_id FROM {name}),
placed_{name} AS (SELECT {key}, span_id, s, sum(length(gap) + length(s)) OVER (PARTITION BY {key} ORDER BY span_id) AS e FROM raw_{name}),
sent_{name} AS (SELECT {key}, span_id, (e - length(s))::BIGINT AS start_at, e::BIGINT AS end_at, {collapse('s')} AS raw, {norm(collapse('s'))} AS norm FROM placed_{name} WHERE len({tokens(collapse('s'))}) >= 3)"""


def features(name: str, key: str) -> str:
    return f"""feat_{name} AS (SELECT {key}, span_id, {content('raw')} AS c FROM sent_{name}),
post_{name} AS (SELECT {key}, span_id, 's' AS k, unnest({shingles('c')}) AS t FROM feat_{name} UNION ALL SELECT {key}, span_id, 'c', unnest(list_distinct(c)) FROM feat_{name})"""


def counted(name: str, key: str, of: str) -> str:
    return f"{name}_n AS (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest({of}) AS t FROM {name}) GROUP BY ALL), {name}_l AS (SELECT {key}, sqrt(sum(n * n)) AS l FROM {name}_n GROUP BY {key})"


def cosine(of: str) -> str:
    return f"""WITH {counted('documents', 'doc_id', of)}, {counted('benchmark', 'item_id', of)},
dots AS (SELECT doc_id, item_id, sum(d.n * b.n) AS dot FROM documents_n d JOIN benchmark_n b USING (t) GROUP BY ALL),
cos AS (SELECT doc_id, item_id, least(1.0, dot / (d.l * b.l)) AS x FROM dots JOIN documents_l d USING (doc_id) JOIN benchmark_l b USING (item_id))
"""


REPEATED = f"WITH {pieces('documents', 'doc_id')}, rep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS times FROM sent_documents) WHERE times > 1)"
ISLANDS = f"""{REPEATED}, marked AS (SELECT doc_id, start_at, end_at, max(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rep),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_at, end_at ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT doc_id, min(start_at) AS text_start, max(end_at) AS text_end FROM numbered GROUP BY doc_id, island)"""
BODY = collapse("text")
COVERED = f"{ISLANDS}, pct AS (SELECT d.doc_id, coalesce(sum(text_end - text_start), 0) * 100 / greatest(length(d.text), 1) AS p FROM documents d LEFT JOIN merged USING (doc_id) GROUP BY d.doc_id, d.text)"
LIST_PAIRS = "pairs AS (SELECT a.doc_id AS pair_id, a.text, b.text AS reference_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def sample(most: int) -> str:
    seg = max(900, most // 3)
    n = f"length({BODY})"
    three = f"concat_ws(' ', trim(left({BODY}, {seg})), trim(substr({BODY}, greatest({n} // 2 - {seg // 2}, 0) + 1, {seg})), trim(right({BODY}, {seg})))"
    return f"SELECT doc_id, CASE WHEN {n} <= {most} THEN {BODY} ELSE trim(left({three}, {most})) END AS sample FROM documents"


def words(x: str) -> str:
    return f"CASE WHEN {collapse(x)} = '' THEN [] ELSE string_split({collapse(x)}, ' ') END"


def chunk_rows(source: str, key: str, text: str, name: str, most: int | None = 180) -> str:
    terms = f"list_distinct(list_filter({tokens('t')}, lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({', '.join(map(q, L.CHUNK_STOPWORDS))})))"
    return f"""{name}_w AS (SELECT {key}, {words(text)} AS w FROM {source}),
{name}_h AS (SELECT {key}, w, unnest(list_filter(range(0, len(w), 190), lambda i: i = 0 OR i + 70 < len(w))) AS i FROM {name}_w WHERE len(w) > 0),
{name} AS (SELECT {key}, i // 190 AS chunk, i AS start_at, least(i + 260, len(w)) AS end_at, array_to_string(w[i + 1:i + 260], ' ') AS t, {terms} AS terms FROM {name}_h{f" WHERE i // 190 < {most}" if most else ""})"""


def is_noise() -> str:
    t, toks = "t", tokens("t")
    digits = f"len(list_filter({toks}, lambda x: regexp_matches(x, '[0-9]')))"
    upper = f"len(list_filter(string_split({t}, ' '), lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))"
    letters = f"coalesce(list_sum(list_transform({toks}, lambda x: length(x))), 0)"
    marked = " OR ".join(f"contains(lower({t}), {q(m)})" for m in L.NOISE_MARKS)
    n = f"len({toks})"
    return f"""(t = '' OR {marked} OR {n} = 0 OR {digits} >= 0.22 * {n} OR ({n} <= 20 AND {upper} >= greatest(4, {n} // 2)) OR ({n} >= 10 AND {letters} < 3.7 * {n} AND {digits} >= 2))"""


def noise() -> str:
    return f"""SELECT doc_id, {is_noise()} AS noise
FROM (SELECT doc_id, {BODY} AS t FROM documents)"""


def chunk_scores(source: str) -> str:
    return f"""{chunk_rows(source, 'pair_id', 'text', 'x', None)}, {chunk_rows(source, 'pair_id', 'reference_text', 'y', None)},
s AS (SELECT x.pair_id, x.chunk AS research_chunk, y.chunk AS reference_chunk, len(list_intersect(x.terms, y.terms)) AS hits, len(list_intersect(x.terms, y.terms)) / sqrt(len(x.terms) * greatest(1, len(y.terms))) AS score FROM x JOIN y ON x.pair_id = y.pair_id WHERE len(list_intersect(x.terms, y.terms)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, research_chunk ORDER BY hits DESC, reference_chunk) AS r FROM s)"""


def kept_chunks(side: str, c: str) -> str:
    """CTEs: the chunks of one side that stay, joined within the budget of words."""
    return f"""{c}_n AS (SELECT pair_id, count(*) AS n FROM {c} GROUP BY pair_id),
{c}_f AS (SELECT DISTINCT pair_id, unnest(CASE WHEN n > 4 THEN [0, n // 2, n - 1, n // 4, 3 * n // 4] ELSE [0, n // 2, n - 1] END) AS chunk FROM {c}_n),
{c}_o AS (SELECT pair_id, {side} AS chunk, min(o) AS o FROM ordered GROUP BY ALL),
{c}_p AS (SELECT pair_id, chunk, row_number() OVER (PARTITION BY pair_id ORDER BY o) AS p FROM {c}_o ANTI JOIN {c}_f USING (pair_id, chunk)),
{c}_m AS (SELECT pair_id, chunk FROM {c}_p JOIN (SELECT pair_id, 14 - count(*) AS room FROM {c}_f GROUP BY pair_id) USING (pair_id) WHERE p <= room),
{c}_k AS (SELECT pair_id, chunk, t, end_at - start_at AS m, coalesce(sum(end_at - start_at) OVER (PARTITION BY pair_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it FROM {c} JOIN (SELECT * FROM {c}_f UNION ALL SELECT * FROM {c}_m) USING (pair_id, chunk)),
{c}_j AS (SELECT pair_id, string_agg(array_to_string(string_split(t, ' ')[1:least(m, 5200 - before_it)], ' '), chr(10) || chr(10) ORDER BY chunk) AS t, count(*) AS used FROM {c}_k WHERE before_it < 5200 GROUP BY pair_id)"""


def reduced(long: int) -> str:
    return f"""WITH {LIST_PAIRS}, n AS (SELECT *, len({words('text')}) AS a, len({words('reference_text')}) AS b FROM pairs), cut AS (SELECT * FROM n WHERE greatest(a, b) >= {long} AND least(a, b) > 0),
{chunk_scores('cut')}, ordered AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, research_chunk) AS o FROM r WHERE r = 1 AND score >= 0.12),
{kept_chunks('research_chunk', 'x')}, {kept_chunks('reference_chunk', 'y')},
done AS (SELECT n.pair_id, coalesce(y_j.t, n.reference_text) AS reference_text, coalesce(x_j.t, n.text) AS text, x_j.t IS NOT NULL AS used_chunking, b AS reference_words, a AS research_words,
coalesce(y_n.n, 0) AS reference_chunks, coalesce(x_n.n, 0) AS research_chunks, coalesce(y_j.used, 0) AS reference_used, coalesce(x_j.used, 0) AS research_used
FROM n LEFT JOIN x_j USING (pair_id) LEFT JOIN y_j USING (pair_id) LEFT JOIN x_n USING (pair_id) LEFT JOIN y_n USING (pair_id))
SELECT *, len({words('reference_text')}) AS reference_words_used, len({words('text')}) AS research_words_used FROM done"""


def searched() -> str:
    """Paragraphs are parted by blank lines."""
    stop = ", ".join(map(q, L.STOPWORDS))
    good = lambda x: f"list_distinct(list_filter({x}, lambda v: length(v) >= 4 AND v NOT IN ({stop})))"
    return f"""WITH own AS (SELECT doc_id, {cleaned('text')} AS text FROM documents),
b AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda v: v <> '')) AS block, unnest(range(0, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda v: v <> '')))) AS i FROM own),
p AS (SELECT doc_id, i, block, {tokens('t')} AS toks FROM (SELECT *, {collapse('block')} AS t FROM b) WHERE NOT {is_noise()} AND len({tokens('t')}) >= 14),
l AS (SELECT doc_id, {good("flatten(list(toks ORDER BY i))[1:220]")} AS focus FROM (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it FROM p) WHERE before_it < 220 GROUP BY doc_id),
k AS (SELECT doc_id, i, array_to_string(toks[1:26], ' ') AS query, len(list_intersect(terms, focus)) + (i < 4)::INTEGER AS a, length(block) - length(replace(block, ';', '')) + greatest(0, length(block) - length(replace(block, chr(10), '')) - 1) AS marks, len(terms) AS c, least(len(toks), 26) AS d
FROM (SELECT *, {good('toks')} AS terms FROM p) JOIN l USING (doc_id) WHERE len(terms) >= 6),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, marks, c DESC, d DESC, i) AS o, query FROM k
UNION ALL SELECT doc_id, 0, '"' || array_to_string(arg_min(toks, i)[1:18], ' ') || '"' FROM p GROUP BY doc_id),
u AS (SELECT doc_id, min(o) AS o, arg_min(query, o) AS query FROM e GROUP BY doc_id, {norm('query')}),
found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS position, query FROM u QUALIFY position <= 4),
t AS (SELECT doc_id, unnest({tokens('text')}) AS w, unnest(range(0, len({tokens('text')}))) AS at_place FROM own WHERE doc_id NOT IN (SELECT doc_id FROM found)),
c AS (SELECT doc_id, w, count(*) AS n, min(at_place) AS at_place FROM t WHERE length(w) >= 4 AND w NOT IN ({stop}) AND NOT regexp_full_match(w, '[0-9]+') GROUP BY ALL),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_place) <= 12)
SELECT * FROM found UNION ALL SELECT doc_id, 1, string_agg(w, ' ' ORDER BY at_place) FROM best GROUP BY doc_id"""


def tone(name: str) -> str:
    swap = reduce(lambda x, p: f"regexp_replace({x}, '(?i)\\b{p[0]}\\b', {q(p[1])}, 'g')", L.SWAPS, "s")
    parts = f"list_transform(string_split(regexp_replace({BODY}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: {swap})"
    return f"""SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE {q(L.TONES[name] + ', ')} || lower(left(p[1], 1)) || substr(p[1], 2) || CASE WHEN len(p) > 1 THEN ' ' || array_to_string(p[2:], ' ') ELSE '' END END AS rewritten
FROM (SELECT conv_id, turn, {BODY} AS t, {parts} AS p FROM conversations)"""


WINDOWS = f"""WITH {pieces('documents', 'doc_id')},
own AS (SELECT doc_id, text, {BODY} AS b, len({tokens(BODY)}) AS n FROM documents WHERE len({tokens(BODY)}) >= 6),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY span_id) - 1 AS i, (e - length(s))::BIGINT AS a, e::BIGINT AS e FROM placed_documents WHERE {collapse('s')} <> ''),
c AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id),
w AS (SELECT h.doc_id, h.i, h.a, t.e FROM s h JOIN c USING (doc_id) JOIN s t ON t.doc_id = h.doc_id AND t.i = least(h.i + 4, m) - 1 WHERE h.i % 2 = 0 AND (h.i = 0 OR h.i + 2 < m) AND m >= 3),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_id, a, e, {collapse('substr(text, a + 1, e - a)')} AS raw FROM w JOIN own USING (doc_id) WHERE n > 170 AND len({tokens(collapse('substr(text, a + 1, e - a)'))}) >= 6)
SELECT doc_id, span_id, 'window' AS kind, a AS start_at, e AS end_at, raw FROM k WHERE span_id < 180
UNION ALL
SELECT doc_id, 0, 'paragraph', length(text) - length(ltrim(text, chr(10))), length(rtrim(text, chr(10))), b FROM own WHERE doc_id NOT IN (SELECT doc_id FROM k)"""

# Spans of documents: paragraphs, or sentences where there are none; every item is one paragraph.
SPANS = f"""WITH windows AS ({WINDOWS}), {pieces('documents', 'doc_id')},
spans AS (SELECT doc_id, span_id, raw FROM windows UNION ALL SELECT doc_id, span_id, raw FROM sent_documents WHERE doc_id NOT IN (SELECT doc_id FROM windows))"""
PRIOR = f"""{SPANS}, first AS (SELECT doc_id, raw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_id) AS n FROM spans) WHERE n <= 260),
d AS (SELECT DISTINCT doc_id, unnest({content('raw')}) AS c FROM first), b AS (SELECT DISTINCT item_id, unnest({content('text')}) AS c FROM benchmark),
dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT s.doc_id, 'Item ' || s.item_id AS title, round(s.n / (dn.n + bn.n - s.n), 6) AS prior FROM (SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (c) GROUP BY ALL) s JOIN dn USING (doc_id) JOIN bn USING (item_id)"""
SHINGLE_PAIRS = f"""SELECT doc_id, item_id FROM (SELECT doc_id, unnest({shingles('t')}) AS s FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)) JOIN (SELECT item_id, unnest({shingles('t')}) AS s FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark)) USING (s) GROUP BY ALL HAVING count(*) >= 5"""
LEXICAL = f"""WITH pairs AS ({SHINGLE_PAIRS}), tok AS ({cosine(content('text'))} SELECT * FROM cos), chr AS ({cosine(grams(norm('text')))} SELECT * FROM cos),
d AS (SELECT doc_id, list_distinct({content('text')}) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM pairs)), b AS (SELECT item_id, list_distinct({content('text')}) AS c FROM benchmark),
j AS (SELECT doc_id, item_id, len(list_intersect(d.c, b.c)) AS n, len(d.c) AS a, len(b.c) AS z FROM pairs JOIN d USING (doc_id) JOIN b USING (item_id))
SELECT doc_id, item_id, round(0.34 * coalesce(tok.x, 0) + 0.18 * coalesce(chr.x, 0) + 0.18 * n / (a + z - n) + 0.12 * (1 - sqrt(greatest(0.0, 1 - coalesce(tok.x, 0) * coalesce(tok.x, 0)))), 5) AS score FROM j LEFT JOIN tok USING (doc_id, item_id) LEFT JOIN chr USING (doc_id, item_id)"""
OF_SENTENCES = f"""WITH windows AS ({WINDOWS}), {pieces('documents', 'doc_id')},
p AS (SELECT s.doc_id, s.span_id, coalesce(min(w.span_id), -1) AS paragraph_id FROM sent_documents s LEFT JOIN windows w ON w.doc_id = s.doc_id AND s.start_at >= w.start_at AND s.start_at < w.end_at GROUP BY ALL)
SELECT paragraph_id, count(*) AS n FROM p GROUP BY paragraph_id"""

ORACLE_SQL = {
    "source_prior": PRIOR,
    "lexical_score": LEXICAL,
    "paragraph_of_sentence": OF_SENTENCES,
    "normalize_text": f"SELECT doc_id, {collapse(cleaned('text'))} AS collapsed, {norm(cleaned('text'))} AS norm FROM documents",
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) AS digit_tokens, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::BIGINT AS letters FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "stem_vocab": f"SELECT token, {stem('token')} AS stem, {canonical('(' + stem('token') + ')')} AS concept, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM documents) GROUP BY token)",
    "concept_freq": f"SELECT concept, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({content('text')}) AS concept FROM documents) GROUP BY concept",
    "word_shingles": f"SELECT item_id, unnest({shingles('c')}) AS shingle FROM (SELECT item_id, {content('text')} AS c FROM benchmark)",
    "document_shingles": f"SELECT shingle, count(*) AS docs FROM (SELECT unnest({shingles('c')}) AS shingle FROM (SELECT {content('text')} AS c FROM documents)) GROUP BY shingle",
    "char_grams": f"SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, unnest({grams('t')}) AS gram FROM (SELECT item_id, {norm('text')} AS t FROM benchmark)) GROUP BY ALL",
    "query_keywords": f"""WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS w, unnest(range(0, len({tokens('text')}))) AS p FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM t WHERE length(w) >= 4 AND w NOT IN ({', '.join(map(q, L.STOPWORDS))}) AND NOT regexp_full_match(w, '[0-9]+') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM c)
SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS keywords FROM documents LEFT JOIN (SELECT * FROM r WHERE r <= 8) USING (doc_id) GROUP BY doc_id""",
    "noise_paragraphs": noise(),
    "sentence_spans": f"WITH {pieces('documents', 'doc_id')} SELECT doc_id, span_id, start_at, end_at, raw, norm FROM sent_documents",
    "paragraph_windows": WINDOWS,
    "distributed_sample": sample(3000),
    "analysis_text": f"""SELECT doc_id, CASE WHEN n <= 600 THEN array_to_string(w, ' ') ELSE array_to_string(CASE WHEN p[1] = p[2] AND p[2] = p[3] THEN p[1:1] WHEN p[1] = p[2] THEN [p[1], p[3]] WHEN p[2] = p[3] OR p[1] = p[3] THEN p[1:2] ELSE p END, chr(10) || chr(10)) END AS analysis
FROM (SELECT doc_id, w, n, [array_to_string(w[1:500], ' '), array_to_string(w[greatest(n // 2 - 250, 0) + 1:greatest(n // 2 - 250, 0) + 500], ' '), array_to_string(w[greatest(n - 500, 0) + 1:], ' ')] AS p FROM (SELECT doc_id, {words('text')} AS w, len({words('text')}) AS n FROM documents))""",
    "shingle_candidates": f"""WITH d AS (SELECT doc_id, unnest({shingles('t')}) AS s FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)), b AS (SELECT item_id, unnest({shingles('t')}) AS s FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark))
SELECT doc_id, item_id, count(*) AS hits FROM d JOIN b USING (s) GROUP BY ALL HAVING count(*) >= 5""",
    "weighted_candidates_top48": f"""WITH {pieces('documents', 'doc_id')}, {pieces('benchmark', 'item_id')}, {features('documents', 'doc_id')}, {features('benchmark', 'item_id')},
h AS (SELECT d.doc_id, d.span_id, b.item_id AS ref_id, b.span_id AS ref_span, sum(CASE WHEN k = 's' THEN 3 ELSE 1 END)::BIGINT AS hits FROM post_documents d JOIN post_benchmark b USING (k, t) GROUP BY ALL HAVING hits >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, span_id ORDER BY hits DESC, ref_id, ref_span) AS place FROM h) SELECT * FROM r WHERE place <= 48""",
    "token_cosine": cosine(content("text")) + f"SELECT doc_id, item_id, round(x, 6) AS cosine, round(1 - sqrt(greatest(0.0, 1 - x * x)), 5) AS angle, CASE WHEN x >= {L.EXACT} THEN 'Exact Match' WHEN x >= {L.NEAR} THEN 'Near Match' ELSE 'Paraphrased Overlap' END AS label FROM cos",
    "suggestions": cosine(content("text")) + f"SELECT doc_id, item_id, label, CASE label WHEN 'Exact Match' THEN {q(ADVICE['Exact Match'])} WHEN 'Near Match' THEN {q(ADVICE['Near Match'])} ELSE {q(ADVICE['Paraphrased Overlap'])} END AS advice FROM (SELECT *, CASE WHEN x >= {L.EXACT} THEN 'Exact Match' WHEN x >= {L.NEAR} THEN 'Near Match' ELSE 'Paraphrased Overlap' END AS label FROM cos)",
    "char_cosine": cosine(grams(norm("text"))) + "SELECT doc_id, item_id, round(x, 6) AS cosine FROM cos",
    "concept_jaccard": f"""WITH d AS (SELECT doc_id, list_distinct({content('text')}) AS c FROM documents), b AS (SELECT item_id, list_distinct({content('text')}) AS c FROM benchmark)
SELECT doc_id, item_id, round(n / (a + z - n), 6) AS jaccard FROM (SELECT doc_id, item_id, len(list_intersect(d.c, b.c)) AS n, len(d.c) AS a, len(b.c) AS z FROM d, b) WHERE n > 0""",
    "verbatim_containment": f"SELECT doc_id, item_id FROM (SELECT doc_id, {norm('text')} AS d FROM documents), (SELECT item_id, {norm('text')} AS b FROM benchmark) WHERE length(b) >= 40 AND contains(d, b)",
    "internal_repetition": f"{REPEATED} SELECT doc_id, start_at AS text_start, end_at AS text_end, raw, times, 'Internal Repetition' AS match_type, least(98.0, 70.0 + (times - 1) * 8)::DOUBLE AS score FROM rep",
    "merged_ranges": f"{ISLANDS} SELECT * FROM merged",
    "interval_coverage": f"{ISLANDS} SELECT doc_id, sum(text_end - text_start)::BIGINT AS covered FROM merged GROUP BY doc_id",
    "appraisal_bands": f"""{COVERED} SELECT doc_id, CASE WHEN p <= 0 THEN {q(VERDICTS[0][1])} WHEN p <= 30 THEN {q(VERDICTS[1][1])} WHEN p <= 50 THEN {q(VERDICTS[2][1])} ELSE {q(HIGH_VERDICT)} END AS verdict,
CASE WHEN p > 50 THEN {q(ADVICE['Exact Match'])} WHEN p > 20 THEN {q(ADVICE['Near Match'])} WHEN p > 0 THEN {q(ADVICE['Paraphrased Overlap'])} ELSE {q(OTHER_ADVICE)} END AS advice FROM pct""",
    "reference_dedup": f"""SELECT ref_id, title FROM (SELECT doc_id AS ref_id, source AS title, row_number() OVER (PARTITION BY lower({collapse('source')}), {norm('left(text, 240)')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
    "page_reference_dedup": f"""SELECT page_id AS ref_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY lower({collapse('url')}), CASE WHEN {collapse('url')} = '' THEN {norm('left(' + collapse('regexp_replace(html, ' + q('<[^>]+>') + ', ' + q(' ') + ', ' + q('g') + ')') + ', 240)')} END ORDER BY page_id) AS r FROM pages) WHERE r = 1""",
    "blend_sources": """WITH r AS (SELECT doc_id AS ref_id, CASE WHEN lang = 'en' THEN 'Crossref' ELSE 'Wikipedia' END AS source, row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) AS n FROM documents),
c AS (SELECT least(3, count(*)) AS web FROM r WHERE source = 'Wikipedia'),
p AS (SELECT ref_id, source, CASE WHEN source = 'Wikipedia' THEN CASE WHEN n <= 3 THEN 1 ELSE 2 END WHEN n <= 24 - web THEN 0 ELSE 2 END AS part FROM r, c)
SELECT * FROM (SELECT ref_id, source, row_number() OVER (ORDER BY part, ref_id) AS place FROM p) WHERE place <= 24""",
    "html_title": f"SELECT page_id, left({collapse('regexp_replace(regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1), ' + q('<[^>]+>') + ', ' + q(' ') + ', ' + q('g') + ')')}, 200) AS title FROM pages",
    "url_kind": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, ends_with(lower(path), '.pdf') AS pdf, CASE WHEN regexp_matches(lower(url), '^https?://') THEN 'url' WHEN trim(url) <> '' THEN 'topic' ELSE 'web' END AS mode,
CASE WHEN string_split(path, '/')[-1] = '' THEN 'PDF Source' ELSE url_decode(string_split(path, '/')[-1]) END AS file_name FROM p""",
    "openalex_abstract": f"SELECT item_id, {BODY} AS text FROM benchmark WHERE {BODY} <> ''",
    "word_chunks": f"WITH {chunk_rows('documents', 'doc_id', 'text', 'x')} SELECT doc_id, chunk, start_at, end_at, t AS text, len(terms) AS n_terms FROM x",
    "chunk_pairs": f"""WITH {LIST_PAIRS}, {chunk_scores('pairs')}
SELECT pair_id, research_chunk, reference_chunk, round(score, 6) AS score FROM r WHERE r = 1 AND score >= 0.12""",
    "long_doc_reduce": reduced(1500),
    "search_queries": searched(),
    "tone_rewrite": tone("formal"),
    "presentation": f"SELECT doc_id, CASE WHEN length(text) > 170 THEN rtrim(left(text, 167)) || '...' ELSE text END AS preview, left({collapse('lower(text)')}, 1200) AS cache_key, lang || '; ' || source || '; x; ...' AS issues FROM documents",
    "topic_sources": """WITH r AS (SELECT source AS query, doc_id, 'https://papers.example/' || (doc_id % 700) AS url,
CASE lang WHEN 'fr' THEN 'Crossref' WHEN 'de' THEN 'arXiv' WHEN 'es' THEN 'DOAJ' ELSE 'Wikipedia' END AS source, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS place_of FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
counts AS (SELECT query, place_of, count(*) AS n FROM r WHERE place_of < 3 GROUP BY ALL),
gate AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query ORDER BY place_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it FROM counts),
taken AS (SELECT r.* FROM r LEFT JOIN gate g USING (query, place_of) WHERE place_of = 3 OR before_it < 24),
firsts AS (SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY place_of, doc_id) = 1),
few AS (SELECT *, row_number() OVER (PARTITION BY query, place_of = 3 ORDER BY place_of, doc_id) AS n FROM firsts QUALIFY n <= 24),
p AS (SELECT *, least(3, sum((place_of = 3)::INTEGER) OVER (PARTITION BY query)) AS pages FROM few),
parts AS (SELECT *, CASE WHEN place_of = 3 THEN CASE WHEN n <= 3 THEN 1 ELSE 2 END WHEN n <= 24 - pages THEN 0 ELSE 2 END AS part FROM p)
SELECT query, doc_id AS ref_id, source, row_number() OVER (PARTITION BY query ORDER BY part, place_of, doc_id) AS place FROM parts QUALIFY place <= 24""",
}
ORACLE_SQL |= {f"{name}_above": f"SELECT * FROM ({ORACLE_SQL[name]}) WHERE cosine >= 0.5" for name in ("token_cosine", "char_cosine")}
