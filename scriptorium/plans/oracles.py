"""SQL for DuckDB that gives the rows of the queries, written on its own terms.

Its regular expressions know no look-around and only ASCII word boundaries, so
letters beyond ASCII are mapped to underscores first, and sentences are cut at marks
that are put in by replacement.
"""

from __future__ import annotations

import re

from scriptorium.functions import lexicon as lx
from scriptorium.plans import demo


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def asc(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{1FFF}}]', '_', 'g')"


def has(x: str, p: str, cased: bool = False) -> str:
    return f"regexp_matches({x}, {lit(('' if cased else '(?i)') + p)})"


def hits(x: str, p: str, cased: bool = False) -> str:
    return f"len(regexp_extract_all({x}, {lit(('' if cased else '(?i)') + p)}))"


def nw(x: str) -> str:
    return hits(x, lx.W2, True)


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {lit(lx.W2)}), lambda w: replace(lower(w), '’', ''''))"


def opening(x: str, n: int = 3) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), {lit(lx.W2)})[1:{n}], ' ')"


#: What RE2 lacks: "not" is no negation before these words, so such pairs are counted and taken off.
NOT_ONLY, NOT_PAIR = r"(?!\s+(?:only|simply|merely)\b)", r"\bnot\s+(?:only|simply|merely)\b"
STRIP = "'^\\s+|\\s+$', '', 'g'"
DOCS = f"docs AS (SELECT doc_id, {demo.TEXT} AS text FROM documents)"
#: a is the ASCII form of a sentence, for regular expressions; it is as long as the sentence.
SEGMENTS = f"""{DOCS},
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs),
lines0 AS (SELECT *, regexp_replace(line, {STRIP}) AS core FROM raw),
lines1 AS (SELECT *, {asc('core')} AS acore, coalesce(sum(length(line) + 1) OVER w, 0)::INT AS start FROM lines0
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
heads AS (SELECT *, CASE WHEN core <> '' AND {nw('acore')} <= 16 AND {has('acore', lx.SECTION_HEADING)} THEN
  CASE {' '.join('WHEN ' + ' OR '.join(f"starts_with(h, {lit(s)})" for s in starts) + f' THEN {lit(name)}' for name, starts in lx.SECTIONS)} ELSE 'other' END END AS label
  FROM (SELECT *, lower(regexp_replace(core, {lit(lx.SECTION_NUMBER)}, '')) AS h FROM lines1)),
lines AS (SELECT doc_id, line_no, start, line, core, coalesce(last_value(label IGNORE NULLS) OVER w, 'other') AS section,
  CASE WHEN core <> '' THEN (sum(CASE WHEN core <> '' THEN 1 ELSE 0 END) OVER w - 1)::INT END AS paragraph_index FROM heads
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, string_split(regexp_replace(core, '([.!?]\\s+)([A-Z\\[]|\\*\\*)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM lines WHERE core <> ''),
pieces AS (SELECT doc_id, line_no, paragraph_index, section, start + length(line) - length(regexp_replace(line, '^\\s+', '')) AS pos0, unnest(parts) AS piece,
  (generate_subscripts(parts, 1) - 1)::INT AS sentence_index FROM cut),
placed AS (SELECT *, regexp_replace(piece, '\\s+$', '') AS text, (pos0 + coalesce(sum(length(piece)) OVER w, 0))::INT AS start FROM pieces
  WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sents0 AS (SELECT *, {asc('text')} AS a, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sentence_index) - 1)::INT AS index FROM placed WHERE text <> ''),
sents AS (SELECT *, section IN ('references', 'appendix') OR contains(text, chr(9)) OR contains(text, ' | ') OR starts_with(text, '|') OR contains(text, '$$')
  OR contains(text, '```') OR {has('a', '^[0-9]+(?:[.][0-9]+)*[.]?$')} OR {has('a', lx.PROTECTED_LINE)} OR {has('a', lx.CAPTION)} OR {has('a', lx.NUMBERED_HEADING, True)}
  OR {has('a', lx.BARE_HEADING)} OR {has('a', lx.FORM_LABEL)} OR {has('a', r'\bEmail\s*:\s*\S+@\S+')} OR {has('a', r'^\S+@\S+$')}
  OR ({nw('a')} <= 20 AND NOT {has('text', lx.SENTENCE_END)} AND ({has('a', lx.INSTITUTION)} OR NOT {has('a', lx.AUXILIARY)})) AS protected FROM sents0)"""


def _three(a: str) -> str:
    sizes = f"list_transform(string_split({a}, ','), lambda p: {nw('p')})"
    starts = f"list_unique(list_transform(string_split({a}, ','), lambda p: coalesce(({words('p')})[1], '')))"
    spread = f"(list_max({sizes}) - list_min({sizes}))"
    return f"(len(string_split({a}, ',')) = 3 AND list_min({sizes}) >= 3 AND {spread} <= 4 AND ({starts} <= 2 OR {spread} <= 2))"


def _any(*patterns: str) -> str:
    return has("a", "|".join(f"(?:{p})" for p in patterns))


_VOCABULARY = " + ".join(f"contains(lower(a), {lit(v)})::INT" for v in lx.VOCABULARY if v != "robust")
_HEDGES = " + ".join(f"{has('a', p)}::INT" for p in lx.HEDGES)
_DASHES = "(length(a) - length(replace(a, '—', '')))"
OWN_RISK = f"""least(100, CASE WHEN v > 0 THEN least(30, 10 + (v - 1) * 6) ELSE 0 END + CASE WHEN h > 0 THEN least(24, 8 + h * 5) ELSE 0 END
 + CASE WHEN {_any(*lx.TRANSITIONS_STRONG)} THEN 28 WHEN {_any(*lx.TRANSITIONS_MODERATE)} THEN 18 ELSE 0 END
 + CASE WHEN {_any(lx.SETUP, lx.DIMINISHMENT, lx.MORE_THAN, lx.TURNS_OUT)} THEN 22 ELSE 0 END + CASE WHEN {_any(lx.ANNOUNCEMENT)} THEN 14 ELSE 0 END
 + CASE WHEN {_any(lx.REFRAME)} THEN 16 ELSE 0 END + CASE WHEN {_any(lx.COMPOSED_ASIDE)} THEN 16 ELSE 0 END
 + CASE WHEN {_any(lx.BALANCED_ASIDES)} THEN 22 ELSE 0 END + CASE WHEN {_any(lx.QUESTION_LIST)} THEN 24 ELSE 0 END
 + CASE WHEN {_any(lx.THESIS_FIRST, lx.ACTUAL_WORK)} THEN 20 ELSE 0 END + CASE WHEN {_any(lx.OBSCURED, lx.UNIVERSAL)} THEN 16 ELSE 0 END
 + CASE WHEN {_three('a')} THEN 12 ELSE 0 END + CASE WHEN {_DASHES} >= 2 THEN 28 WHEN {_DASHES} = 1 THEN 10 ELSE 0 END
 + CASE WHEN {_any(lx.COLON_FRAME)} THEN 18 ELSE 0 END + CASE WHEN {_any(lx.VAGUE_TIME)} AND NOT {has('a', lx.YEAR)} THEN 8 ELSE 0 END)"""
SCORED = f"{SEGMENTS}, scored AS (SELECT *, ({OWN_RISK})::INT AS own_risk FROM (SELECT *, {_VOCABULARY} AS v, {_HEDGES} AS h FROM sents))"
#: Labelled rows with the features and the fixed model's probability.
LABELLED = f"""lab AS (SELECT doc_id AS id, quality AS label, lang, source, {', '.join(f'{x} AS {k}' for k, x in demo.FEATURES.items())}
 FROM documents JOIN labels USING (doc_id))"""
_LOGIT = " + ".join([f"{demo.BIAS}e0"] + [f"(({k} - 1.0e0) / 2.0e0) * {w}e0" for k, w in demo.WEIGHTS.items()])
JUDGED = f"{LABELLED}, judged AS (SELECT *, round(1e0 / (1e0 + exp(-greatest(-60e0, least(60e0, {_LOGIT})))), 6) AS probability FROM lab)"
AUC = """round((sum(p.n::DOUBLE * (n.less + 0.5e0 * n.same)) / greatest(1, max(t.p * t.n))), 4)"""


def _metrics(key: str) -> str:
    """Metrics at 0.5 by key, from `judged`; with the theta form of the area."""
    pos = f"SELECT {key} AS k, count_if(label = 1 AND probability >= 0.5) AS tp, count_if(label = 0 AND probability < 0.5) AS tn, count_if(label = 0 AND probability >= 0.5) AS fp, count_if(label = 1 AND probability < 0.5) AS fn FROM judged GROUP BY 1"
    return f"""SELECT k, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(pr, 4) AS precision, round(re, 4) AS recall,
 round(tn / greatest(1, tn + fp), 4) AS specificity, round(2 * pr * re / greatest(1e-12, pr + re), 4) AS f1,
 round(fp / greatest(1, fp + tn), 4) AS false_positive_rate, round(fn / greatest(1, fn + tp), 4) AS false_negative_rate
 FROM (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM ({pos}))"""


def _auc(key: str) -> str:
    """Every pair of a positive and a negative, compared."""
    return f"""SELECT {key.replace('x.', 'p.')} AS k, round(sum(CASE WHEN p.probability > n.probability THEN 1e0 WHEN p.probability = n.probability THEN 0.5e0 ELSE 0e0 END)
 / greatest(1, count(*)), 4) AS roc_auc FROM judged p JOIN judged n ON p.label = 1 AND n.label = 0 AND {key.replace('x.', 'p.')} = {key.replace('x.', 'n.')} GROUP BY 1"""


def _corpus() -> str:
    return """corpus AS (SELECT quality AS label, source AS provenance, lang AS source_family, 'x' AS discipline, 'unknown' AS document_type, cast(doc_id % 3 AS VARCHAR) AS editing_level,
 doc_id, (doc_id % 101)::DOUBLE AS a, (doc_id * 7 % 101)::DOUBLE AS b FROM documents JOIN labels USING (doc_id))"""


def _grams(n: int) -> str:
    return f"list_transform(range(1, greatest(1, len(w) - {n - 2})), lambda i: w[i:i + {n - 1}])"


#: Prose paragraphs of a document; as blank lines part them, each stands alone, and counts if it is no title, heading, form or table and has six words.
UNITS = f"""{SEGMENTS}, para AS (SELECT doc_id, paragraph_index, string_agg(regexp_replace(text, {STRIP}), ' ' ORDER BY sentence_index) AS p FROM sents WHERE NOT protected GROUP BY ALL),
placed_para AS (SELECT doc_id, p, 2 * (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1) AS line_no, regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), {STRIP}) AS clean FROM para),
judged_para AS (SELECT *, {asc('clean')} AS a FROM placed_para),
good AS (SELECT *, NOT (clean = '' OR contains(p, chr(9)) OR contains(p, ' | ') OR {has('a', lx.CAPTION)} OR {has('a', lx.NUMBERED_HEADING, True)} OR {has('a', lx.BARE_HEADING)} OR {has('a', lx.FORM_LABEL)}
  OR (line_no < 15 AND NOT {has('clean', r'[.!?]$')} AND {nw('a')} <= 30)) AND {nw('a')} >= 6 AS ok FROM judged_para),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS segment, CASE WHEN any_ok THEN clean ELSE p END AS text
  FROM (SELECT *, bool_or(ok) OVER (PARTITION BY doc_id) AS any_ok FROM good) WHERE ok OR NOT any_ok)"""


def _unit_scores() -> str:
    """`unit_scores`: doc_id, segment, n_words, peak, mean, structural, ai_signal of every unit."""
    token = "regexp_replace(t, '^[(),;:]+|[(),;:]+$', '', 'g')"
    tokens = "list_filter(string_split(clean, ' '), lambda t: t <> '')"
    numeric = f"len(list_filter({tokens}, lambda t: regexp_matches({token}, {lit(lx.NUMERIC_TOKEN)})))"
    rhythm = "CASE WHEN n >= 3 AND cv < 0.22e0 THEN 14 WHEN n >= 3 AND cv < 0.32e0 THEN 7 ELSE 0 END"
    return f"""{UNITS}, usplit AS (SELECT doc_id, segment, text AS unit, unnest(string_split(regexp_replace(regexp_replace(text, {STRIP}), '([.!?]\\s+)([A-Z\\[]|\\*\\*)', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS raw FROM units),
uclean AS (SELECT doc_id, segment, unit, regexp_replace(raw, {STRIP}) AS s, regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), {STRIP}) AS clean FROM usplit),
usents AS (SELECT *, {asc('s')} AS a, {asc('clean')} AS c FROM uclean WHERE s <> ''),
uprose AS (SELECT *, {nw('c')} >= 6 AND NOT {has('c', lx.CAPTION_STRICT)} AND NOT {has('c', lx.NUMBERED_TITLE, True)} AND NOT {has('c', lx.FORM_START)}
  AND NOT ({numeric} / greatest(1, len({tokens}))::DOUBLE >= 0.45e0) AS prose FROM usents),
ukept AS (SELECT * FROM (SELECT *, bool_or(prose) OVER (PARTITION BY doc_id, segment) AS any_prose FROM uprose) WHERE prose OR NOT any_prose),
urisk AS (SELECT *, ({OWN_RISK})::INT AS own_risk, {nw('a')} AS n, {opening('a', 2)} AS o FROM (SELECT *, {_VOCABULARY} AS v, {_HEDGES} AS h FROM ukept)),
ugroup AS (SELECT doc_id, segment, any_value(unit) AS unit, count(*) AS n, max(own_risk) AS peak, avg(own_risk) AS mean, min(n) AS least, max(n) AS most, avg(n) AS n_mean, stddev_pop(n) AS n_sd,
  count_if(o <> '') AS starts, count(DISTINCT nullif(o, '')) AS different, count_if({has('a', lx.REPORT_OPENING)}) AS reports FROM urisk GROUP BY doc_id, segment),
ucv AS (SELECT *, CASE WHEN n >= 2 AND n_mean > 0 THEN n_sd / n_mean ELSE 0e0 END AS cv FROM ugroup),
ustruct AS (SELECT *, {rhythm} + CASE WHEN n >= 4 AND least >= 12 AND most <= 38 THEN 6 ELSE 0 END
  + CASE WHEN starts >= 3 AND different <= greatest(1, floor(starts / 2)) THEN 8 ELSE 0 END + CASE WHEN reports >= 2 THEN 8 ELSE 0 END AS structural FROM ucv),
unit_scores AS (SELECT doc_id, segment, {nw(asc('unit'))}::INT AS n_words, peak, round(mean, 4) AS mean, structural,
  least(100, round_even(peak * 0.45e0 + mean * 0.35e0 + least(35, structural) * 0.20e0, 0))::INT AS ai_signal FROM ustruct)"""


def _evidence(text: str) -> dict[str, str]:
    """For each kind of evidence, the list of a text's pieces; for each claim qualifier, its count."""
    # a digit after a letter starts no number, and a word boundary of RE2 knows only ASCII
    letters = asc(text).replace("'_'", "'a'")
    number = (f"regexp_replace({letters}, '([A-Za-z])[0-9]', '\\1#', 'g')", r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:%|\b)", True)
    out = {}
    for k, (p, cased) in lx.EVIDENCE.items():
        column, p, cased = number if k == "numbers" else (letters if k in ("acronyms", "years") else text, p, cased)
        found = f"regexp_extract_all({column}, {lit(('' if cased else '(?i)') + p)})"
        out[k] = f"list_transform({found}, lambda h: regexp_replace(h, {STRIP}))" if k in ("headings", "reference_headings") else found
    negation = f"({hits(asc(text), lx.QUALIFIERS['negation'].replace(NOT_ONLY, ''))} - {hits(asc(text), NOT_PAIR)})"
    return out | {k: f"{negation if k == 'negation' else hits(asc(text), p)}::INT" for k, p in lx.QUALIFIERS.items()}


def _reference_features() -> str:
    def mean(x: str) -> str:
        return f"list_avg({x})"

    def deviation(x: str) -> str:
        return f"sqrt(list_avg(list_transform({x}, lambda y: pow(y - {mean(x)}, 2))))"

    def quantile(q: float) -> str:
        return f"round(list_aggregate(s, 'quantile_cont', {q}), 4)"

    steps = "list_transform(range(2, len({0}) + 1), lambda i: {0}[i] - {0}[i - 1])"
    return f"""WITH a AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: abs(x)::DOUBLE * 10) AS s FROM embeddings WHERE len(embedding) >= 3),
 b AS (SELECT *, {steps.format('s')} AS d1 FROM a), c AS (SELECT *, {steps.format('d1')} AS d2 FROM b),
 d AS (SELECT *, list_avg(list_transform(d2, lambda x: abs(x))) AS size FROM c), e AS (SELECT *, len(list_filter(d2, lambda x: abs(x) <= greatest(0.25e0, size * 0.5e0))) / len(d2)::DOUBLE AS regular FROM d)
 SELECT doc_id, round(exp(least(20e0, {mean('s')})), 4) AS perplexity, round({mean('s')}, 4) AS surprisal_mean, round({deviation('s')}, 4) AS surprisal_std,
 {quantile(0.1)} AS surprisal_p10, {quantile(0.5)} AS surprisal_p50, {quantile(0.9)} AS surprisal_p90, round(len(list_filter(s, lambda x: x <= 1.5e0)) / len(s)::DOUBLE, 4) AS low_surprisal_share,
 list_max(list_transform(string_split(array_to_string(list_transform(s, lambda x: CASE WHEN x <= 1.5e0 THEN '1' ELSE '0' END), ''), '0'), lambda r: length(r)))::INT AS longest_low_run,
 round(size, 4) AS curvature_abs_mean, round({deviation('d2')}, 4) AS curvature_std, round(regular, 4) AS curvature_regular_share, round_even(regular * 100, 0)::INT AS curvature_pct FROM e"""


def oracle_sql() -> dict[str, str]:
    kept = f"WITH {SEGMENTS} SELECT"
    scored = f"WITH {SCORED} SELECT"
    stop = "[" + ", ".join(sorted({lit(w) for w in lx.STOPWORDS})) + "]"
    common = "(" + ", ".join(map(lit, lx.COMMON_TOKENS)) + ")"
    signature = f"""CASE WHEN {has('a', lx.CONNECTOR)} THEN 'generic-transition opening' WHEN {has('a', r'^(this|these|it|the study|the chapter)\b')} THEN 'demonstrative or study-subject opening'
 WHEN {has('a', r'^[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s+(?:is|are|was|were|has|have|can|may|should)\b', True)} THEN 'noun phrase plus linking verb'
 WHEN {has('a', r'\b(?:is|are|was|were|be|been|being)\s+\w+ed\b')} THEN 'passive construction' ELSE 'other' END"""
    qualifiers = {k: p for k, p in lx.QUALIFIERS.items() if k != "negation"}
    counts = " UNION ALL ".join(f"SELECT doc_id, {lit(k)} AS key, {hits('a', p)} AS n FROM src" for k, p in qualifiers.items())
    years = f"list_transform(regexp_extract_all(a, {lit(lx.YEAR)}), lambda y: y::INT)"
    band = "CASE WHEN own_risk >= 70 THEN 'high' WHEN own_risk >= 45 THEN 'moderate' WHEN own_risk >= 25 THEN 'low' ELSE 'natural' END"
    percent_bad = f"({hits('a', r'(?:^|[^0-9A-Za-z_.])(?:1[0-9]{2,}|[2-9][0-9]{2,})(?:[.][0-9]+)?%')})"
    numbers = f"list_filter(list_transform(regexp_extract_all(a, {lit('(?i)' + lx.COEFFICIENT)}, 1), lambda v: v::DOUBLE), lambda v: abs(v) > 1)"
    p_values = f"list_filter(list_transform(regexp_extract_all(a, {lit('(?i)' + lx.P_VALUE)}, 1), lambda v: v::DOUBLE), lambda v: v < 0 OR v > 1)"
    escape = "html"
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escape = f"replace({escape}, {lit(x)}, {lit(y)})"
    ascii_docs = f"WITH {DOCS}, d AS (SELECT doc_id, text, {asc('text')} AS a FROM docs)"
    groups = ("provenance", "source_family", "discipline", "document_type", "editing_level")
    stats = " UNION ALL ".join(f"SELECT {lit(k)} AS feature, round(avg({k}), 6) AS mean, round(greatest(1e-6, stddev_pop({k})), 6) AS scale FROM lab" for k in demo.FEATURES)
    gnb = " UNION ALL ".join(f"SELECT label, {lit(k)} AS feature, count(*) AS n, round(avg({k}), 6) AS mean, round(greatest(1e-3, var_pop({k})), 6) AS variance FROM lab GROUP BY label" for k in demo.FEATURES)
    shifts = " UNION ALL ".join(f"SELECT {lit(k)} AS feature, round(avg({k}), 4) AS recent_mean, 1.0::DOUBLE AS training_mean, round(abs(avg({k}) - 1e0) / 2e0, 3) AS z_shift FROM lab" for k in demo.FEATURES)
    quick = {
        "sentence_segments": f"{kept} doc_id, index, paragraph_index, sentence_index, start, (start + length(text))::INT AS \"end\", text FROM sents",
        "section_asof": f"{kept} doc_id, index, section FROM sents",
        "protected_segments": f"{kept} doc_id, index, protected FROM sents",
        "paragraph_lines": f"{kept} doc_id, line_no::INT AS line_no, start, line, paragraph_index FROM lines WHERE core <> ''",
        "sentence_stats": f"{kept} doc_id, count(*) AS sentences, sum(n)::BIGINT AS words, round(stddev_pop(n) / nullif(avg(n), 0), 6) AS cv, round(quantile_cont(n, 0.9), 6) AS p90 FROM (SELECT doc_id, {nw('a')}::DOUBLE AS n FROM sents) GROUP BY doc_id",
        "word_counts": f"{ascii_docs} SELECT doc_id, {nw('a')}::INT AS n_words FROM d",
        "lexical_diversity": f"""WITH {DOCS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), {lit(lx.W3)}) AS t FROM docs)
 SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0e0 WHEN len(t) <= 50 THEN list_unique(t) / len(t)
 ELSE list_avg(list_transform(range(1, len(t) - 48, 25), lambda i: list_unique(t[i:i + 49]) / 50e0)) END, 6) AS msttr FROM t""",
        "sentence_risk": f"{scored} doc_id, index, own_risk FROM scored",
        "flagged_sentences": f"{scored} doc_id, index, own_risk, {band} AS band FROM scored WHERE own_risk >= 25",
        "topk_risks": f"{scored} doc_id, index, own_risk, (row_number() OVER (PARTITION BY doc_id ORDER BY own_risk DESC, index))::INT AS place FROM scored WHERE own_risk > 0 QUALIFY place <= 4",
        "repeated_openings": f"{kept} doc_id, opening, count(*) AS n FROM (SELECT doc_id, {opening('a')} AS opening FROM sents WHERE NOT protected) WHERE opening <> '' GROUP BY ALL HAVING count(*) > 2",
        "repeated_connectors": f"{kept} connector, count(*) AS n FROM (SELECT lower(regexp_extract(a, {lit('(?i)' + lx.CONNECTOR)}, 1)) AS connector FROM sents WHERE NOT protected) WHERE connector <> '' GROUP BY ALL",
        "repeated_frames": f"{kept} doc_id, " + ", ".join(f"sum({hits('a', chr(92) + 'b' + f + chr(92) + 'b')})::BIGINT AS {f.replace(' ', '_')}" for f in lx.FRAMES) + " FROM sents WHERE NOT protected GROUP BY doc_id",
        "coverage": f"""WITH {SEGMENTS}, s AS (SELECT doc_id, sum({nw('a')}) AS w, count(*) AS n, count(DISTINCT paragraph_index) AS p FROM sents WHERE NOT protected GROUP BY 1)
 SELECT doc_id, t::BIGINT AS total_words, coalesce(w, 0)::BIGINT AS assessed_words, greatest(0, t - coalesce(w, 0))::BIGINT AS excluded_words, coalesce(n, 0)::BIGINT AS assessed_sentences,
 coalesce(p, 0)::BIGINT AS assessed_paragraphs FROM (SELECT doc_id, {nw(asc('text'))} AS t FROM docs) LEFT JOIN s USING (doc_id)""",
        "burstiness_windows": f"""{kept} doc_id, count(*) AS windows, count_if(spread <= 5) AS tight FROM (SELECT doc_id, count(n) OVER w AS k, max(n) OVER w - min(n) OVER w AS spread
 FROM (SELECT doc_id, index, {nw('a')} AS n FROM sents WHERE NOT protected) WINDOW w AS (PARTITION BY doc_id ORDER BY index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE k = 3 GROUP BY doc_id""",
        "anaphora_runs": f"""{kept} doc_id, min(index)::INT AS at, start, count(*) AS n FROM (SELECT doc_id, index, s AS start, row_number() OVER (PARTITION BY doc_id ORDER BY index)
 - row_number() OVER (PARTITION BY doc_id, s ORDER BY index) AS island FROM (SELECT doc_id, index, {opening('a', 2)} AS s FROM sents WHERE NOT protected)) WHERE start <> '' GROUP BY doc_id, start, island HAVING count(*) >= 2""",
        "ngram_repetition": f"""{ascii_docs}, w AS (SELECT doc_id, {words('a')} AS w FROM d),
 g AS (SELECT doc_id, unnest(list_concat({_grams(2)}, list_concat({_grams(3)}, {_grams(4)}))) AS g FROM w WHERE len(w) >= 20),
 c AS (SELECT doc_id, g, count(*) AS n FROM g WHERE len(list_filter(g, lambda t: NOT list_contains({stop}, t))) > 0 GROUP BY ALL HAVING count(*) >= 3),
 u AS (SELECT doc_id, sum((n - 2) * len(g)) AS u FROM c GROUP BY 1)
 SELECT doc_id, len(w)::INT AS n_words, coalesce(u, 0)::BIGINT AS repeated_units, greatest(0, least(100, round_even(coalesce(u, 0) / greatest(1, len(w))::DOUBLE * 180, 0)))::INT AS ngram_pct FROM w LEFT JOIN u USING (doc_id)""",
        "top_token_share": f"""{ascii_docs}, w AS (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS r
 FROM (SELECT doc_id, unnest({words('a')}) AS word FROM d) GROUP BY doc_id, word)
 SELECT doc_id, sum(n)::BIGINT AS n_words, round(sum(CASE WHEN r <= 12 THEN n ELSE 0 END) / sum(n), 6) AS top_share, round(sum(CASE WHEN word IN {common} THEN n ELSE 0 END) / sum(n), 6) AS common_share FROM w GROUP BY 1""",
        "syntactic_signatures": f"{kept} doc_id, {signature} AS signature, count(*) AS n FROM sents WHERE NOT protected GROUP BY ALL",
        "content_density": f"{kept} doc_id, index, round(len(list_filter({words('a')}, lambda w: length(w) > 2 AND NOT list_contains({stop}, w))) / greatest(1, {nw('a')})::DOUBLE, 6) AS density FROM sents WHERE NOT protected",
        "temporal_score": f"""{ascii_docs}, s AS (SELECT doc_id, {hits('a', lx.VAGUE_TIME_WIDE)} AS v, {years} AS y FROM d)
 SELECT doc_id, least(100, CASE WHEN v > 0 THEN least(55, v * 12) ELSE 0 END + CASE WHEN v > 0 AND len(y) = 0 THEN 35 ELSE 0 END
 + CASE WHEN len(list_filter(y, lambda x: x > 2027)) > 0 THEN 45 ELSE 0 END + CASE WHEN len(y) > 0 AND list_max(y) < 2020 AND v > 0 THEN 25 ELSE 0 END)::INT AS temporal_pct FROM s""",
        "implausibility": f"""{ascii_docs} SELECT doc_id, least(100, least(50, {percent_bad} * 25) + least(45, len({p_values}) * 20) + least(45, len({numbers}) * 20)
 + CASE WHEN {hits('a', lx.CERTAINTY)} >= 4 THEN least(30, ({hits('a', lx.CERTAINTY)} - 3) * 6) ELSE 0 END)::INT AS implausible_pct FROM d""",
        "text_digest": f"WITH {DOCS} SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {STRIP})) AS digest FROM docs",
        "html_escape": f"SELECT page_id, sha256({escape}) AS escaped_sha FROM pages",
        "interval_flagged_lines": f"""WITH {SCORED}, f AS (SELECT doc_id, start AS a, start + length(text) AS b FROM scored WHERE own_risk >= 25)
 SELECT doc_id, line_no::INT AS line_no FROM lines l WHERE core <> '' AND EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.a < l.start + length(l.line) AND f.b > l.start)""",
        "before_after_map": f"""WITH b0 AS (SELECT doc_id, {asc('text')} AS a FROM documents), a0 AS (SELECT doc_id, {asc(demo.TEXT)} AS a FROM documents),
 b AS (SELECT * FROM ({counts.replace('FROM src', 'FROM b0')}) WHERE n > 0), a AS (SELECT * FROM ({counts.replace('FROM src', 'FROM a0')}) WHERE n > 0)
 SELECT doc_id, key, coalesce(b.n, 0)::INT AS before, coalesce(a.n, 0)::INT AS after, (coalesce(a.n, 0) - coalesce(b.n, 0))::INT AS change FROM b FULL JOIN a USING (doc_id, key)""",
        "illegal_ids_anti": f"""WITH {SEGMENTS}, l AS (SELECT doc_id, paragraph_index, line, core, {asc('core')} AS a, core AS text FROM lines WHERE core <> '')
 SELECT doc_id AS path, paragraph_index AS index FROM l WHERE ({re.search(r"contains\(text, chr\(9\)\).*(?= AS protected)", SEGMENTS, re.S)[0]})""",
        "feature_means_scales": f"WITH {LABELLED} {stats}",
        "gnb_params": f"WITH {LABELLED} {gnb}",
        "drift_shifts": f"WITH {LABELLED} {shifts}",
        "logistic_predict": f"WITH {JUDGED} SELECT id, probability, round_even(probability * 100, 0)::INT AS percentage, (probability >= 0.5)::INT AS predicted FROM judged",
        "confusion_metrics": f"WITH {JUDGED} SELECT * EXCLUDE (k) FROM ({_metrics('1')})",
        "roc_auc_rank": f"WITH {JUDGED.replace('SELECT doc_id AS id', 'SELECT 1 AS one, doc_id AS id')} SELECT roc_auc FROM ({_auc('x.one')})",
        "group_metrics": f"WITH {JUDGED} SELECT k AS source, * EXCLUDE (k) FROM ({_metrics('source')}) JOIN ({_auc('x.source')}) USING (k) WHERE tp + tn + fp + fn >= 4 AND tp + fn > 0 AND tn + fp > 0",
        "evaluation": f"WITH {JUDGED} " + " UNION ALL ".join(
            f"SELECT '{g}' AS grouping, k AS value, * EXCLUDE (k) FROM ({_metrics(g)}) JOIN ({_auc('x.' + g)}) USING (k) WHERE tp + tn + fp + fn >= 4 AND tp + fn > 0 AND tn + fp > 0"
            for g in ("lang", "source")
        )
        + f" UNION ALL SELECT 'all', 'all', m.* EXCLUDE (k), a.roc_auc FROM ({_metrics('1')}) m, ({_auc('1')}) a",
        "corpus_status": f"WITH {_corpus()} " + " UNION ALL ".join([f"SELECT {lit(g)} AS grouping, {g} AS value, count(*) AS n, count_if(label = 0) AS label_0, count_if(label = 1) AS label_1 FROM corpus GROUP BY {g}" for g in groups] + ["SELECT 'all', 'all', count(*), count_if(label = 0), count_if(label = 1) FROM corpus"]),
        "external_disagreement": f"WITH {_corpus()} SELECT count(*) AS n_multiple, round(avg(abs(a - b)), 2) AS mean_range, round(median(abs(a - b)), 2) AS median_range FROM corpus WHERE doc_id % 4 > 0",
        "detector_counts": f"WITH {_corpus()} SELECT 'a' AS detector, count(*) AS n FROM corpus UNION ALL SELECT 'b', count(*) FROM corpus WHERE doc_id % 4 > 0",
    }
    generic = " + ".join(f"CASE WHEN {hits('a', p)} > 0 THEN least({max(4, w // 3)} + ({hits('a', p)} - 1) * 2, 12) ELSE 0 END" for p, _, w in lx.GENERIC)
    marks = {c: f"(length(a) - length(replace(a, '{c}', '')))" for c in ";,"}
    frames = " + ".join(f"CASE WHEN all{i} > greatest(2, doc_words // 500) AND f{i} > 0 THEN least(12, 3 + all{i}) ELSE 0 END" for i in range(len(lx.FRAMES)))
    mine = "CASE WHEN NOT protected THEN"
    quick["contextual_risk"] = f"""WITH {SCORED}, b AS (SELECT *, {mine} nullif({opening('a')}, '') END AS o, {mine} nullif(lower(regexp_extract(a, {lit('(?i)' + lx.CONNECTOR)}, 1)), '') END AS k,
 {nw('a')} AS n, {', '.join(f"{mine} {hits('a', chr(92) + 'b' + f + chr(92) + 'b')} ELSE 0 END AS f{i}" for i, f in enumerate(lx.FRAMES))} FROM scored),
 c AS (SELECT *, count(o) OVER (PARTITION BY doc_id, o) AS same_o, count(CASE WHEN NOT protected AND sentence_index = 0 THEN 1 END) OVER (PARTITION BY doc_id, o) AS same_p,
 count(k) OVER (PARTITION BY doc_id, k) AS same_k, sum({mine} n END) OVER d AS doc_words, {', '.join(f'sum(f{i}) OVER d AS all{i}' for i in range(len(lx.FRAMES)))} FROM b WINDOW d AS (PARTITION BY doc_id)),
 r AS (SELECT doc_id, index, protected, {mine} least(100, own_risk + {generic} + CASE WHEN o IS NOT NULL AND same_o > 2 THEN least(18, 6 * (same_o - 2)) ELSE 0 END
 + CASE WHEN sentence_index = 0 AND o IS NOT NULL AND same_p > 1 THEN least(18, 8 * (same_p - 1)) ELSE 0 END + CASE WHEN k IS NOT NULL AND same_k > 2 THEN 12 ELSE 0 END
 + CASE WHEN n > 65 THEN 8 WHEN n BETWEEN 1 AND 4 THEN 4 ELSE 0 END + CASE WHEN {marks[';']} >= 2 THEN 12 ELSE 0 END + CASE WHEN {marks[',']} >= 7 THEN 10 ELSE 0 END
 + CASE WHEN {hits('a', r'\b(?:this|these|it)\b')} >= 5 THEN 10 ELSE 0 END + CASE WHEN {hits('a', lx.CERTAINTY)} >= 2 THEN 10 ELSE 0 END
 + CASE WHEN {has('a', lx.UNSUPPORTED)} AND NOT {has('a', lx.CITATION)} THEN 14 ELSE 0 END + CASE WHEN {has('a', lx.VAGUE_TIME_WIDE)} AND NOT {has('a', lx.YEAR)} THEN 10 ELSE 0 END
 + CASE WHEN {percent_bad} > 0 THEN 18 ELSE 0 END + {frames} + CASE WHEN {hits('a', lx.CITATION)} >= 3 THEN 8 ELSE 0 END) ELSE 0 END AS risk, section FROM c)
 SELECT doc_id, index, risk::INT AS risk, CASE WHEN protected THEN 'protected' WHEN risk >= 70 THEN 'high' WHEN risk >= 45 THEN 'moderate' WHEN risk >= 25 THEN 'low' ELSE 'natural' END AS band FROM r"""
    quick["section_profile"] = quick["contextual_risk"].rsplit(" SELECT doc_id, index, risk::INT", 1)[0] + """ SELECT doc_id, section, count(*) AS segment_count, round(avg(risk), 2) AS mean_signal,
 count_if(risk >= 45) AS elevated_count, count_if(risk >= 25) AS flagged_count FROM r WHERE NOT protected GROUP BY ALL"""
    pieces = _evidence("text")
    quick["preservation_signature"] = f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"array_to_string({v}, '|') AS {k}" if k in lx.EVIDENCE else f"{v} AS {k}" for k, v in pieces.items()) + " FROM docs"
    signed = ", ".join(f"{v} AS {k}, {w} AS other_{k}" for (k, v), w in zip(pieces.items(), _evidence("other").values(), strict=True))
    both = f"WITH {DOCS}, pair AS (SELECT doc_id, text, replace(text, '2021', '2022') AS other FROM docs), signed AS (SELECT doc_id, text, other, {signed} FROM pair)"
    differ = {k: f"{k} IS DISTINCT FROM other_{k}" for k in pieces}
    claims = "(" + " OR ".join(differ[k] for k in lx.QUALIFIERS) + ")"
    issues = ", ".join([*(f"CASE WHEN {differ[k]} THEN '{k} changed' END" for k in lx.EVIDENCE), f"CASE WHEN {claims} THEN 'claim_qualifiers changed' END"])
    quick["preservation_gate"] = f"{both} SELECT doc_id, len(i) = 0 AS valid, array_to_string(i, '|') AS issues FROM (SELECT doc_id, list_filter([{issues}], lambda x: x IS NOT NULL) AS i FROM signed)"

    def same(*keys: str) -> str:
        return "NOT (" + " OR ".join(differ[k] for k in keys) + ")"

    def tail(x: str) -> str:
        lines = f"string_split({x}, chr(10))"
        at = f"list_position(list_transform({lines}, lambda l: {has('regexp_replace(l, ' + STRIP + ')', lx.REFERENCE_HEADING)}), true)"
        return f"CASE WHEN {at} > 0 THEN regexp_replace(array_to_string({lines}[{at}:], chr(10)), {STRIP}) ELSE '' END"

    checks = {
        "numbers": same("numbers"), "citations": same("citation_blocks"), "urls": same("urls"), "emails": same("emails"), "headings": same("headings"),
        "tables": same("table_lines", "tabular_lines"), "equations": same("display_equations", "equationish"), "references": f"{tail('text')} = {tail('other')}",
        "placeholders": same("placeholders"), "acronyms": same("acronyms"), "claim_qualifiers": f"NOT {claims}", "user_terms": "true",
    }
    named = ", ".join(f'{v} AS "{k}"' for k, v in checks.items())
    quick["certificate"] = f"{both}, c AS (SELECT doc_id, {named} FROM signed) SELECT *, {' AND '.join(f'"{k}"' for k in checks)} AS passed, 0.0::DOUBLE AS changed_word_ratio FROM c"
    quick["paragraph_units"] = f"WITH {UNITS} SELECT doc_id, segment, text FROM units"
    level = "CASE WHEN ai_signal < 20 THEN 'Minimal' WHEN ai_signal < 40 THEN 'Low' WHEN ai_signal < 60 THEN 'Moderate' WHEN ai_signal < 80 THEN 'Elevated' ELSE 'Strong' END || ' AI-style signal'"
    quick["segment_scores"] = f"WITH {_unit_scores()} SELECT *, {level} AS label FROM unit_scores"
    quick["segment_percentiles"] = f"""WITH {_unit_scores()}, q AS (SELECT doc_id, count(*) AS segment_count, round_even(avg(ai_signal), 0)::INT AS segment_mean, round_even(quantile_cont(ai_signal, 0.75), 0)::INT AS segment_p75,
 round_even(quantile_cont(ai_signal, 0.9), 0)::INT AS segment_p90, count_if(ai_signal >= 20) AS flagged_segments FROM unit_scores GROUP BY doc_id)
 SELECT *, greatest(0, least(100, round_even(segment_mean * 0.30e0 + segment_p75 * 0.30e0 + segment_p90 * 0.40e0, 0)))::INT AS segment_pct FROM q"""
    quick["reference_features"] = _reference_features()
    top = sorted(demo.FEATURES, key=lambda k: -abs(demo.WEIGHTS[k]))
    total = sum(abs(x) for x in demo.WEIGHTS.values())
    quick["feature_importance"] = " UNION ALL ".join(f"SELECT {lit(k)} AS feature, round({abs(demo.WEIGHTS[k])}e0, 6) AS importance, round({abs(demo.WEIGHTS[k])}e0 / {total}e0, 4) AS share" for k in top)
    newest = "newest AS (SELECT * FROM lab ORDER BY id DESC LIMIT 1000)"
    shifted = " UNION ALL ".join(f"SELECT {lit(k)} AS feature, round(abs(avg({k}) - 1e0) / 2e0, 3) AS z FROM newest" for k in demo.FEATURES)
    quick["drift_status"] = f"""WITH {LABELLED}, {newest}, s AS ({shifted}), d AS (SELECT round(avg(z), 3) AS drift_index, string_agg(feature, ',' ORDER BY z DESC, feature DESC) AS largest FROM s)
 SELECT drift_index, CASE WHEN drift_index >= 1.25 THEN 'retraining recommended' WHEN drift_index >= 0.75 THEN 'watch' ELSE 'stable' END AS status, largest FROM d"""
    names = list(demo.FEATURES)
    scaled = ", ".join(f"({k} - avg({k}) OVER ()) / greatest(1e-6, stddev_pop({k}) OVER ()) AS {k}" for k in names)
    near = {y: " + ".join(f"pow(z.{k} - (SELECT avg({k}) FROM z WHERE label = {y}), 2)" for k in names) for y in (0, 1)}
    each = " UNION ALL ".join(f"SELECT label, {lit(k)} AS feature, round(avg({k}), 6) AS centroid FROM z GROUP BY label" for k in names)
    quick["centroids"] = f"""WITH {LABELLED}, z AS (SELECT label, {scaled} FROM lab), t AS (SELECT round(greatest(0.2e0, avg(abs(({near[0]}) - ({near[1]})))), 6) AS temperature FROM z)
 SELECT c.*, t.temperature FROM ({each}) c, t"""
    return {k: re.sub(r"(count_if\([^()]*\))", r"\1::BIGINT", v) for k, v in quick.items()}
