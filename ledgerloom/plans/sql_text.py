"""DuckDB forms of the text functions, for the registered SQL."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.constants import QUESTION_CATEGORIES
from ..functions.metrics import TERMS

# White space of any script, for an engine whose \s is ASCII.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]"


def quoted(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def contained(c: str, phrases: Sequence[str]) -> str:
    return f"len(list_filter({quoted(phrases)}, lambda p: contains({c}, p)))"


def occurrences(c: str, phrase: str) -> str:
    q = phrase.replace("'", "''")
    return f"((length({c}) - length(replace({c}, '{q}', ''))) // {len(phrase)})"


def argmax(scores: Sequence[tuple[str, str]]) -> str:
    """CASE that names the largest of the score columns, the first of equals."""
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {top} THEN '{name}'" for name, s in scores) + " END"


METRICS_SQL = rf"""
tokens AS (SELECT *, {words('question')} AS q, {words('response')} AS r,
  list_filter({quoted(TERMS)}, lambda t: contains(lower(question), t)) AS terms FROM pairs),
parts AS (SELECT *, len(r) AS n, len(list_distinct(q)) AS dq, len(list_distinct(r)) AS dr,
  CAST(len(list_intersect(list_distinct(q), list_distinct(r))) AS DOUBLE) AS common,
  list_transform(generate_series(1, greatest(len(r) - 1, 0)), lambda k: concat(r[k], ' ', r[k + 1])) AS pairs2,
  len(regexp_extract_all({strip('response')}, '[.!?](?:{WS}|$)')) AS ends,
  len(list_filter(terms, lambda t: contains(lower(response), t))) AS hit FROM tokens),
scores AS (SELECT *,
  CASE WHEN dq = 0 OR dr = 0 OR common = 0 THEN 0.0::DOUBLE ELSE 2 * (common / dr) * (common / dq) / (common / dr + common / dq) END AS rouge,
  CASE WHEN n < 15 THEN n / 15.0::DOUBLE WHEN n <= 250 THEN 1.0 ELSE greatest(0.0, 1 - (n - 250) / 250.0::DOUBLE) END AS len_,
  CASE WHEN n < 4 THEN 0.8::DOUBLE ELSE greatest(0.0, 1 - (len(pairs2) - len(list_distinct(pairs2)))::DOUBLE / len(pairs2) * 4.0) END AS rep,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0, ends::DOUBLE / greatest(1, ceil(n / 15.0::DOUBLE))) END AS pun FROM parts),
blends AS (SELECT *, 0.55::DOUBLE * rep + 0.45::DOUBLE * pun AS coh,
  CASE WHEN len(terms) = 0 THEN rouge ELSE hit::DOUBLE / len(terms) END AS cov FROM scores),
relevances AS (SELECT *, CASE WHEN len(terms) > 0 THEN 0.6::DOUBLE * cov + 0.4::DOUBLE * rouge ELSE cov END AS rel FROM blends),
metrics AS (SELECT conv_id, turn, question, response, n::DOUBLE AS word_count, length({strip('response')})::DOUBLE AS char_count,
  round(len_, 3) AS length_adequacy, round(rep, 3) AS repetition_score, round(pun, 3) AS punctuation_score, round(coh, 3) AS coherence,
  round(cov, 3) AS keyword_coverage, round(rel, 3) AS relevance,
  greatest(1.0, least(5.0, round((0.5::DOUBLE * rel + 0.3::DOUBLE * coh + 0.2::DOUBLE * len_) * 5, 2))) AS rubric FROM relevances),
counted AS (SELECT *, {', '.join(f"{contained('lower(question)', w)} AS s{k}" for k, w in enumerate(QUESTION_CATEGORIES.values()))} FROM metrics),
scored AS (SELECT * EXCLUDE ({', '.join(f's{k}' for k in range(len(QUESTION_CATEGORIES)))}),
  CASE WHEN greatest({', '.join(f's{k}' for k in range(len(QUESTION_CATEGORIES)))}) = 0 THEN 'general'
  ELSE {argmax([(name, f's{k}') for k, name in enumerate(QUESTION_CATEGORIES)])} END AS category FROM counted)"""
