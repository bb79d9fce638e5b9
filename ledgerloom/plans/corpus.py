"""Registered queries on corpus cleaning and chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.metrics import TERMS
from ..functions.phrases import with_phrases
from ..operators import cleaning as C
from ..operators import formatting as M
from .inputs import DOCS_AS_QA_SQL, docs_as_qa, table
from .sql_text import WS, argmax, contained, occurrences, quoted, strip

PROMPT = "You are a helpful guide."


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_reason(docs_as_qa(spark, sf_dir))


def clean_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reason_counts(_flagged(spark, sf_dir))


def clean_reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reason_pivot(_flagged(spark, sf_dir))


def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_summary(_flagged(spark, sf_dir))


def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir).where("reason is null")
    return rows.select(C.record_id(F.col("source"), F.col("ord")).alias("id"), F.length("question").alias("n_question"), F.length("answer").alias("n_answer"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_pii_count(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "n")
    return rows.where("n > 0").select("doc_id", F.col("n").cast("long").alias("n_pii"))


def pii_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_pii(F.col("text")).alias("text"))


def alpha_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.alpha_ratio(F.col("text")), 6).alias("alpha_ratio"))


def financial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.lexicon_hits(F.col("text"), K.FINANCIAL_LEXICON).alias("hits"))


def html_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.squeeze(T.strip_urls(T.strip_html(F.col("html"))))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


def light_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.collapse_light(T.strip_control(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


# Fixed list of what is put behind texts: (text, normalised, characters that change, U+FFFD in it).
ODD_ENDS = (("", "", 0, 0), (" I’m fine — really…not.", " I'm fine - really...not.", 1, 0), (" ﬁnance Ⅷ ½", " finance VIII 1⁄2", 3, 0), (" don�t stop�", " don't stop", 0, 2), (" “ok”–x", ' "ok"-x', 0, 0))


def unicode_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd characters behind them, by doc_id."""
    end = F.get(F.array(*[F.lit(e[0]) for e in ODD_ENDS]), F.pmod("doc_id", F.lit(len(ODD_ENDS))).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), end).alias("t")).withColumn("f", T.fix_replacement(F.col("t")))
    return rows.select("doc_id", F.md5(T.normalize_unicode(F.col("f"))).alias("clean_md5"), T.encoding_changes(F.col("t")).alias("changed"), T.count_replacement(F.col("t")).alias("replaced"))


# Fixed list of questions, put before those of documents.
PROFILE_TEXTS = (
    "What is my net worth?", "Predict my annual salary from my age and education", "Estimate your monthly expenses for the next year",
    "How much am I worth?", "Calculate my risk score", "Should I pay off debt or invest my savings?",
    "I make 150k a year and saved 100k, should I buy a house?", "What is the FY2018 capital expenditure for 3M?",
    "I calculated that my necessary expenses run about 800/mo, is that normal?", "")


def profiling_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.get(F.array(*[F.lit(t) for t in PROFILE_TEXTS]), F.pmod("ord", F.lit(len(PROFILE_TEXTS))).cast("int"))
    return docs_as_qa(spark, sf_dir).select("ord", C.is_profiling(F.concat(start, F.lit(" "), F.coalesce("question", F.lit("")))).alias("profiling"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_exact(docs_as_qa(spark, sf_dir)).select("ord", "kind")


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_counts(C.dedup_exact(docs_as_qa(spark, sf_dir)))


def dedup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_fuzzy(docs_as_qa(spark, sf_dir)).select("ord", "kind")


def near_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct questions within 8 % of edits; a question stands for its copies."""
    first = docs_as_qa(spark, sf_dir).withColumn("k", C.question_key(F.col("question"))).groupBy("k").agg(F.min("ord").alias("ord")).select("ord", F.col("k").alias("question"))
    return C.near_pairs(first)


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_as_qa(spark, sf_dir).withColumn("id", C.record_id(F.col("source"), F.col("ord")))
    return M.chat_records(rows, system_prompt=PROMPT)


def chat_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("id", "source", F.md5(M.render(F.col("messages"))).alias("rendered"), F.size("messages").alias("n"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split(_chat(spark, sf_dir)).select("id", "split")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_table(M.split(_chat(spark, sf_dir)))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.turns_to_messages(table(spark, sf_dir, "conversations"))


def validate_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("id", F.array_join(M.violations(F.col("messages")), "; ").alias("errors"))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _conversations(spark, sf_dir).withColumn("errors", M.violations(F.col("messages")))
    return M.validation_summary(checked)


def training_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    rows = _conversations(spark, sf_dir)
    return rows.select(
        "id", F.size(M.as_messages(m, PROMPT)).alias("n_all"), M.trainable(m).alias("trainable"), F.size(M.dialogue(m)).alias("n_dialogue"),
        F.md5(M.render(M.last_messages(M.dialogue(m), 6))).alias("window"))


def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label masks and padding over stand-in ids: the code points of a pair of turns."""
    points = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    turns = table(spark, sf_dir, "conversations").where("role != 'system'")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("answer", F.lead("text").over(nxt)).where("answer is not null")
    x = M.sft_labels(points(F.col("text")), points(F.col("answer")), 100)
    return rows.select("conv_id", "turn", x.alias("x")).select(
        "conv_id", "turn", F.size("x.input_ids").alias("n"), F.aggregate("x.attention_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n_real"),
        F.size(F.filter("x.labels", lambda v: v == -100)).alias("n_masked"))


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("text") == "").alias("n_empty"),
        (F.count("*") - F.countDistinct("text")).alias("n_copies"), F.round(F.avg(F.length("text")), 3).alias("mean_chars"),
        F.median(F.length("text")).alias("median_chars"), F.max(F.length("text")).alias("max_chars"))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "source", "lang").limit(10)


def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, terms and topic of whole texts, each read through once."""
    rows = with_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "category", F.array_join("terms", ", ").alias("terms"), "topic")


QUERIES = {f.__name__: f for f in (
    clean_reasons, clean_reason_pivot, clean_summary, cleaned_records, pii_counts, pii_redacted, alpha_ratios, financial_hits, html_stripped, light_whitespace,
    unicode_normalized, profiling_flags, dedup_exact, dedup_counts, dedup_fuzzy, near_question_pairs, chat_v1, split_rows, split_counts, validate_chat,
    validation_summary, training_messages, sft_examples, profile_documents, value_counts, document_phrases)}

# @ stands for the column. In SQL an ASCII letter stands for every other character, so that word ends agree.
_PLAIN = "regexp_replace(@, '[^\\x00-\\x7F]', 'q', 'g')"


def _pii_sql(c: str) -> str:
    count, text = "0", c
    for kind, pattern in K.PII:
        p = pattern.replace("'", "''")
        count += f" + len(regexp_extract_all({text}, '{p}'))"
        text = f"regexp_replace({text}, '{p}', '[{kind}]', 'g')"
    return count


def _changing() -> str:
    """A class of the characters that NFKC changes, as ranges."""
    from itertools import groupby
    from unicodedata import normalize

    odd = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and normalize("NFKC", chr(c)) != chr(c)]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(odd), lambda x: x[1] - x[0])]
    return "[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs) + "]"


def _redact_sql(c: str) -> str:
    for kind, pattern in K.PII:
        c = f"regexp_replace({c}, '{pattern}', '[{kind}]', 'g')"
    return c


def _normal_sql(c: str, plain: bool = False) -> str:
    one = {k: v for k, v in T.PUNCTUATION.items() if len(v) == 1}
    q = lambda s: s.replace("'", "''")
    c = f"replace(translate(nfc_normalize({c}), '{q(''.join(one))}', '{q(''.join(one.values()))}'), '…', '...')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '<[^>]{{1,256}}>', ' ', 'g'), '(?i)https?://\\S+', ' ', 'g')"
    c = _PLAIN.replace("@", c) if plain else c
    return f"trim(regexp_replace({_redact_sql(c)}, '{WS}+', ' ', 'g'))"


_ENDS = ", ".join("({}, '{}', {}, {})".format(k, e[1].replace("'", "''"), e[2], e[3]) for k, e in enumerate(ODD_ENDS))
_TRANSLATED = ["".join(x).replace("'", "''") for x in zip(*((k, v) for k, v in T.PUNCTUATION.items() if len(v) == 1))]
_LEX = quoted(K.FINANCIAL_LEXICON)
_HITS = "len(list_intersect(list_distinct(regexp_split_to_array(lower(@), '[^a-z0-9$.-]+')), " + _LEX + "))"
_ALPHA = f"CASE WHEN length(regexp_replace(@, '{WS}+', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(@, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace(@, '{WS}+', '', 'g')) END"
_WORDS = f"len(list_filter(regexp_split_to_array(@, '{WS}+'), lambda w: w != ''))"
_PROFILE_SQL = " OR ".join("regexp_matches(q, '" + p.replace("(?U)", "").replace("'", "''") + "')" for p in K.PROFILING)
_FLAGGED = f"""WITH {DOCS_AS_QA_SQL.strip()},
norm AS (SELECT ord, source, {_normal_sql('question')} AS q, {_normal_sql('answer')} AS a,
  length({_normal_sql('question', True)}) AS nq, length({_normal_sql('answer', True)}) AS na,
  {_pii_sql(_PLAIN.replace('@', 'question'))} + {_pii_sql(_PLAIN.replace('@', 'answer'))} AS pii,
  len(regexp_extract_all(concat(question, answer), '{_changing()}')) AS encoding FROM qa),
flagged AS (SELECT *, CASE WHEN length(q) < 15 THEN 'question_too_short' WHEN length(q) > 5000 THEN 'question_too_long'
  WHEN length(a) < 1 OR {_WORDS.replace('@', 'a')} < 3 THEN 'answer_too_short' WHEN length(a) > 12000 THEN 'answer_too_long'
  WHEN {_ALPHA.replace('@', 'q')} < 0.55 THEN 'low_alpha_ratio' WHEN {_HITS.replace('@', 'q')} + {_HITS.replace('@', 'a')} < 1 THEN 'non_financial'
  WHEN {_PROFILE_SQL} THEN 'profiling' END AS reason FROM norm)"""
# One byte for each accented letter of the lower-cased texts: the distance counts bytes there.
_BYTE = "translate(@, 'éèêçàüöäßíóñáú', 'ABCDEFGHIJKLMN')"
_KEY = f"trim(regexp_replace(lower(@), '{WS}+', ' ', 'g'))"
_KINDS = f"""WITH {DOCS_AS_QA_SQL.strip()}, keyed AS (SELECT *, {_KEY.replace('@', 'question')} AS k, {_KEY.replace('@', 'answer')} AS ka FROM qa),
kinds AS (SELECT ord, source, CASE WHEN k = '' THEN NULL WHEN row_number() OVER w = 1 THEN 'kept' WHEN ka = first_value(ka) OVER w THEN 'exact' ELSE 'same_question' END AS kind
  FROM keyed WINDOW w AS (PARTITION BY source, k ORDER BY ord))"""
_CHAT = f"""WITH {DOCS_AS_QA_SQL.strip()}, chat AS (SELECT format('{{}}-{{:04d}}', source, ord) AS id, source, {strip('question')} AS q, {strip('answer')} AS a FROM qa
  WHERE {strip('question')} != '' AND {strip('answer')} != '')"""
_SPLIT = f"""{_CHAT}, ranked AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|', id)), id) AS r, count(*) OVER (PARTITION BY source) AS n FROM chat),
cut AS (SELECT *, round_even(n * 0.8::DOUBLE, 0) AS t, round_even((n - round_even(n * 0.8::DOUBLE, 0)) * 0.1::DOUBLE / (1 - 0.8::DOUBLE), 0) AS v FROM ranked),
split AS (SELECT id, source, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM cut)"""
_TURNS = f"""WITH bad AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, text FROM conversations),
each AS (SELECT conv_id, k, concat_ws('; ', CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN concat('messages[', k, '] has invalid role ', role) END,
  CASE WHEN {strip("coalesce(text, '')")} = '' THEN concat('messages[', k, '] has empty content') END) AS e, role FROM bad),
errors AS (SELECT conv_id AS id, concat_ws('; ', string_agg(CASE WHEN e != '' THEN e END, '; ' ORDER BY k), CASE WHEN arg_max(role, k) != 'assistant' THEN 'last message role must be ''assistant''' END,
  CASE WHEN count_if(role = 'user') = 0 THEN 'messages must contain a ''user'' turn' END) AS errors FROM each GROUP BY conv_id)"""
_QS, _TS = [f"q{k}" for k in range(len(K.QUESTION_CATEGORIES))], [f"s{k}" for k in range(len(K.ADVICE_CATEGORIES))]
ORACLES = {
    "clean_reasons": f"{_FLAGGED} SELECT source, reason, count(*) AS n FROM flagged WHERE reason IS NOT NULL GROUP BY ALL",
    "clean_reason_pivot": f"{_FLAGGED} SELECT source, " + ", ".join(f"count_if(reason = '{r}') AS {r}" for r in C.REASONS) + " FROM flagged WHERE reason IS NOT NULL GROUP BY source",
    "clean_summary": f"{_FLAGGED} SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n_before, count_if(reason IS NULL) AS n_kept, sum(pii)::BIGINT AS n_pii, sum(encoding)::BIGINT AS n_encoding FROM flagged GROUP BY ROLLUP (source)",
    "cleaned_records": f"{_FLAGGED} SELECT format('{{}}-{{:04d}}', source, ord) AS id, nq::INTEGER AS n_question, na::INTEGER AS n_answer FROM flagged WHERE reason IS NULL",
    "pii_counts": f"SELECT * FROM (SELECT doc_id, ({_pii_sql(_PLAIN.replace('@', 'text'))})::BIGINT AS n_pii FROM documents) WHERE n_pii > 0",
    "alpha_ratios": f"SELECT doc_id, round({_ALPHA.replace('@', 'text')}, 6) AS alpha_ratio FROM documents",
    "financial_hits": f"SELECT doc_id, {_HITS.replace('@', 'text')}::INTEGER AS hits FROM documents",
    "html_stripped": f"SELECT page_id, md5(t) AS text_md5, length(t)::INTEGER AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]{{1,256}}>', ' ', 'g'), '(?i)https?://\\S+', ' ', 'g'), '{WS}+', ' ', 'g')) AS t FROM pages)",
    "light_whitespace": f"SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {strip('x')} AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM documents))",
    "unicode_normalized": f"""WITH ends AS (SELECT * FROM (VALUES {_ENDS}) v(k, clean, changed, replaced)), one AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, md5(concat(replace(translate(nfc_normalize(text), '{_TRANSLATED[0]}', '{_TRANSLATED[1]}'), '…', '...'), clean)) AS clean_md5, changed::INTEGER AS changed, replaced::INTEGER AS replaced
        FROM one JOIN ends ON k = doc_id % {len(ODD_ENDS)}""",
    "profiling_flags": f"""WITH {DOCS_AS_QA_SQL.strip()}, asked AS (SELECT ord, concat({quoted(PROFILE_TEXTS)}[ord % {len(PROFILE_TEXTS)} + 1], ' ', coalesce(question, '')) AS q FROM qa) SELECT ord, {_PROFILE_SQL} AS profiling FROM asked""",
    "dedup_exact": f"{_KINDS} SELECT ord, kind FROM kinds",
    "dedup_counts": f"{_KINDS} SELECT source, kind, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY ALL",
    "near_question_pairs": f"""WITH {DOCS_AS_QA_SQL.strip()}, f AS (SELECT {_KEY.replace('@', 'question')} AS k, min(ord) AS ord FROM qa GROUP BY 1 HAVING k != ''),
        p AS (SELECT x.ord AS a, y.ord AS b, x.k AS q, y.k AS r, floor(greatest(length(x.k), length(y.k)) * 0.08::DOUBLE) AS m FROM f x JOIN f y ON x.ord < y.ord)
        SELECT a, b, distance FROM (SELECT a, b, levenshtein({_BYTE.replace('@', 'q')}, {_BYTE.replace('@', 'r')})::INTEGER AS distance, m AS most FROM p WHERE abs(length(q) - length(r)) <= m) WHERE distance <= most""",
    "chat_v1": f"{_CHAT} SELECT id, source, md5(concat('system: {PROMPT}', chr(10), 'user: ', q, chr(10), 'assistant: ', a)) AS rendered, 3 AS n FROM chat",
    "split_rows": f"{_SPLIT} SELECT id, split FROM split",
    "split_counts": f"{_SPLIT} SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test FROM split GROUP BY ROLLUP (source)",
    "validate_chat": f"{_TURNS} SELECT id, errors FROM errors",
    "validation_summary": f"{_TURNS} SELECT count_if(errors = '') AS n_valid, count_if(errors != '') AS n_invalid, (SELECT string_agg(concat(id, ': ', errors), chr(10) ORDER BY id) FROM (SELECT * FROM errors WHERE errors != '' ORDER BY id LIMIT 5)) AS sample FROM errors",
    "training_messages": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id AS id, (count(*) + CASE WHEN arg_min(role, turn) = 'system' THEN 0 ELSE 1 END)::INTEGER AS n_all, count(*) >= 2 AND arg_max(role, turn) = 'assistant' AS trainable,
        count_if(role != 'system')::INTEGER AS n_dialogue, md5(coalesce(string_agg(CASE WHEN role != 'system' AND back <= 6 THEN concat(role, ': ', text) END, chr(10) ORDER BY turn), '')) AS "window" FROM t GROUP BY conv_id""",
    "sft_examples": """WITH p AS (SELECT conv_id, turn, length(text) AS a, length(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations WHERE role != 'system')
        SELECT conv_id, turn, (ceil(least(a + b, 100) / 8.0) * 8)::INTEGER AS n, least(a + b, 100)::BIGINT AS n_real, (least(a, 100) + ceil(least(a + b, 100) / 8.0) * 8 - least(a + b, 100))::INTEGER AS n_masked FROM p WHERE b IS NOT NULL""",
    "profile_documents": "SELECT count(*) AS n, count_if(text IS NULL) AS n_null, count_if(text = '') AS n_empty, count(*) - count(DISTINCT text) AS n_copies, round(avg(length(text)), 3) AS mean_chars, median(length(text))::DOUBLE AS median_chars, max(length(text))::INTEGER AS max_chars FROM documents",
    "document_phrases": f"""WITH low AS (SELECT *, lower(text) AS low FROM documents WHERE text IS NOT NULL),
        s AS (SELECT *, {', '.join(f"{contained('low', w)} AS q{k}" for k, w in enumerate(K.QUESTION_CATEGORIES.values()))},
          {', '.join('(' + ' + '.join(occurrences('low', w) for w in words) + f') AS s{k}' for k, words in enumerate(K.ADVICE_CATEGORIES.values()))}, regexp_matches(text, '(?i){K.DEFINITION}') AS asks FROM low),
        t AS (SELECT *, greatest({', '.join(_QS)}) AS most, greatest({', '.join(_TS)}) AS top FROM s)
        SELECT doc_id, CASE WHEN most = 0 THEN 'general' ELSE {argmax(list(zip(K.QUESTION_CATEGORIES, _QS)))} END AS category, array_to_string(list_filter({quoted(TERMS)}, lambda w: contains(low, w)), ', ') AS terms,
          CASE WHEN top = 0 THEN CASE WHEN asks THEN 'Concepts' ELSE 'General' END WHEN asks AND top <= 2 THEN 'Concepts' ELSE {argmax(list(zip(K.ADVICE_CATEGORIES, _TS)))} END AS topic FROM t
        UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL""",
    "value_counts": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 10",
}
