"""Cleaning, deduplication and chat records on small literal inputs."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import formatting as M
from ledgerloom.plans.inputs import docs_as_qa
from ledgerloom.sources import jsonl

from .conftest import SMALL


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first()["x"]


def test_pii(spark):
    t = "mail bob@example.com call 555-123-4567 SSN 123-45-6789"
    assert one(spark, T.redact_pii(F.col("t")), t=t) == "mail [EMAIL] call [PHONE] SSN [SSN]"
    assert one(spark, T.count_pii(F.col("t")), t=t) == 3
    assert T.with_pii_count(spark.createDataFrame([(t, None)], "t string, u string"), ["t", "u"], "n").first()["n"] == 3


def test_unicode(spark):
    normal = lambda t: T.with_normal_text(spark.createDataFrame([(t,)], "t string"), ["t"]).first()["t"]
    assert normal("I’m fine — really…not.") == "I'm fine - really...not." and normal(None) == ""


@pytest.mark.parametrize("t, n", [("Should I invest in ETFs?", 1), ("What is the best pizza topping?", 0)])
def test_financial(spark, t, n):
    hits = one(spark, T.lexicon_hits(F.col("t"), ["invest", "etf"]), t=t)
    assert hits == n


def test_reasons_in_order(spark):
    long = "How should I budget my money every month? "
    rows = spark.createDataFrame([
        (0, "s", None, "x"), (1, "s", "short", "a b c"), (2, "s", long * 200, "a b c"), (3, "s", long, "a"), (4, "s", long, "x " * 9000), (5, "s", "#12 :34 #56 :78 #90 :11 ab", "a b money"),
        (6, "s", "What is the best pizza topping here?", "cheese or ham here"), (7, "s", "What is my net worth, roughly?", "It is money well spent"), (8, "s", long, "Save some money first."),
        (9, "financebench", "What was the total here in words?", "$1577"), (10, "s", long, ""),
    ], "ord long, source string, question string, answer string")
    got = {r["ord"]: r["reason"] for r in C.with_reason(rows).collect()}
    assert got == {0: "unparseable", 1: "question_too_short", 2: "question_too_long", 3: "answer_too_short", 4: "answer_too_long", 5: "low_alpha_ratio", 6: "non_financial",
                   7: "profiling", 8: None, 9: None, 10: "answer_too_short"}
    assert C.with_reason(rows.limit(0)).count() == 0


def test_dedup_kinds(spark):
    rows = spark.createDataFrame([
        (0, "s", "How do I save?", "a"), (1, "s", "how do i  save?", "a"), (2, "s", "How do I save?", "b"), (3, "s", "Other", "a"), (4, "t", "How do I save?", "a"), (5, "s", " ", "a"),
    ], "ord long, source string, question string, answer string")
    got = {r["ord"]: r["kind"] for r in C.dedup_exact(rows).collect()}
    assert got == {0: "kept", 1: "exact", 2: "same_question", 3: "kept", 4: "kept", 5: None}


def greedy(rows):
    """The sequential rule, for comparison."""
    out, sigs, questions, blocks = {}, set(), set(), {}
    for ord_, source, q, a in rows:
        q, a = " ".join(q.lower().split()), " ".join(a.lower().split())
        if not q:
            out[ord_] = None
        elif (source, q, a) in sigs:
            out[ord_] = "exact"
        elif (source, q) in questions:
            out[ord_] = "same_question"
        elif any(SequenceMatcher(None, q, o).ratio() >= 0.92 for o in blocks.get((source, q[:8]), [])):
            out[ord_] = "fuzzy"
        else:
            sigs.add((source, q, a))
            questions.add((source, q))
            blocks.setdefault((source, q[:8]), []).append(q)
            out[ord_] = "kept"
    return out


def test_fuzzy_equals_the_sequential_rule(spark):
    rows = docs_as_qa(spark, SMALL).orderBy("ord").collect()
    want = greedy([(r["ord"], r["source"], r["question"], r["answer"]) for r in rows])
    got = {r["ord"]: r["kind"] for r in C.dedup_fuzzy(docs_as_qa(spark, SMALL)).select("ord", "kind").collect()}
    # A repeated pair is exact if its answer is the first one's; the sequential rule agrees.
    assert got == want
    near = spark.createDataFrame([(0, "s", "how do i save money today", "a"), (1, "s", "how do i save money todaY!", "a"), (2, "s", "how do i save money todaY!", "a")], "ord long, source string, question string, answer string")
    assert [r["kind"] for r in C.dedup_fuzzy(near).orderBy("ord").collect()] == ["kept", "fuzzy", "fuzzy"]


def test_split_counts_are_exact(spark):
    rows = spark.range(103).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.when(F.col("id") < 90, "a").alias("source"))
    out = M.split(rows).groupBy("source", "split").count().collect()
    assert {(r["source"], r["split"]): r["count"] for r in out} == {("a", "train"): 72, ("a", "val"): 9, ("a", "test"): 9, (None, "train"): 10, (None, "val"): 2, (None, "test"): 1}


def test_violations(spark):
    rows = spark.createDataFrame([([("user", "x"), ("assistant", "y")],), ([("bot", " ")],), ([],), (None,)], f"messages {M.MESSAGES}")
    got = [list(r["e"]) for r in rows.select(M.violations(F.col("messages")).alias("e")).collect()]
    assert got[0] == []
    assert got[1] == ["messages[0] has invalid role bot", "messages[0] has empty content", "last message role must be 'assistant'", "messages must contain a 'user' turn"]
    assert got[2] == got[3] == ["'messages' must be a non-empty list"]


def test_json_lines_round_trip(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"input": "q1", "output": "a1", "n": 3}\n\n{"input": "q2", "output": null, "n": 4}\n')
    raw = jsonl.read_raw(spark, str(tmp_path / "raw.jsonl"))
    parsed = C.parse_raw(raw, "fingpt-fiqa-qa").orderBy("ord").collect()
    assert [(r["ord"], r["question"], r["answer"], r["aux"]) for r in parsed] == [(0, "q1", "a1", {"n": "3"}), (1, "q2", None, {"n": "4"})]
    assert C.parse_raw(raw, "unknown").first()["question"] is None
    rows = spark.createDataFrame([("s-0000", "s", "q", "a", {"k": "v"})], jsonl.CLEANED)
    jsonl.write_cleaned(rows, str(tmp_path / "clean"))
    chat = M.split(M.chat_records(rows))
    jsonl.write_splits(chat, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 1
    gold = jsonl.read_evaluation(spark, [str(tmp_path / "splits")]).first()
    assert (gold["question"], gold["gold"]) == ("q", "a")


def test_places_follow_file_names(spark, tmp_path):
    """Files of unequal size, which the scan does not read in the order of their names."""
    folder, want = tmp_path / "raw", []
    folder.mkdir()
    for name, n in (("a", 3), ("b", 4000), ("c", 50)):
        rows = [f"{name}{k}" for k in range(n)]
        want += rows
        (folder / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"question": r}) for r in rows))
    got = jsonl.read_raw(spark, str(folder)).orderBy("ord").collect()
    assert [r["question"] for r in got] == want and [r["ord"] for r in got] == list(range(len(want)))


def test_evaluation_sources_and_sinks(spark, tmp_path):
    (tmp_path / "curated.jsonl").write_text(json.dumps({"question": "How do I pay off my debt?", "gold": "g"}) + "\n" + json.dumps({"id": "x", "source": "s", "question": "q", "category": "own"}))
    with pytest.warns(UserWarning, match="missing"):
        got = jsonl.read_evaluation(spark, [str(tmp_path / "missing")], [str(tmp_path / "curated.jsonl")]).collect()
    assert [(r["id"], r["source"]) for r in got] == [("curated-?", "curated"), ("x", "s")] and got[1]["category"] == "own" and got[0]["category"] != "own"
    one = spark.createDataFrame([("1", "test", "debt", "q", "g", "a", 1, 2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 4.0)], "id string, source string, category string, question string, gold string, generated string, "
                                "word_count int, char_count int, length_adequacy double, repetition_score double, punctuation_score double, coherence double, keyword_coverage double, relevance double, rubric double")
    summary = spark.createDataFrame([("rubric", 1, 4.0, 4.0, 0.0)], "metric string, n int, mean double, median double, stdev double")
    by = spark.createDataFrame([("debt", 1, 4.0, 1.0, 1.0, 1.0, 1.0)], "category string, n int, rubric double, relevance double, keyword_coverage double, coherence double, share double")
    jsonl.write_results(one, summary, str(tmp_path / "out"), by)
    back = spark.read.option("header", "true").csv(str(tmp_path / "out/results.csv"))
    assert tuple(back.columns) == jsonl.RESULT_COLUMNS and len(back.columns) == 17 and back.first()["judge_relevance"] is None
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out/summary.txt")).collect()]
    assert len(lines) == 3 and lines[2].split() == ["debt", "1", "4.000", "1.000", "1.000", "1.000", "100.0%"]
    manifest = jsonl.write_samples(spark, {"one": one.selectExpr("id", "1 as ord")}, str(tmp_path / "samples")).collect()
    assert [(r["source"], r["rows"]) for r in manifest] == [("one", 1)]


def test_near_pairs_are_all_pairs(spark):
    import random

    random.seed(4)
    base = ["what is the best way to save money for a house in the city this year " + "".join(random.choice("abcde ") for _ in range(n)) for n in (0, 40, 90)]
    texts = []
    for _ in range(70):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 9)):
            t[random.randrange(8, len(t))] = random.choice("xyz")
        texts.append("".join(t))
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, question string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    keys = [" ".join(t.split()) for t in texts]
    want = {(a, b): d for b in range(70) for a in range(b) if (d := distance(keys[a], keys[b])) <= int(max(len(keys[a]), len(keys[b])) * 0.08)}
    assert {(r["a"], r["b"]): r["distance"] for r in C.near_pairs(rows).collect()} == want and want
