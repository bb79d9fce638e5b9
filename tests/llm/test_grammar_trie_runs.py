"""Toxicity, prefix trie and periodic runs against brute force, SQL and held-out labels."""

import random
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import queries as Q
from ledgerloom.llm.double_array import DoubleArray
from ledgerloom.llm.oracles import PREFIX_TRIE
from ledgerloom.llm.periodic_runs import PRIMES, Transform, find_runs, matches, periodic_runs
from ledgerloom.llm.prefix_trie import prefix_trie
from ledgerloom.llm.toxicity import Model, evidence, grammar, learn, symbol_table, toxicity
from ledgerloom.llm.toxicity import _UNLABELLED as UNLABELLED

from ..conftest import SMALL

# --- periodic runs


def slow_runs(x):
    """Every stretch whose words are identical q apart, for every q."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made_up(rnd):
    letters, x = rnd.choice([1, 2, 3, 30]), []
    for _ in range(rnd.randrange(8)):
        word = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64]))]
        if rnd.random() < 0.3:
            word = word * rnd.randrange(1, 4) + [rnd.randrange(letters)]
        x += (word * 6)[: int(len(word) * rnd.uniform(0.5, 6))]
    return x


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    for _ in range(400):
        x = made_up(rnd)
        assert find_runs(np.array(x, np.int64)) == slow_runs(x)
    for n in (23, 24, 25, 3000):
        assert find_runs(np.zeros(n, np.int64)) == ([(0, n, 1)] if n >= 24 else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 6))
def test_runs_of_repeated_lists(x, times):
    x = x * times
    assert find_runs(np.array(x, np.int64)) == slow_runs(x)


def test_transform_is_an_exact_convolution():
    rng = np.random.default_rng(5)
    for prime, root in PRIMES:
        a, b = rng.integers(0, 50, (2, 3, 16))
        t = Transform(16, prime, root)
        got = t.back(t.there(a.astype(np.uint64)) * t.there(b.astype(np.uint64)) % np.uint64(prime))
        want = [[sum(int(r[i]) * int(s[(k - i) % 16]) for i in range(16)) for k in range(16)] for r, s in zip(a, b)]
        assert got.tolist() == want
    rows = rng.integers(0, 2, (200, 8 + 15))
    got = set(zip(*map(np.ndarray.tolist, matches(rows, 8, 1, 16))))
    assert got == {(r, d) for r in range(200) for d in range(1, 16) if (rows[r, :8] == rows[r, d : d + 8]).all()}


def slow_row(doc, text, loop):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if loop and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_op13_equals_brute_force(spark):
    got = {tuple(r) for r in Q.op13_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 12000").collect()
    want = {slow_row(r["doc_id"], r["text"], True) for r in docs}
    assert want <= got and any(r[1] for r in want)
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a b\t" * 12), (4, "a b\t" * 12), (5, "\x1ca " * 40), (6, "é x " * 24), (7, "x " * 200_000 + "y"), (8, "a b " * 11 + "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "start": F.lit("z")})
    got = sorted(map(str, (tuple(r) for r in periodic_runs(docs, loop=True).collect())))
    assert got == sorted(str(slow_row(*r, True)) if r[0] != 7 else str(slow_row_of_x(r)) for r in rows)
    assert periodic_runs(docs.limit(0)).count() == 0


def slow_row_of_x(row):
    """The long row has one run, also when it is rewritten."""
    doc, text = row
    assert zlib.crc32(b"7") % 10, "the id must not ask for a rewriting"
    return doc, 1, 0, 200_000, 1, 200_000_000, sha256(b"0,200000,1\n").hexdigest(), sha256(b"x y").hexdigest()


# --- prefix trie

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return sorted(map(str, con.execute(PREFIX_TRIE).fetchall()))


def by_spark(df, **options):
    return sorted(str(tuple(r[c] for c in TRIE)) for r in prefix_trie(df, rebuild=True, **options).collect())


@pytest.fixture(scope="module")
def odd_turns():
    rnd, rows = random.Random(3), []
    for c in [*range(40), *range(95, 130), 200, 201, 5000]:
        for k in range(rnd.choice([0, 1, 3, 5, 8, 20])):
            rows.append((c, k if rnd.random() < 0.95 else None, rnd.choice(["user", "user", None]), rnd.choice(["a", "b", "", None, "cc"])))
    rows += [(c, k, "user", "a") for c, n in ((301, 70), (302, 70), (303, 65), (410, 3)) for k in range(n)]
    return rows + [(None, 1, "x", "y")] + [(310, 1, "user", "a")] * 4


def test_trie_equals_sql_over_segments_and_shards(spark, odd_turns):
    df = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string").withColumns({"k": F.lit(5), "a": F.lit("x")}).repartition(3)
    want = by_sql(odd_turns)
    assert by_spark(df) == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert by_spark(df, segment=8, shard=40) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_of_few_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], kind), rebuild=True).count() == 0
    lone = [(7, None, None, None)]  # 7 takes turns from 0, which is absent
    assert by_spark(spark.createDataFrame(lone, kind)) == by_sql(lone)
    plain = prefix_trie(spark.createDataFrame([(1, 0, "u", "ab"), (2, 0, "u", "ab"), (2, 1, "v", "c")], kind)).orderBy("depth").select(*TRIE[:7]).collect()
    assert [tuple(r) for r in plain] == [(1, 0, None, 2, 1, 1, 2), (1, 1, 1, 2, 1, 1, 2), (2, 2, 1, 1, 0, 1, 0)]


def test_op12_equals_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r[c] for c in TRIE)) for r in Q.op12_prefix_trie(spark, SMALL).collect()) == by_sql(rows)


def test_double_array_holds_what_was_added():
    rng = np.random.default_rng(4)
    for width in (3, 40, 2000):
        trie, level, known = DoubleArray(), np.array([0]), {}
        for _ in range(4):
            pairs = sorted({(int(s), int(c)) for s in level for c in rng.integers(0, width, rng.integers(0, 30))})
            if not pairs:
                break
            parents, symbols = np.array(pairs).T
            level = trie.add(parents, symbols)
            assert len(set(level.tolist())) == len(pairs)
            known |= {p: int(s) for p, s in zip(pairs, level)}
        states = sorted({s for s, _ in known} | set(known.values()))
        for s in states[:50]:
            got = trie.step(np.full(width, s), np.arange(width))
            assert got.tolist() == [known.get((s, c), -1) for c in range(width)]


# --- toxicity


def test_grammar_reads_clauses():
    score, table = grammar(), symbol_table({"mild": 1})

    def of(text):
        return evidence(text, table, score)[0]

    assert of("the idiot left") == 4 and of("the mild wind") == 1
    assert of("you idiot") == of("idiot you are") == 5
    assert of("pathetic loser") == 8.5
    assert of("you are no idiot") == of("you idiot") - 2.5 and of("you are not an idiot") == 1.5
    assert of("she said you are a idiot") == of("you idiot") - 1.5
    assert of("i will kill you") == 4 and of("they kill time") == of("they kill") == 0
    assert of("no, idiot") == 4 and of("he said, \"idiot\"") == 2.5
    assert of("you. idiot") == 4 and of("IDIOT!") == 4 and of("idiotic") == 0
    assert of("") == of(None) == of("nothing " * 1000) == 0


def test_composed_grammar_equals_plain_search():
    """Every way through the five transducers one after another, on random symbol strings."""
    from ledgerloom.llm.toxicity import insults, negations, reports, targets, threats

    def ways(t, symbols):
        now = [(0, "", 0.0)]
        for c in symbols:
            now = [(n, out + o, w + v) for s, out, w in now for n, o, v in t.arcs.get((s, c), ())]
        return [(out, w) for s, out, w in now if s in t.finals]

    rnd, score = random.Random(2), grammar()
    for _ in range(300):
        text = "".join(rnd.choice("ooocynrt1234") for _ in range(rnd.randrange(9)))
        now = [(text, 0.0)]
        for t in (insults(), threats(), targets(), negations(), reports()):
            now = [(out, w + v) for x, w in now for out, v in ways(t, x)]
        assert score(text) == max(w for _, w in now)
    assert score("n" + "o" * 500 + "4") == 4


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = Q.op11_toxicity(spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.95


def test_words_are_learned_from_labels(spark):
    rnd = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(400):
        text = [rnd.choice(words) for _ in range(40)]
        if k % 5 == 0:
            text.insert(rnd.randrange(40), rnd.choice(["grobnik", "fleem"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 5 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = learn(docs, marks)
    assert {"grobnik", "fleem"} <= model.strengths.keys()
    more = spark.createDataFrame([(1, "so grobnik"), (2, "wa wb"), (3, None), (4, ""), (4, ""), (None, "Fleem!"), (5, "wa " * 300_000 + "fleem")], docs.schema).withColumns({"toxic": F.lit(3), "e0": F.lit("x"), "score": F.lit(0.5)})
    got = [(r["doc_id"], r["predicted"]) for r in toxicity(more, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 0), (3, 0), (4, 0), (4, 0), (None, 1), (5, got[-1][1])], key=str)
    assert toxicity(more.limit(0), model).count() == 0
    bare = learn(docs.limit(0), marks.limit(0))
    assert not bare.strengths and [r["predicted"] for r in toxicity(spark.createDataFrame([(1, "you idiot"), (2, "hello")], docs.schema), bare).orderBy("doc_id").collect()] == [1, 0]
    ties = marks.union(marks).union(spark.createDataFrame([(None, 1), (3, None)], marks.schema))
    assert learn(docs.union(docs), ties).strengths == model.strengths


def test_unlabelled_model_is_calm_without_evidence():
    assert Model({}, UNLABELLED).probability(np.zeros((1, 5)))[0] < 0.1


def test_new_modules_name_no_local_folder():
    for name in ("toxicity", "transducers", "prefix_trie", "double_array", "periodic_runs"):
        assert "/tmp" not in Path(f"{Path(Q.__file__).parent}/{name}.py").read_text()
