"""The ten operators against brute force, round trips and held-out answers."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as Q
from ledgerloom.llm.components import components
from ledgerloom.llm.html_text import LEAST, Page, extract
from ledgerloom.llm.jaccard_join import jaccard_join
from ledgerloom.llm.language import identify, learn
from ledgerloom.llm.line_templates import _dropped_by_join, drop_recurring_lines, recurring_lines
from ledgerloom.llm.mixing import mixed_documents, mixed_sizes
from ledgerloom.llm.near_vectors import near_vectors
from ledgerloom.llm.packing import WordEncoder, pack
from ledgerloom.llm.quality import Evidence, classify, fit_evidence
from ledgerloom.llm.url_filter import RULES, judge_urls
from ledgerloom.llm.vector_graph import nearest

from ..conftest import SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, s int"


def docs_of(spark, *texts, ids=None, source="s", lang="en"):
    """Documents with two more columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", 1) for i, t in zip(ids, texts)], DOC)


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# --- components


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(300, 380)] + [(400, 400 + k) for k in range(60)] + [(5, 5), (5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union_find(500, [e for e in edges if None not in e])
    assert got == {k: want[k] for e in edges if None not in e and e[0] != e[1] for k in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op10


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], union_find(len(sets), links)


def near_texts(seed, groups=6, copies=12):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    common = " ".join(rng.choice(words, 60))
    for _ in range(groups):
        base = list(rng.choice(words, int(rng.integers(5, 200))))
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, 8))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            out.append(" ".join(own) + (" " + common if rng.random() < 0.3 else ""))
    return out + [common] * 5 + ["", None, "a b", "A  b", "a\u00a0b", "x", " \t\n"]


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_join_is_exact(spark, seed):
    texts = near_texts(seed)
    sizes, component = jaccard_brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs_of(spark, *texts)).collect()}
    assert got == {k: (sizes[k], component[k]) for k in range(len(texts))}


def test_jaccard_join_of_large_regions(spark, monkeypatch):
    import ledgerloom.llm.jaccard_join as J

    # Small limits send every region through the recursion, in several rounds.
    for name, value in (("SMALL", 2), ("ROUND_PAIRS", 50), ("ROUND_PIVOTS", 2), ("OFTEN", 2)):
        monkeypatch.setattr(J, name, value)
    texts = near_texts(9, groups=3, copies=25)
    sizes, component = jaccard_brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join(docs_of(spark, *texts)).collect()}
    assert got == dict(enumerate(component))


def test_sets_of_one_fingerprint_stay_apart(spark):
    import ledgerloom.llm.jaccard_join as J
    import ledgerloom.llm.shingles as S

    assert J._name(np.array([5], np.uint64), frozenset()) == S.fingerprint(np.array([5], np.uint64))
    clash = frozenset([S.fingerprint(np.array([5], np.uint64))])
    assert J._name(np.array([5], np.uint64), clash) == S.second_fingerprint(np.array([5], np.uint64)) != S.fingerprint(np.array([5], np.uint64))
    assert dict(jaccard_join(docs_of(spark, "a b")).dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}


def test_jaccard_join_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    sizes, component = jaccard_brute([r["text"] for r in docs])
    ids = [r["doc_id"] for r in docs]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op10_ngram_jaccard_join(spark, SMALL).collect()}
    assert got == {i: (sizes[k], ids[component[k]]) for k, i in enumerate(ids)}


def test_jaccard_join_edges(spark):
    assert jaccard_join(docs_of(spark).limit(0)).count() == 0
    long = "word " * 60_000
    rows = jaccard_join(docs_of(spark, "a b c d e f", "a b c d e f", "q r s t u", long, long + "end", ids=[4, None, 4, 7, 9])).collect()
    assert len(rows) == 5
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (7, 9)) == [(7, 7), (9, 9)]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [4]


# --- op1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, cell string")


def vector_brute(rows, threshold=0.98):
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for a in good:
        for b in good:
            if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    n = Counter(k for e in links for k in e)
    return n, links


@pytest.mark.parametrize("block, cell", [(2048, 2048), (16, 20)])
def test_near_vectors_are_exact(spark, monkeypatch, block, cell):
    import ledgerloom.llm.near_vectors as V

    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "CELL", cell)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for k in range(150):
        v = base[k % 12] + rng.normal(size=8) * 0.15
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3 == 0)))
    rows += [(200 + k, rows[0][1], 1) for k in range(3)]
    rows += [(300, [0.0] * 8, 1), (301, None, 1), (302, [float("nan")] * 8, 1), (303, [1.0, None] * 4, 1), (304, rows[0][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [float("inf")] * 8, 0)]
    n, links = vector_brute(rows)
    ids = [r[0] for r in rows]
    component = union_find(len(rows), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(vectors(spark, rows)).collect()}
    assert got == {i: (n[k], min(ids[j] for j in range(len(rows)) if component[j] == component[k]), ids[component[k]] == i) for k, i in enumerate(ids)}


def test_near_vectors_edges(spark):
    assert near_vectors(vectors(spark, []).limit(0)).count() == 0
    rows = near_vectors(vectors(spark, [(None, [1.0], 1), (2, [1.0], 1), (2, [1.0], 1)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in rows) == [(0, 0, False), (2, 1, True), (2, 1, True)]


def test_near_vectors_with_repeated_ids(spark):
    """Rows of one id are vectors of their own."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.0, 1.0], 1), (5, [1.0, 0.01], 2), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], 3)]
    got = sorted(tuple(r) for r in near_vectors(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True)]


def test_near_vectors_of_doubles_and_text_labels(spark):
    def turned(c):
        return [c, math.sqrt(1 - c * c)]

    rows = [(1, [1.0, 0.0], "a"), (2, turned(0.98 - 1e-10), "a"), (3, [1e300, 0.0], "b"), (4, [x * 1e-300 for x in turned(0.98 + 1e-10)], "b"), (5, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_near_vectors_in_cells_of_cells(spark, monkeypatch):
    import ledgerloom.llm.near_vectors as V

    for name, value in (("CELL", 10), ("FAN", 3), ("SAMPLE", 60), ("ROWS", 40), ("BLOCK", 16)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9, 6))
    rows = [(k, [float(np.float32(x)) for x in base[k % 9] + rng.normal(size=6) * 0.2], 1) for k in range(160)] + [(500 + k, [1.0 + 1e-4 * k] + [0.0] * 5, 1) for k in range(1)]
    rows += [(600 + k, [1.0, 1e-5 * k, 0.0, 0.0, 0.0, 0.0], 1) for k in range(40)]  # does not come apart
    n, links = vector_brute(rows)
    component = union_find(len(rows), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(vectors(spark, rows)).collect()}
    assert got == {r[0]: (n[k], rows[component[k]][0]) for k, r in enumerate(rows)}


# --- op5


def test_nearest_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in rows])
    found = defaultdict(list)
    for r in Q.op5_nearest_neighbours(spark, SMALL).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -9
        top = np.lexsort((ids, -s))[:5]
        hits += len(set(ids[top]) & {i for i, _ in found[ids[k]]})
        assert all(abs(score - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, score in found[ids[k]])
    assert hits >= 0.9 * 5 * len(found) and len(found) == (ids % 50 == 0).sum()


def clustered(n, seed):
    """Clusters of all sizes, near copies among them, and some vectors of no cluster."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 80, 24))
    x = centres[rng.integers(0, len(centres), n) % rng.integers(1, len(centres), n)] + rng.normal(size=(n, 24)) * rng.choice([0.01, 0.3, 0.6], (n, 1))
    x[: n // 20] = rng.normal(size=(n // 20, 24))
    return x.astype(np.float32)


@pytest.mark.parametrize("shard, probes, n", [(16_384, 16, 9000), (400, 6, 8000)])
def test_nearest_recall(spark, monkeypatch, shard, probes, n):
    """One large shard, and twenty shards of which a query asks the nearest six."""
    import ledgerloom.llm.vector_graph as V

    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "PROBES", probes)
    x = clustered(n, 4)
    rows = vectors(spark, [(k, v, 1) for k, v in enumerate(x.tolist())])
    found = defaultdict(set)
    for r in nearest(rows, rows.where("vec_id % 50 = 0"), 5).collect():
        found[r["query_id"]].add(r["vec_id"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for k in range(0, n, 50):
        s = u @ u[k]
        s[k] = -9
        hits += len(found[k] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert len(found) == n // 50 and hits >= 0.95 * 5 * len(found), hits / 5 / len(found)


def test_nearest_edges(spark):
    rows = vectors(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, [0.0, 0.0], 1), (4, None, 1), (50, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)] + [(100 + k, [2.0, 0.0], 1) for k in range(9)])
    got = defaultdict(list)
    for r in nearest(rows, rows.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [100, 101, 102, 103, 104] and got[50] == [1, 2, 0, 100, 101] and got[100] == [0, 101, 102, 103, 104]
    two = vectors(spark, [(0, [1.0], 1), (7, [2.0], 1)])
    assert [(r["vec_id"], r["rank"]) for r in nearest(two, two.where("vec_id = 0"), 5).collect()] == [(7, 1)]
    assert nearest(two.limit(0), two).count() == 0 and nearest(two, two.limit(0)).count() == 0


# --- op2


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = Q.op2_language_id(spark, SMALL).collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 3, "text string, lang string")
    model = learn(train)
    docs = docs_of(spark, None, "", "123 !!", "the dog", "die katze", "katzenhund", "the " * 50_000, lang="xx")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0.5) for r in identify(docs, model).collect()}
    assert got == {0: ("und", False), 1: ("und", False), 2: ("und", False), 3: ("en", True), 4: ("de", True), 5: ("de", True), 6: ("en", True)}
    nothing = learn(train.limit(0))
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"} and identify(docs.limit(0), model).count() == 0


def language_brute(train, texts):
    """The whole model in dictionaries."""
    from ledgerloom.llm.language import LONGEST, UNSEEN, grams, words

    langs = sorted({lang for _, lang in train})
    tables = (defaultdict(lambda: np.zeros(len(langs))), defaultdict(lambda: np.zeros(len(langs))))
    for text, lang in train:
        for w in words(text):
            tables[0][w][langs.index(lang)] += 1
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    tables[1][g][langs.index(lang)] += 1
    totals = [sum(t.values()) + UNSEEN * (len(t) + 1) for t in tables]
    score = [{k: np.log((c + UNSEEN) / total) for k, c in t.items()} for t, total in zip(tables, totals)]
    docs = np.array([sum(x == lang for _, x in train) for lang in langs], float)
    out = []
    for text in texts:
        found = words(text)
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        total = np.log((docs + 1) / (docs + 1).sum())
        for w in found:
            own = score[0].get(w)
            for n in range(LONGEST, 0, -1):
                if own is None and (hits := [score[1][g] for g in grams(w, n) if g in score[1]]):
                    own = np.mean(hits, axis=0)
            if own is not None:
                total = total + own / max(1.0, len(found) ** 0.5)
        p = np.exp(total - total.max())
        out.append((langs[int(np.argmax(total))], float(1 / p.sum())))
    return out


@pytest.mark.parametrize("keys", [0, 20, 1 << 20])
def test_language_is_the_same_with_any_share_of_words_at_hand(spark, monkeypatch, keys):
    import ledgerloom.llm.language as G

    monkeypatch.setattr(G, "CELLS", 0)
    monkeypatch.setattr(G, "LEAST_KEYS", keys)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()
    train = [(r["text"], r["lang"]) for r in docs if r["text"] and r["lang"] and r["doc_id"] % 3]
    texts = [r["text"] for r in docs] + [None, "", "12", "zzzzqqq x", "a" * 5000, "\u0939\u093f\u0928\u094d\u0926\u0940"]
    model = learn(spark.createDataFrame(train, "text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs_of(spark, *texts), model).collect()}
    model.forget()
    for k, (lang, score) in enumerate(language_brute(train, texts)):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-9


def test_marks_stay_with_their_letters():
    from ledgerloom.llm.language import words

    assert words("\u0939\u093f\u0928\u094d\u0926\u0940 e\u0301te 1a_b") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "e\u0301te", "a", "b"]


# --- op3


def check_pieces(rows, texts, encode):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*encode(text or ""), 1], "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    padding = tokens = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / tokens


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_pieces(Q.op3_packing(spark, SMALL).collect(), texts, encode) < 0.01
    odd = {0: None, 1: "", 2: "a\x1cb", 3: "word " * 30_000, 4: "don't we'll <|endoftext|> X", 5: "ÀÉ İ ΣΑΣ 中文 ²"}
    rows = pack(docs_of(spark, *odd.values()).repartition(5)).collect()
    check_pieces(rows, odd, encode)
    assert pack(docs_of(spark).limit(0)).count() == 0
    assert pack(docs_of(spark, "a", "a", ids=[3, 3])).count() == 2 and pack(docs_of(spark, "a", ids=[None])).count() == 1


def test_encoder_equals_tokenizer():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), WordEncoder(path)
    random.seed(5)
    alphabet = "abcDEéÉßµªºÀÞ×÷ĞİıŁ  \t\n\x01\x1c\x85\xa0.,!'\"#$|<>[]^_`{}~019²½Ⅷ中ΣςЖ👍́​"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [g.tolist() for g in encoder.encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


# --- op4


def rule_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = max((r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_urls(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()] + [
        None, "", "no scheme", "http://", "http://EXAMPLE.com/en/70?x=/y", "ftp://a.b.com", "x://com/en/", "x://acom/en/", "http://h?q/en/", "http://h#f/en/", "http://example.net/de/8", "http://é.NET/de/1",
        "http://a.org/es/" + "z" * 20_000, "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, "<p>", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, key string")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = rule_brute(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] in ("allow", "block") and (verdict is None or got[k]["verdict"] == verdict)
    assert judge_urls(pages.limit(0)).count() == 0
    assert [r["verdict"] for r in judge_urls(pages.where("url is null")).collect()] == ["allow"]


def test_url_models_tell_apart(spark):
    rng = np.random.default_rng(2)
    word = lambda letters: "".join(rng.choice(list(letters), 9))
    rows = [f"http://{word('abcde')}.net/de/{word('abcde')}" for _ in range(150)] + [f"http://{word('vwxyz')}.org/es/{word('vwxyz')}" for _ in range(150)]
    rows += [f"http://{word('abcde')}.io/q/{word('abcde')}" for _ in range(40)] + [f"http://{word('vwxyz')}.io/q/{word('vwxyz')}" for _ in range(40)]
    got = judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).where("page_id >= 300").collect()
    assert np.mean([(r["verdict"] == "allow") == (r["page_id"] < 340) for r in got]) >= 0.95


def test_url_models_on_held_out_urls_of_the_table(spark, monkeypatch):
    """Urls that rules judge, a fifth of them with their rules hidden from the operator."""
    import ledgerloom.llm.url_filter as L

    plain = L.fitting_rule

    def hiding(host, path, rules):
        shown = F.pmod(F.crc32(F.concat(host, path).cast("binary")), F.lit(5)) != 0
        return tuple(F.when(shown, c) for c in plain(host, path, rules))

    monkeypatch.setattr(L, "fitting_rule", hiding)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    truth = {r["page_id"]: rule_brute(r["url"])[3] for r in pages.select("page_id", "url").collect()}
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages).collect() if r["rule"] is None and truth[r["page_id"]]}
    right = {v: np.mean([got[k] == v for k in got if truth[k] == v]) for v in ("allow", "block")}
    assert len(got) > 50 and min(right.values()) >= 0.95, right


def test_least_error():
    from ledgerloom.llm.url_filter import least_error

    assert least_error([(2, 0, 5), (3, 0, 5), (9, 4, 0)]) == 6.5 and least_error([(1, 3, 0)]) is None and least_error([]) is None
    assert least_error([(1, 0, 10), (5, 1, 1), (9, 10, 0)]) in (3.5, 7.5)
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows = [(k, int(rng.integers(0, 3)), int(rng.integers(0, 3))) for k in sorted(rng.choice(40, 12, replace=False).tolist())] + [(50, 1, 1)]
        yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
        error = lambda c: sum(r[1] for r in rows if r[0] < c) / yes + sum(r[2] for r in rows if r[0] >= c) / no
        assert abs(error(least_error(rows)) - min(error(k - 0.5) for k in range(53))) < 1e-9


# --- op6


def test_quality(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r["quality_kept"] for r in Q.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    more = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert np.mean([got[k] == bool(q) for k, q in more.items()]) >= 0.97 and truth


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = classify(docs, fit_evidence(docs, labels.where("doc_id % 3 != 1"))).select("doc_id", "quality_kept").join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    assert np.mean([r["quality_kept"] == (r["quality"] == 1) for r in out]) >= 0.95


def test_quality_edges(spark):
    evidence = fit_evidence(docs_of(spark, "a b", "c d"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = docs_of(spark, None, " ", "some words here", "x " * 50_000, "some words here", source=None, lang=None)
    got = {r["doc_id"]: r["quality_kept"] for r in classify(docs, evidence).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True}
    assert set(docs.columns) < set(classify(docs, evidence).columns) and classify(docs.limit(0), evidence).count() == 0


def test_sites_decide_and_sparse_ones_shrink(spark):
    """Texts that say nothing: labelled outcomes of a site judge its other documents, one outcome does not."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30))
    sites = ["good"] * 150 + ["bad"] * 150 + ["mixed"] * 150 + ["once"] * 10
    docs = spark.createDataFrame([(k, text(), "en", s, "x") for k, s in enumerate(sites)], "doc_id long, text string, lang string, source string, host string")
    outcome = {"good": 1, "bad": 0}
    labels = [(k, outcome.get(s, k // 2 % 2), 0) for k, s in enumerate(sites) if k % 2 and s != "once"] + [(450, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    evidence = Evidence.fit(np.zeros((40, 12)), np.arange(40) % 2 * 1.0)  # knows nothing
    got = {r["doc_id"]: r for r in classify(docs, evidence, labels).collect()}
    score = lambda s: np.mean([r["quality_score"] for k, r in got.items() if sites[k] == s and k % 2 == 0])
    assert all(got[k]["quality_kept"] for k in range(0, 150, 2)) and not any(got[k]["quality_kept"] for k in range(150, 300, 2))
    assert score("good") > 0.7 > 0.3 > score("bad") and abs(score("once") - 0.5) < 0.15 < abs(score("bad") - 0.5)
    assert {r["quality_score"] > 0.4 for r in classify(docs, evidence).collect()} == {True} and got[0]["host"] == "x"


def test_own_evidence_is_left_out(spark):
    """A document alone in its site scores as its evidence alone does."""
    x = np.zeros((400, 12))
    x[:200, 0] = 1.0
    evidence = Evidence.fit(np.concatenate([x, x + 0.01]), np.concatenate([np.ones(200), np.zeros(200)] * 2))
    assert evidence.log_odds(np.ones((1, 12)))[0] != evidence.log_odds(np.zeros((1, 12)))[0]
    docs = spark.createDataFrame([(k, "a few words", "en", f"s{k}") for k in range(30)], "doc_id long, text string, lang string, source string")
    got = {round(r["quality_score"], 9) for r in classify(docs, evidence).collect()}
    assert len(got) == 1


def test_many_sites_are_joined(spark, monkeypatch):
    import ledgerloom.llm.quality as Y

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    evidence = fit_evidence(docs, labels)
    few = sorted((r["doc_id"], round(r["quality_score"], 9)) for r in classify(docs, evidence, labels).collect())
    monkeypatch.setattr(Y, "BROADCAST_SITES", 0)
    assert few == sorted((r["doc_id"], round(r["quality_score"], 9)) for r in classify(docs, evidence, labels, keep_text=False).collect())


# --- op7


def target_brute(sizes):
    """The targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * w[s] / sum(w[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, None if k % 17 == 0 else "w " * int(rng.integers(0, 60)), None if k % 5 == 0 else "abcdef"[int(rng.integers(6)) if k % 3 else 0], "x") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, sid string")
    got = mixed_sizes(docs).collect()
    by = defaultdict(int)
    for _, t, s, _ in rows:
        by[s] += len((t or "").split())
    target, source = target_brute(by), {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == 300 and all(abs(taken[s] - target[s]) <= 2 for s in by)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed_sizes(docs.repartition(7)).collect()))


def test_mixed_documents(spark):
    docs = docs_of(spark, *["one two three four"] * 40, None, "", source="a").union(docs_of(spark, *[f"w{k} x y" for k in range(30)], ids=range(100, 130), source="b"))
    out = mixed_documents(docs).collect()
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    target = target_brute({"a": 160, "b": 90})
    assert all(abs(sizes[s] - target[s]) <= 2 for s in target) and mixed_documents(docs.limit(0)).count() == 0
    assert mixed_sizes(docs.where("text is null")).first()["taken"] == 0


def test_small_sources_are_mixed(spark, monkeypatch):
    """Sources below and just above a block meet their targets, too."""
    import ledgerloom.llm.mixing as X

    monkeypatch.setattr(X, "SLOTS", 16)
    sizes = {"a": 900, "b": 5, "c": 1, "d": 70, "e": 20, "f": 300}
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got, target = {k: r["taken"] for k, r in ((list(sizes)[r["doc_id"]], r) for r in mixed_sizes(docs).collect())}, target_brute(sizes)
    assert all(abs(got[s] - target[s]) <= 0.5 for s in sizes)
    parts = Counter()
    for r in mixed_documents(docs).collect():
        parts[r["source"]] += len(r["text"].split())
    assert dict(parts) == got


# --- op8


PAGES = [
    ("<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p><b>Bold  text<br><p>Next&nbsp;one<div class='ad'>buy</div></article><footer>f</footer>", "T & t Bold text Next one"),
    ("<body><header>h</header><main><p>Main</p><section id=comments><p>nice!</p></section></main><aside>s</aside>", "Main"),
    ("<p>plain<script>var a='<p>no</p>'</script> text<!-- <p>x</p> --><form><input>q</form>", "plain text"),
    ("<div class=\"cookie-notice\">ok?</div><div>kept <i>in</i>line</div>", "kept inline"),
    ("no tags &lt;here&gt; &eacute;&#233;&#x41;", "no tags <here> ééA"), ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("<script>never ends", ""),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>", "a b c x y"),
    ("<article><header><h1>Head</h1></header><p hidden>no</p><p>yes</p></article>", "Head yes"),
    ("<article><p title=it's>one</p><p>two</p><p data-x='a>b'>three</p></article><p>no</p>", "one two three"),
    ("<article><p class='search'>a</p><ul class=menu-items><li>b</ul><p class=ad>no</p><p data-id=nav>c</p></article>", "a b c"),
    ("<table><tr><td><b>x</td></b><td>y</table></b>z", "x y z"),
    ("<p>" * 3000 + "deep", "deep"), ("<article>" + "<div>" * 2000 + "in" + "</article>", "in"),
]


@pytest.mark.parametrize("html, want", PAGES)
def test_page_text(html, want):
    assert Page(html or "").text(lambda h: False) == want


def test_templates_are_per_host(spark):
    page = lambda k, host: (k, f"http://{host}/p{k}", f"<body><div><span>Site wide note</span></div><div>own text {k}</div></body>", "x")
    rows = [page(k, "a.com") for k in range(LEAST + 3)] + [page(100 + k, f"h{k}.com") for k in range(3)] + [(200, None, None, "x"), (201, None, "", "x"), (5, "http://a.com/p5", page(5, "a.com")[2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tree string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(pages).collect())
    assert [t for i, t, _ in got if i < 100] == [f"own text {i}" for i, _, _ in got if i < 100]
    assert [t for i, t, _ in got if 100 <= i < 200] == [f"Site wide note own text {i}" for i, _, _ in got if 100 <= i < 200]
    assert [t for i, t, _ in got if i >= 200] == ["", ""] and extract(pages.limit(0)).count() == 0


def test_mirrors_are_no_template(spark):
    """Copies of a page, and other pages around one article, keep their text."""
    body = "<article><div><p>The same text</p><p>stands here.</p></div></article>"
    rows = [(k, f"http://a.com/{k}", f"<body>{body}</body>") for k in range(6)] + [(10 + k, f"http://b.com/{k}", f"<body><p>side {k}</p>{body}</body>") for k in range(6)]
    rows += [(20 + k, f"http://c.com/{k}", "<body><div>All of it is one block.</div></body>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in (*range(6), *range(10, 16))} == {"The same text stands here."}
    assert {got[20 + k] for k in range(6)} == {"All of it is one block."}


def test_template_removal_decides(spark):
    """Sites without telling tags or names: only what the pages of a host share tells it apart."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows, want = [], {}
    for host in range(4):
        top, side, bottom, bar = (prose(9) for _ in range(4))
        for k in range(30):
            own = [prose(20) for _ in range(3)]
            i = 100 * host + k
            want[i] = " ".join(own)
            inner = "".join(f"<div>{x}</div>" for x in own)
            rows.append((i, f"http://h{host}.com/{k}", f"<body><div><b>{top}</b></div><table><tr><td>{side}<td>{inner}</table><article-x><div>{bar}</div></article-x><div>{bottom}</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert got == want
    assert all(Page(h).text(lambda _: False) != want[i] for i, _, h in rows)


def test_templates_on_large_hosts(spark, monkeypatch):
    import ledgerloom.llm.html_text as H

    monkeypatch.setattr(H, "MANY", 8)
    rows = [(k, f"http://a.com/{k}", f"<body><div>own {k}</div>{'<div>A rare notice</div>' if k < 8 else ''}</body>") for k in range(300)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own {k}" for k in range(300)}


def test_parsing_time_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        Page("<p>" + "<div>" * n + "x" + "</b>" * n).text(lambda h: False)
        Page("<b><table>" + "<div>" * n + "x" + "</b>" * n).text(lambda h: False)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


def test_templates_by_join(spark, monkeypatch):
    import ledgerloom.llm.html_text as H

    rows = [(k, f"http://a.com/p{k}", f"<body><div>Site wide note</div><div>own text {k}</div></body>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(H, "BROADCAST_TREES", -1)
    assert sorted(r["text"] for r in extract(pages).collect()) == [f"own text {k}" for k in range(9)]


def test_articles_of_the_table(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in Q.op8_html_extraction(spark, SMALL).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1|br)[^>]*>", re.sub("</?b>", "", inner)))
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- op9


def recurring(spark):
    note = "All rights reserved by the office number {} today."
    texts = [f"Opening words of {k} go first.\n{note.format(k)}\nClosing {k} words end it all {k}." if k % 2 else f"{note.format(k)}\nBody {chr(97 + k % 26)}{k} line goes on here." for k in range(40)]
    copies = ["Shared first line of copies.\nShared second line of copies.\nShared third line of copies."] * 40
    edited = [f"Shared first line of copies.\nShared second line of copies.\nShared third line of copies with edit {chr(97 + k % 26)}." for k in range(3)]
    return texts, copies + edited


def test_line_templates(spark):
    texts, copies = recurring(spark)
    docs = docs_of(spark, *texts, *copies, None, "", "All rights reserved by the office number 7 today.", "a\n" * 20_000)
    out = {r["doc_id"]: r for r in drop_recurring_lines(docs).collect()}
    for k, t in enumerate(texts):
        assert "rights reserved" not in out[k]["text"] and len(out[k]["dropped_lines"]) == 1
        assert out[k]["text"] == "\n".join(x for x in t.split("\n") if "rights reserved" not in x)
    for k, t in enumerate(copies):
        assert out[40 + k]["text"] == t
    rest = [out[40 + len(copies) + k]["text"] for k in range(4)]
    assert rest[:3] == [None, "", "All rights reserved by the office number 7 today."] and rest[3] == "a\n" * 20_000
    assert drop_recurring_lines(docs.limit(0)).count() == 0 and set(docs.columns) < set(drop_recurring_lines(docs).columns)


def test_lines_by_join(spark):
    texts, copies = recurring(spark)
    docs = docs_of(spark, *texts, *copies, None, "")
    drop, _ = recurring_lines(docs)
    joined = {r["doc_id"]: (r["text"], list(r["dropped_lines"])) for r in _dropped_by_join(docs, drop, "text").collect()}
    direct = {r["doc_id"]: (r["text"], list(r["dropped_lines"])) for r in drop_recurring_lines(docs).collect()}
    assert joined == direct


def test_shared_passages_go_whole(spark):
    """All lines of a passage that unrelated documents share, also where near copies hold it."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n))
    notice = ["First line of the notice here.", "Second words in the notice stand.", "Third of its lines.", "The last one of them all."]
    unrelated = ["\n".join([prose(40), *notice][:: 1 if k % 2 else -1]) for k in range(20)]
    base = [prose(12) for _ in range(12)]
    near = []
    for _ in range(150):
        lines = [*base[:6], *notice, *base[6:]]
        words = lines[at := int(rng.choice([0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 15]))].split()
        words[int(rng.integers(12))] = prose(1)
        lines[at] = " ".join(words)
        near.append("\n".join(lines))
    out = {r["doc_id"]: r["text"] for r in drop_recurring_lines(docs_of(spark, *unrelated, *near)).collect()}
    for k, t in enumerate([*unrelated, *near]):
        assert out[k] == "\n".join(x for x in t.split("\n") if x not in notice)


def test_few_documents_suffice(spark):
    rng = np.random.default_rng(4)
    own = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(60)) for _ in range(5)]
    out = drop_recurring_lines(docs_of(spark, *[f"{t}\nA note that five have." for t in own])).collect()
    assert sorted(r["text"] for r in out) == sorted(own)


def test_names(spark):
    known = Q.queries()
    assert [k.split("_")[0] for k in known] == [f"op{n}" for n in range(1, 11)] and all(F and callable(f) for f in known.values())
