"""Line dedup against its rule written plainly: tree, groups, counts and dropping together."""

import random
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import line_templates as L

MASK = "\x00"


def masked(line):
    return tuple(MASK if any(c.isdigit() for c in w) else w for w in line.split())


def name_of(tokens):
    """The operator's name of a line, which decides between equally frequent heads."""
    data = np.frombuffer(" ".join("0" if t == MASK else t for t in tokens).encode(), np.uint8)
    return int(L._cut(data, np.array([len(data)])).line[0].view(np.int64))


def closure(nodes, links):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        at[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def likeness(a, b):
    return len(a & b) / len(a | b)


def plain(texts):
    """The lines that each text keeps."""
    whole = {t: [masked(x) for x in t.split("\n")] for t in set(texts)}
    docs = {t: set(x for x in lines if x) for t, lines in whole.items() if sum(map(bool, lines)) > 1}
    words = {t: [w for x in whole[t] for w in x] for t in docs}
    shingles = {t: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for t, w in words.items()}
    near = [(a, b) for a, b in combinations(docs, 2) if likeness(shingles[a], shingles[b]) >= 0.85]
    unsure = [1 for a, b in combinations(docs, 2) if 0.2 < likeness(shingles[a], shingles[b]) < 0.85]
    assert not unsure  # such pairs would be grouped by chance
    group = closure(docs, near)
    n, leaves, parts, links = {}, {}, {}, []
    for lines in docs.values():
        for x in lines:
            n[x] = n.get(x, 0) + 1
    for x in n:
        leaves.setdefault((len(x), x[: L.DEPTH]), []).append(x)
    for leaf, lines in leaves.items():
        rest, d = max(0, leaf[0] - L.DEPTH), L.different(leaf[0])
        cuts = [rest * k // (d + 1) for k in range(d + 2)] if d < rest else [0, 0]
        for x in lines:
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                parts.setdefault((leaf, k, x[L.DEPTH :][a:b]), []).append(x)
    for lines in parts.values():
        head = max(lines, key=lambda x: (n[x], name_of(x)))
        links += [(x, head) for x in lines if x != head and sum(p == q for p, q in zip(x, head)) >= np.ceil(L.ALIKE * len(x) - 1e-9)]
    template = closure(n, links)
    held = {}
    for t, lines in docs.items():
        for name in {template[x] for x in lines}:
            held.setdefault(name, []).append(group[t])
    dropped = {name for name, g in held.items() if len(g) - max(g.count(x) for x in set(g)) >= L.LEAST}
    out = {}
    for t, lines in whole.items():
        hit = [k for k, x in enumerate(lines) if t in docs and x and template[x] in dropped]
        out[t] = hit[:-1] if len(hit) == sum(map(bool, lines)) else hit
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    sentence = lambda n: [word() for _ in range(n)]
    forms = [sentence(k) for k in (1, 2, 4, 5, 7, 10, 12)]

    def boilerplate():
        x = list(rnd.choice(forms))
        for k in range(len(x)):
            if k >= 2 and rnd.random() < 0.15:
                x[k] = word() if rnd.random() < 0.5 else f"n{rnd.randint(0, 99)}"
        return " ".join(x)

    out = []
    for _ in range(40):
        lines = [" ".join(sentence(rnd.randint(25, 40))) for _ in range(rnd.randint(4, 7))]
        for _ in range(rnd.randint(0, 2)):
            lines.insert(rnd.randint(0, len(lines)), boilerplate())
        if rnd.random() < 0.2:
            lines.insert(1, " ")
        out.append("\n".join(lines))
        for _ in range(rnd.choice([0, 0, 0, 1, 6])):  # near copies: a word or none changed
            again = out[-1].split(" ")
            again[-1] = word() if rnd.random() < 0.8 else again[-1]
            out.append(" ".join(again))
    x = " ".join(forms[4])
    return [*out, *[f"{x}\n{x}\n{x}"] * 2, x, x, "", "\n \n", " ".join(forms[2]) + "\n" + " ".join(forms[3])]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_its_rule(spark, seed):
    texts = corpus(seed)
    want = plain(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in L.drop_recurring_lines(df).collect()}
    assert len(got) == len(texts) and sum(map(len, want.values())) > 20
    for k, t in enumerate(texts):
        assert list(got[k]["dropped_lines"]) == want[t], t
        assert got[k]["text"] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[t])


def test_a_task_that_forgets_says_the_same(spark, monkeypatch):
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted((r["doc_id"], list(r["dropped_lines"])) for r in L.drop_recurring_lines(df).collect())
    monkeypatch.setattr(L, "_SEEN_TEXTS", 3)
    assert sorted((r["doc_id"], list(r["dropped_lines"])) for r in L.drop_recurring_lines(df).collect()) == whole
