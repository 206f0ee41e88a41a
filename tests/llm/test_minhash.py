import random
import re

import pytest

from brindle.llm import minhash
from brindle.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, k):
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def corpus(seed, n=140):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Zwölf", "a,b"]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "one two", "x\x0by z", "x y z", "\x1f"]
    while len(texts) < n:
        words = list(r.choice(bases[:3] if r.random() < 0.5 else bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(r.choice([" ", "\n", "  "]).join(words).swapcase() if r.random() < 0.3 else " ".join(words))
    r.shuffle(texts)
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, n string").repartition(4)
    got = [tuple(r) for r in minhash.near_duplicates(df, shingle=4).collect()]
    assert len(got) == len(docs) and set(got) == brute(docs, 4)
    kept = minhash.deduplicate(df, shingle=4).collect()
    assert {r.doc_id for r in kept} == {d for d, _, _, k in got if k}


def test_edge_cases(spark):
    text = "a long enough text about nothing in particular " * 3
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text.upper()), (7, "tail " * 20000), (8, "tail " * 30000)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(5, 5), (5, 5), (7, 7), (8, 7), (9, 5)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 gone", "2 doc", "3 rep")
    assert minhash.deduplicate(clash).columns == clash.columns and minhash.deduplicate(clash).count() == 4


def test_chain_components(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(120)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 10])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(x) for x in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == brute(docs, 4) and len({c for _, _, c, _ in got}) > 5


def test_whole_table(spark):
    """The query on its table: every component as found by comparing all pairs whose sizes allow a link."""
    from brindle.llm.queries import QUERIES
    from brindle.plans.tables import table

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    sets = sorted(((len(s), d, s) for d, t in docs if (s := shingles(t, 4))), key=lambda x: x[:2])
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for k, (n, d, s) in enumerate(sets):
        for m, e, t in sets[k + 1 :]:
            if 100 * n < 80 * m:
                break
            if 100 * (both := len(s & t)) >= 80 * (n + m - both):
                links += 1
                a, b = sorted((find(d), find(e)))
                root[b] = a
    want = {(d, len(shingles(t, 4)), find(d), find(d) == d) for d, t in docs}
    assert links > 50 and {tuple(r) for r in QUERIES["op6_minhash"](spark, sf).collect()} == want


def test_recall_near_the_threshold(spark):
    """Pairs just above similarity 0.8, among them small sets: at least 0.99 of them are linked."""
    r = random.Random(11)
    docs, pairs = [], []
    for i in range(300):
        n = r.choice([10, 14, 23, 60, 200])
        words = [f"u{i}x{k}" for k in range(n + 3)]
        other = list(words)
        while True:
            trial = list(other)
            trial[r.choice([0, len(trial) - 1, r.randrange(len(trial))])] = f"v{i}x{r.random()}"
            a, b = shingles(" ".join(words), 4), shingles(" ".join(trial), 4)
            if 100 * len(a & b) < 80 * len(a | b):
                break
            other = trial
        if other != words:
            docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
            pairs.append(2 * i)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert len(pairs) > 100 and sum(got[p + 1] == p for p in pairs) / len(pairs) >= 0.99

