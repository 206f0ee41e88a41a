import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from brindle.llm import suffix_dedup
from brindle.llm.queries import QUERIES
from brindle.plans.tables import table


def brute(docs, length):
    """(doc, n_bytes, n_removed, n_spans, sha256) of every row."""
    first = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            if d is not None:
                w = data[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if d is not None and first[data[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        out.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    alphabet = "abé \n\x00" if seed % 2 else "abcdefghijklmnopqrstuvwxyz éü"
    passages = ["".join(r.choice(alphabet) for _ in range(r.choice([30, 49, 50, 51, 80, 200]))) for _ in range(8)] + ["a" * 120, "ab" * 70]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 300, passages[5], passages[5]]
    while len(texts) < 60:
        texts.append("".join(r.choice(passages) if r.random() < 0.4 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 7))))
    return [(i * 17 % 101 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 40)])
def test_digest_equals_brute_force(spark, seed, length, monkeypatch):
    docs = corpus(seed)
    docs += [docs[8], (docs[9][0], "other text " + (docs[10][1] or "")), (None, docs[12][1])]
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, starts string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.digest(df, length).collect()), key=str)
    assert got == brute(docs, length)
    assert suffix_dedup.digest(df.limit(0)).count() == 0


def test_small_blocks_and_indexes(monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    monkeypatch.setattr(suffix_dedup, "INDEX", 300)
    rows = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["c0", "c1"])
    blocks = pa.Table.from_batches(suffix_dedup._pack(50)([rows])).to_pylist()
    assert len(blocks) > 3
    twins, first = {}, {}
    for r in pa.Table.from_batches(suffix_dedup._digests([suffix_dedup._rows([(b["block"], b["nth"], b["digests"]) for b in blocks], "block long, nth binary, digests binary")])).to_pylist():
        first[r["digest"]] = min(first.get(r["digest"], r["doc"]), r["doc"])
        twins.setdefault(r["block"], []).append(r)
    twins = {b: [r["nth"] for r in own if first[r["digest"]] < r["doc"]] for b, own in twins.items()}
    n_parts = 3

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[str(i) for i in range(len(columns))])

    def by_part(made):
        table = pa.Table.from_batches(made)
        return [table.filter(pc.equal(table["part"], p)).to_batches() for p in range(n_parts)]

    number, data, alike = [b["block"] for b in blocks], [b["data"] for b in blocks], [twins.get(b["block"]) for b in blocks]
    met = [r for own in by_part(suffix_dedup._send(n_parts, 50)([batch(number, data, alike)])) for r in pa.Table.from_batches(suffix_dedup._meet(own)).to_pylist()]
    replies = [[r for r in met if r["block"] == n] for n in number]
    made = list(suffix_dedup._snip(n_parts, 50)([batch(number, data, alike, replies)]))
    held = {r["block"]: r["message"] for r in pa.Table.from_batches(made).to_pylist() if r["part"] == -1}
    marks = {}
    for own in by_part(made):
        for out in suffix_dedup._match(50)(own):
            for r in out.to_pylist():
                marks.setdefault(r["block"], []).append(r)
    got = []
    for b, alike in zip(blocks, alike):
        result = suffix_dedup._Result(b["data"], alike, held.get(b["block"]), marks.get(b["block"]))
        kept, ends = result.kept()
        for i, d in enumerate(result.batch.column(0).to_pylist()):
            n = int(result.offsets[i + 1] - result.offsets[i])
            own = kept[ends[i] : ends[i + 1]].tobytes()
            got.append((d, n, n - len(own), int(result.n_spans[i]), hashlib.sha256(own).hexdigest()))
    assert sorted(got, key=str) == brute(docs, 50)


def test_packed_arrays():
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([-3, 1 << 40]), np.array([1, 255], np.uint8), np.array([1 << 63], np.uint64)]
    back = suffix_dedup.unpacked(suffix_dedup.packed(*arrays))
    assert [(x.dtype, x.tolist()) for x in back] == [(x.dtype, x.tolist()) for x in arrays]
    assert suffix_dedup.narrow(np.array([70000])).dtype == np.uint32


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_run_index_streams_matching_statistics(seed):
    """Texts that are in the index and others, some with bytes that it lacks: lengths, rows and least owners as found by search."""
    r = random.Random(seed)
    strings = ["".join(r.choice("ab" if seed < 3 else "abcdefgh") for _ in range(r.randint(1, 40))) for _ in range(60)]
    if seed == 2:
        strings = [r.choice(strings[:6]) + r.choice("ab") for _ in range(60)]
    owner = np.array([r.randint(0, 30) for _ in strings])
    length = 6
    index = suffix_dedup.RunIndex(np.frombuffer("".join(strings).encode(), np.uint8), np.array([len(s) for s in strings]), owner, length)
    assert len(index.heads) < sum(map(len, strings)) + len(strings)
    rows = sorted([(s[i:] + "\0", k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)])
    texts = strings + ["".join(r.choice("abz") for _ in range(r.randint(0, 50))) for _ in range(40)]
    lengths, row = index.stream(np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts]))
    least = index.least_owner(row)
    at = 0
    for t in texts:
        for i in range(len(t)):
            want = next((n for n in range(min(length, len(t) - i), 0, -1) if any(t[i : i + n] in s for s in strings)), 0)
            assert lengths[at] == want
            assert rows[row[at]][0].startswith(t[i : i + want])
            if want == length:
                assert least[at] == min(o for o, s in zip(owner, strings) if t[i : i + length] in s)
            at += 1
    empty = suffix_dedup.RunIndex(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), length)
    assert empty.stream(np.array([97], np.uint8), np.array([1]))[0].tolist() == [0]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()), key=str) == brute(docs, 50)


def test_remove_keeps_characters_whole(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, shared + " one", 3), (2, "x" + shared + "y", 4), (3, shared, 5), (4, None, 6), (5, "", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.remove(df).collect()}
    assert got == {1: (shared + " one", 3), 2: ("xy", 4), 4: (None, 6), 5: ("", 7)}
