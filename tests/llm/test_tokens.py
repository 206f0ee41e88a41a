import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe, packing, token_counts, token_files
from brindle.llm.queries import vocabulary

VOCAB = vocabulary()
ODD = ["'", "s", "t", "re", "ve", "ll", "'d", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "1", "²", "Ⅷ", ",", "　", "\x85", "\x1c", "​", "中", "😀", "<|endoftext|>", "<|endof", "\x00", "_", "ª"]


def expected(texts):
    return [x.ids for x in bpe.library(VOCAB).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n=3000, seed=3):
    r = random.Random(seed)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]
    texts += ["".join(chr(r.choice([r.randint(32, 0x2FFF), r.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(n)]
    return [*texts, "", " ", None, "x" * 3000, "ab " * 2000]


def test_ids_and_counts_equal_the_library():
    texts = odd_texts()
    want = expected(texts)
    got = [ids[ends[i] : ends[i + 1]].tolist() for _, ids, ends in bpe.encoder(VOCAB).encode(pa.array(texts)) for i in range(len(ends) - 1)]
    assert got == want
    assert bpe.merge_counter(VOCAB).counts(pa.array(texts)).tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=700), st.integers(1, 300))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    sizes = np.array([min(block, len(ids) - i) for i in range(0, len(ids), block)], np.int64)
    words, per_block = token_files.encode(ids, sizes)
    assert token_files.decode(words, sizes, per_block).tolist() == ids.tolist()


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts(150)
    rows = [(i * 3 % 1009, t, "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", "x", 1), (5000, "word " * 5000, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long").repartition(5)


def test_count_tokens(spark, docs):
    rows = docs.collect()
    got = sorted(map(tuple, token_counts.count_tokens(docs, VOCAB).collect()), key=str)
    n = [len(x) for x in expected([r.text for r in rows])]
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), k, k > 512) for r, k in zip(rows, n)), key=str)
    assert token_counts.count_tokens(docs.limit(0), VOCAB).count() == 0


def test_token_files(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    want, at = [], 0
    for r, ids in zip(rows, expected([r.text for r in rows])):
        ids = [*ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.encode_and_read(docs, VOCAB).collect()]
    key = lambda r: (r[1],)
    assert [x[:3] for x in sorted(got, key=key)] == [x[:3] for x in want]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_files.encode_and_read(docs.limit(0), VOCAB).count() == 0


def check_pieces(rows, pieces, size=1024, end=0):
    streams = {}
    for r, ids in zip(rows, expected([r.text for r in rows])):
        streams.setdefault(r.doc_id, []).append([*ids, end])
    by_sequence, covered = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered.setdefault(p.doc_id, []).append(p)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert covered.keys() == streams.keys()
    for doc, own in covered.items():
        if len(streams[doc]) > 1:
            assert sum(p.length for p in own) == sum(map(len, streams[doc]))
            continue
        (ids,), at = streams[doc], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    return by_sequence


def test_packing(spark, docs):
    pieces = packing.pack(docs, VOCAB).collect()
    sequences = check_pieces(docs.collect(), pieces)
    short = [s for s in (sum(n for _, n in x) for x in sequences.values()) if s < 1024]
    assert len(short) <= 1
    assert packing.pack(docs.limit(0), VOCAB).count() == 0


def test_packer_is_bounded():
    packer, r = packing.Packer(64, 4, 0), random.Random(1)
    for d in range(500):
        n = r.randint(1, 150)
        packer.add(d, 0, np.arange(n, dtype=np.int32), n)
        assert len(packer.windows) <= 4
    rest = packer.merge()
    assert sum(len(x[2]) for x in rest) < 64


def thue_morse(n):
    """A word over a and b, and the one with both exchanged: equal under every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    from brindle.llm import minhash

    texts = [*thue_morse(1024), *thue_morse(4096), *(f"x {w} y z" for w in thue_morse(1024))]
    want = expected(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert [r.n_tokens for r in token_counts.count_tokens(docs, VOCAB).orderBy("doc_id").collect()] == [len(x) for x in want]
    check_pieces(docs.collect(), packing.pack(docs, VOCAB).collect())
    sums = [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want]
    assert [r.ids_crc32 for r in token_files.encode_and_read(docs, VOCAB).orderBy("doc_id").collect()] == sums
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == set(range(len(texts)))


def test_several_added_tokens(tmp_path):
    import json

    with open(VOCAB, encoding="utf-8") as f:
        spec = json.load(f)
    known = spec["added_tokens"]
    spec["added_tokens"] = [*known, *({**known[0], "id": 60000 + i, "content": c, "special": i > 0} for i, c in enumerate(["<|a|>", "<|a|>b", "中中"]))]
    path = str(tmp_path / "more.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["x<|a|>b y", "<|a|><|a|>", "中中中 <|endoftext|>", "plain", ""]
    want = [x.ids for x in bpe.library(path).encode_batch(texts, add_special_tokens=False)]
    got = [ids[ends[i] : ends[i + 1]].tolist() for _, ids, ends in bpe.Encoder(path).encode(pa.array(texts)) for i in range(len(ends) - 1)]
    assert got == want and bpe.MergeCounter(path).counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_queries_on_their_whole_table(spark):
    from brindle.llm.queries import QUERIES
    from brindle.plans.tables import table

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").orderBy("doc_id").collect()
    ids = expected([r.text for r in docs])
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    assert counts == {r.doc_id: (len((r.text or "").encode()), len(x), len(x) > 512) for r, x in zip(docs, ids)}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, sf).collect()}
    at = 0
    for r, x in zip(docs, ids):
        assert got[r.doc_id] == (at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        at += len(x) + 1
    pieces = QUERIES["op1_packing"](spark, sf).collect()
    check_pieces(docs, pieces)
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)

