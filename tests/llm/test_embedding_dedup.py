import math

import numpy as np
import pytest

from brindle.llm import embedding_dedup
from brindle.llm.queries import QUERIES
from brindle.plans.tables import table


def brute(rows, cosine=0.95):
    """(id, links, component) of every row with distinct ids."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = {i: i for i in ids}
    for _ in ids:
        new = {i: min([label[i], *(label[ids[j]] for j in np.flatnonzero(near[k]))]) for k, i in enumerate(ids)}
        if new == label:
            break
        label = new
    links = dict(zip(ids, near.sum(1).tolist(), strict=True))
    return sorted((i, links.get(i, 0), label.get(i, i)) for i, _ in rows if i is not None)


@pytest.mark.parametrize("block", [8192, 100, 16])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 8))
    rows = [(int(i), (base[r.integers(30)] + r.normal(scale=r.choice([0, 0.02, 0.2]), size=8)).tolist()) for i in r.permutation(400)]
    rows += [(500, [0.0] * 8), (501, None), (502, [float("nan")] * 8), (503, [1.0] * 7 + [None]), (504, [float("inf")] + [0.0] * 7), (506, [-0.0] + [1.0] * 7), (507, [0.0] + [1.0] * 7)]
    df = spark.createDataFrame([(*x, 1) for x in [*rows, (None, rows[0][1])]], "vec_id long, embedding array<double>, weight int").repartition(3)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got if x.vec_id is not None) == brute(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in QUERIES["op4_embedding_dedup"](spark, sf).collect()) == brute(rows)


def test_every_length_takes_part(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (4, [3.0]), (5, [-1.0]), (6, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]
