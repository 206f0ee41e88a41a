import numpy as np
import pytest

from brindle.app import KnowledgeBase
from brindle.config import Settings
from brindle.model import SearchRequest
from brindle.operators import index
from brindle.plans.tables import table
from brindle.queries import QUERIES


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    """Of the true ten nearest at least nine tenths are found, on vectors without clusters; scores are exact."""
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    got = {}
    for r in QUERIES["vector_index_topk"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.vector_score
    hits = total = 0
    for q, own in got.items():
        cosine = x @ (rows[q] / np.linalg.norm(rows[q]))
        best = set(ids[np.argsort(-cosine, kind="stable")[:10]].tolist())
        hits, total = hits + len(best & own.keys()), total + 10
        assert len(own) == 10 and all(abs(cosine[np.flatnonzero(ids == v)[0]] - s) < 1e-3 for v, s in own.items())
    assert total >= 50 and hits / total >= 0.9


def test_index_holds_every_row_and_reads_few_cells(spark, tmp_path):
    r = np.random.default_rng(2)
    centre = r.normal(size=(20, 8))
    rows = [(i, (centre[i % 20] + 0.05 * r.normal(size=8)).tolist()) for i in range(2000)] + [(5000, None), (5001, [0.0] * 8), (5002, [1.0]), (5003, [float("nan")] * 8)]
    items = spark.createDataFrame(rows, "id int, embedding array<float>")
    index.build(items, f"file://{tmp_path}/i", cells=20)
    assert spark.read.parquet(f"file://{tmp_path}/i/items").count() == len(rows)
    near = index.near_cells(spark, f"file://{tmp_path}/i", [centre[3].tolist()], 0.1)
    assert 0 < near.count() < 800 and "PartitionFilters: [cell" in near._jdf.queryExecution().toString()
    assert {x.id for x in near.collect()} >= {i for i in range(2000) if i % 20 == 3}
    index.build(items.limit(0), f"file://{tmp_path}/e")
    assert index.near_cells(spark, f"file://{tmp_path}/e", [[1.0]]).count() == 0


def test_application_uses_the_index_of_its_last_commit(spark, tmp_path):
    kb = KnowledgeBase(spark, Settings(base_path=f"file://{tmp_path}/kb"))
    kb.upload_all([{"filename": f"{i}.txt", "content": f"{w} are here".encode(), "metadata": {"k": i % 2}} for i, w in enumerate(["boats", "permits", "harbours", "taxes", "clinics", "roads"])])
    plain = lambda r: [(x["filename"], x["vector_score"]) for x in r.results]
    asked = [SearchRequest("permits here", hybrid=False, top_k=1, candidate_k=1), SearchRequest("permits", filters={"k": 1}, min_score=0.0)]
    before = [plain(kb.search(a)) for a in asked]
    kb.build_index()
    assert kb._retriever().index and [plain(kb.search(a)) for a in asked] == before
    kb.upload("new.txt", b"permits permits here")
    assert kb._retriever().index is None and plain(kb.search(asked[0]))[0][0] in ("new.txt", "1.txt")
