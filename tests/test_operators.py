import datetime
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.functions import text, vectors
from brindle.model import NO_CONTEXT, SearchRequest
from brindle.operators import answer, chunk, embed, evaluate, ingest, ocr, search, versions
from brindle.operators.rerank import OverlapReranker
from brindle.operators.retriever import Retriever
from brindle.plans.store import HEAD, SchemaError, Store
from brindle.sources import files, loaders
from brindle.streaming import folder


def test_chunker_invariants():
    prose = "First one. Second one! Third?\n\n" * 20 + "w " * 200 + "x" * 95
    for size, overlap in [(10, 0), (50, 10), (200, 64)]:
        pieces = chunk.Chunker(size, overlap).split(prose)
        assert pieces and all(len(p.text) <= size and prose[p.start : p.end] == p.text for p in pieces)
        joined = {i for p in pieces for i in range(p.start, p.end)}
        assert all(c.isspace() for i, c in enumerate(prose) if i not in joined)
    words = " ".join(f"w{i}" for i in range(60))
    pieces = chunk.Chunker(40, 12).split(words)
    assert all(a.end > b.start for a, b in zip(pieces, pieces[1:]))
    assert [len(p.text) for p in chunk.Chunker(10, 0).split("x" * 35)] == [10, 10, 10, 5]
    marked = "# A\n" + "text " * 12 + "\n## B\n" + "more " * 12 + "\n## C\n" + "last " * 12
    assert [p.text.split("\n")[0] for p in chunk.Chunker(80, 0, markdown=True).split(marked)] == ["# A", "## B", "## C"]
    assert chunk.Chunker().split(" \n ") == chunk.Chunker().split(None) == []
    for wrong in [(0, 0), (10, 10), (10, -1)]:
        with pytest.raises(ValueError):
            chunk.Chunker(*wrong)


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = ""
    for style, t in paragraphs:
        if style == "table":
            body += "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in t) + "</w:tr></w:tbl>"
        else:
            body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></p>')
    return out.getvalue()


def test_loaders():
    assert loaders.load("a.TXT", "﻿hé".encode()).sections[0].text == "hé"
    assert loaders.decode(b"\x93x\x94") == "“x”" and loaders.decode(b"\x81") == "\x81"
    assert loaders.load("a.csv", b"name,age\nAnn,3\nBob,\n,\n").sections[0].text == "name: Ann | age: 3\nname: Bob"
    assert loaders.load("a.json", b'{"b": [1], "a": "\xc3\xa9"}').sections[0].text == '{\n  "b": [\n    1\n  ],\n  "a": "é"\n}'
    page = loaders.load("a.html", b"<html><head><title> T </title><script>x</script></head><body><nav>n</nav><h2>Head <b>two</b></h2><p>One<br>two</p></body></html>")
    assert page.metadata == {"title": "T"} and page.structured
    assert "## Head two" in page.sections[0].text and "n\n" not in page.sections[0].text and "x" not in page.sections[0].text and "One\ntwo" in page.sections[0].text
    word = loaders.load("a.docx", docx([("Heading2", "Head"), ("Normal", "Body"), ("table", ["a", " b "]), ("Title", "Top"), ("Normal", " ")]))
    assert word.metadata == {"title": "T"} and word.sections[0].text == "\n## Head\n\nBody\n\na | b\n\n\n# Top\n"
    for name in ("a.xyz", "plain"):
        with pytest.raises(loaders.UnsupportedFileType):
            loaders.load(name, b"")
    with pytest.raises(ValueError):
        loaders.load("a.json", b"{")


def test_ocr(spark):
    boxes = [(0, 10, 50, "b"), (1, 11, 0, "a"), (12, 22, 0, "c"), (40, 50, 0, "d")]
    assert ocr.layout(boxes) == "a b\nc\n\nd" and ocr.layout([]) == ""
    df = spark.createDataFrame([("a" * 19,), ("é1" * 10,), (None,)], "t string")
    assert [r[0] for r in df.select(ocr.needs_ocr(F.col("t"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(ocr.needs_ocr(F.col("t"), "force")).collect()] == [True] * 3
    with pytest.raises(ValueError):
        Settings(ocr_mode="sometimes")


def test_text():
    assert [text.Porter.stem(w) for w in ["caresses", "ponies", "hopping", "relational", "motoring", "happy", "probate", "controlling", "adoption"]] == ["caress", "poni", "hop", "relat", "motor", "happi", "probat", "control", "adopt"]
    assert text.english("The XJ-4471 runs") == ["xj-4471", "xj", "4471", "run"] and text.english("of the and") == [] == text.english(None)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.normalised(F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0.5**0.5) and got[1][0] is None and got[1][1] == [1.0, 0.0]
    items = spark.createDataFrame([(3, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [-1.0, 0.0])], "id int, embedding array<float>")
    assert [r.id for r in search.vector_topk(items, [1.0, 0.0], 4).collect()] == [1, 2, 4, 3]


def test_fusion(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1)], "query_id string, id string, rank int")
    assert {r.id: r.rrf_score for r in search.rrf(ranks, ["query_id", "id"]).collect()} == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 61 + 1 / 62)}
    cand = spark.createDataFrame([("q", "a", 1, 0.2), ("q", "b", 2, 0.5), ("q", "c", 3, 0.9)], "query_id string, id string, fused_rank int, vector_score double")
    assert [(r.id, r["rank"]) for r in search.cut(cand, 2, 0.5).collect()] == [("b", 1)]


@pytest.mark.parametrize("odd", [False, True])
def test_batch_of_vectors_equals_join(spark, monkeypatch, odd):
    """Products and join agree on every item, with ties, vectors that are null, zero, short or hold NaN, and few items."""
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(300)] + [(400, None), (401, [0.0] * 4), (402, [1.0]), (403, [1.0, None, 0.0, 0.0])]
    rows += [(404, [float("nan")] * 4)] if odd else []
    items = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 2.0, 0.0]), ("b", [1.0, 1.0, 1.0, 1.0]), ("z", [0.0] * 4)], "query_id string, query_vector array<float>")
    monkeypatch.setattr(search, "STRIP", 16)
    cases = [(items, 7), (items, 303), (items.filter("id > 290"), 20), (items.limit(0), 3)]
    found = [sorted(map(str, search.batch_vector_topk(df, asked, k).collect())) for df, k in cases]
    monkeypatch.setattr(search, "MOST_QUERIES", 0)
    assert found == [sorted(map(str, search.batch_vector_topk(df, asked, k).collect())) for df, k in cases]


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb")
    store = Store(spark, f"file://{path}/store")
    made = ingest.Ingestor(store, settings=Settings(chunk_size=200, chunk_overlap=20))
    rows = [
        ("flu.md", "# Flu clinics\n\nFlu clinics are open on Monday. Part XJ-4471 is in stock.", '{"department": "health", "year": 2024}', None, False),
        ("tax.txt", "Income tax forms are due in April. " * 12, '{"department": "finance", "year": 2020}', None, False),
        ("copy.txt", "Income tax forms are due in April. " * 12, None, None, False),
        ("bad.xyz", "x", None, None, False),
        ("empty.txt", "  ", None, None, False),
        ("meta.txt", "something", '{"page": 1}', None, False),
    ]
    schema = "filename string, content binary, metadata string, doc_key string, replace boolean"
    result = made.ingest(spark.createDataFrame([(n, t.encode(), *x) for n, t, *x in rows], schema))
    return store, made, {r.filename: r for r in result.collect()}, schema


def test_ingest_statuses(kb):
    _, _, got, _ = kb
    by = {n: r.status for n, r in got.items()}
    assert by["flu.md"] == "ingested" and {by["tax.txt"], by["copy.txt"]} == {"ingested", "duplicate"}
    assert [by[n] for n in ("bad.xyz", "empty.txt", "meta.txt")] == ["error"] * 3
    assert "unsupported" in got["bad.xyz"].error and "no extractable" in got["empty.txt"].error and "reserved" in got["meta.txt"].error


def test_search(spark, kb):
    store, made, _, _ = kb
    find = Retriever(store.read("documents"), store.read("chunks"), made.embedder, OverlapReranker())
    got = find.search(SearchRequest("where is XJ-4471", min_score=0.0))
    assert got.status == "ok" and got.reranked and got.results[0]["filename"] == "flu.md" and got.context.startswith("[1] flu.md\n")
    assert json.loads(store.read("chunks").filter("document_id = '%s'" % got.results[0]["document_id"]).first().metadata)["page"] is None
    plain = find.search(SearchRequest("income tax", filters={"department": "health"}, rerank=False, hybrid=False))
    assert {r["filename"] for r in plain.results} <= {"flu.md"} and not plain.reranked
    none = find.search(SearchRequest("income tax", filters={"year": {"$gt": 2030}}))
    assert none.status == "no_relevant_context" and none.message == NO_CONTEXT and answer.generate_answer(none) == NO_CONTEXT

    class Broken:
        enabled = True

        def score(self, query, texts):
            raise TimeoutError("late")

    broken = Retriever(store.read("documents"), store.read("chunks"), made.embedder, Broken()).search(SearchRequest("income tax"))
    assert not broken.reranked and "TimeoutError" in broken.warnings[0] and broken.results
    assert find.invoke("flu clinics", top_k=1, min_score=0.0)[0]["metadata"]["citation"]["label"] == "[1]"
    with pytest.raises(TypeError):
        find.invoke("x", depth=3)
    assert "[1]" in answer.build_chain(lambda q: find.search(SearchRequest(q, min_score=0.0)))("flu clinics")["answer"]


def test_versions_in_store(spark, kb):
    store, made, _, schema = kb
    put = lambda name, body, key=None, replace=False: made.ingest(spark.createDataFrame([(name, body.encode(), None, key, replace)], schema)).first()
    first, second = put("v1.txt", "version one", "k"), put("v2.txt", "version two", "k")
    assert (first.version, second.version, second.superseded_id) == (1, 2, first.document_id)
    assert put("again.txt", "version one", "k").status == "duplicate"
    listed = versions.document_versions(store.read("documents"), "k").collect()
    assert [(r.version, r.is_current) for r in listed] == [(2, True), (1, False)]
    left = versions.delete_versions(store.read("documents"), spark.createDataFrame([(second.document_id,)], "id string"))
    store.write(left.cache(), versions.cascade(store.read("chunks"), left).cache())
    assert [(r.version, r.is_current, r.superseded_at) for r in versions.find(store.read("documents"), doc_key="k").collect()] == [(1, True, None)]
    assert put("v3.txt", "version three", "k").version == 2
    third = put("v4.txt", "version four", "k", True)
    assert third.version == 1 and store.read("documents").filter("doc_key = 'k'").count() == 1
    assert store.read("documents").groupBy("doc_key").agg(F.sum(F.col("is_current").cast("int")).alias("n")).filter("n > 1").count() == 0
    store.check(64)
    with pytest.raises(SchemaError):
        store.check(32)
    store.migrate(1)
    assert "doc_key" not in store.read("documents").columns and store.migrate() == HEAD
    assert store.read("documents").filter("is_current").count() > 0


def test_validity(spark):
    day = datetime.date(2024, 5, 1)
    rows = [(1, True, None, None), (2, True, day, day), (3, True, datetime.date(2024, 5, 2), None), (4, True, None, datetime.date(2024, 4, 30)), (5, False, None, None)]
    df = spark.createDataFrame(rows, "id int, is_current boolean, valid_from date, valid_until date")
    assert {r.id for r in df.filter(search.live(F.lit(day))).collect()} == {1, 2}


def test_cases_and_reports(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('# note\n\n{"question": "q", "expected": [{"contains": "X"}], "reference": "r"}\n{"id": "n", "question": "none"}\n')
    cases = files.read_cases(spark, str(path))
    assert [r.id for r in cases.orderBy("seq").collect()] == ["3", "n"]
    for bad in ["{", "[]", '{"question": ""}', '{"question": "q", "expected": [{"x": 1}]}', '{"question": "q", "reference": " "}']:
        path.write_text(bad)
        with pytest.raises(ValueError, match=r"q.jsonl:1"):
            files.read_cases(spark, str(path))
    chosen, skipped = evaluate.select_cases(cases, only=["3", "n"])
    assert skipped == 1 and chosen.count() == 1
    results = spark.createDataFrame([("3", 1, "f", None, "no"), ("3", 2, "f", None, "an x here")], "id string, rank int, filename string, page int, text string")
    statuses = spark.createDataFrame([("3", "ok", True, 1.0), ("n", "ok", True, 1.0)], "id string, status string, reranked boolean, took_ms double")
    scored = evaluate.score_cases(cases, results, statuses)
    summary = evaluate.summarize(scored).first()
    assert (summary.mrr, summary.hit_at_1, summary.correct_refusal) == (0.5, 0.0, 0.0)
    assert {(r.id, r.kind) for r in evaluate.failures(scored).collect()} == {("n", "NO-REFUSE")}


def test_judged_run(tmp_path):
    class Response:
        def __init__(self, texts):
            self.results, self.status, self.reranked = [{"text": t} for t in texts], "ok" if texts else "no_relevant_context", True

    calls = []

    def find(case):
        calls.append(case["id"])
        if case["id"] == "down":
            raise ConnectionError("no network")
        return Response(["t"] if case["id"] == "a" else [])

    cases = [{"id": i, "question": "q", "reference": "r"} for i in ("a", "b", "down")] + [{"id": "skip", "question": "q"}]
    metrics = ["contextual_recall", "faithfulness"]
    out = evaluate.run_judged(find, cases, lambda *x: 0.6996, metrics, answer=lambda r: "said", backoff=(0, 0))
    by = {c["id"]: c for c in out}
    assert by["a"]["scores"]["contextual_recall"] == {"score": 0.7, "passed": False, "reason": None, "error": None}
    assert by["b"]["scores"]["faithfulness"]["passed"] and by["down"]["status"] == "pipeline_error" and calls.count("down") == 3
    evaluate.write_report(str(tmp_path / "r.json"), out, False)
    calls.clear()
    evaluate.run_judged(find, cases, lambda *x: 1.0, metrics, answer=lambda r: "said", backoff=(), done=evaluate.read_report(str(tmp_path / "r.json")))
    assert calls == ["down"]
    with pytest.raises(ValueError):
        evaluate.run_judged(find, cases, lambda *x: 1.0, ["correctness"])


def test_embedder():
    made = embed.HashingEmbedder(16)
    assert embed.embed_now(["a b", "a b"], made)[0] == embed.embed_now(["b a"], made)[0]

    class Wrong:
        dim = 3

        def embed(self, texts):
            return [[1.0]] * len(texts)

    with pytest.raises(embed.EmbeddingError):
        embed.embed_now(["x"], Wrong())


def test_settings_and_metadata(monkeypatch):
    monkeypatch.setenv("BRINDLE_CHUNK_SIZE", "99")
    assert Settings.from_env(chunk_overlap=3).chunk_size == 99
    with pytest.raises(ValueError):
        Settings(schema="Bad-Name")
    for bad in ([1], {"page": 1}, {"x": object()}):
        with pytest.raises(ValueError):
            ingest.validate_metadata(bad)
    with pytest.raises(ValueError):
        SearchRequest("q", top_k=0)


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.txt").write_text("some text to find")
    (tmp_path / "in" / "b.bin").write_text("no")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        folder.watch(spark, f"file://{tmp_path}/in", ingest.Ingestor(store), f"file://{tmp_path}/cp", once=True).awaitTermination()
    assert [r.filename for r in store.read("documents").collect()] == ["a.txt"]
    assert [r.filename for r in files.read_files(spark, f"file://{tmp_path}/in").collect()] == ["a.txt"]
