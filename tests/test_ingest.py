"""Batches of files through the whole path of ingestion, and the store beneath it."""

import datetime
import types

import pytest
from pyspark.sql import functions as F

from brindle.app import KnowledgeBase
from brindle.config import Settings
from brindle.model import SearchRequest
from brindle.operators import embed, ingest
from brindle.plans import store as stores
from brindle.plans.store import ConcurrentWrite, Store
from brindle.sources import files

SMALL = Settings(chunk_size=40, chunk_overlap=0)


def batch(spark, rows):
    return spark.createDataFrame([(f"{i:03}", n, t.encode()) for i, (n, t) in enumerate(rows)], "path string, filename string, content binary")


def ingested(spark, store, rows, **given):
    made = ingest.Ingestor(store, settings=SMALL, **given).ingest(batch(spark, rows)).collect()
    return [(r.filename, r.status, r.version, r.num_chunks, r.document_id, r.error) for r in sorted(made, key=lambda r: r.path)]


def texts(store):
    """Chunks of each stored document, in order."""
    out = {}
    for r in store.read("chunks").orderBy("document_id", "chunk_index").collect():
        out.setdefault(r.document_id, []).append((r.chunk_index, r.content))
    return out


def test_equal_names_equal_bytes_and_both(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two = "first text " * 8, "second text"
    got = ingested(spark, store, [("readme.md", one), ("readme.md", two), ("x.txt", "same"), ("x.txt", "same"), ("y.txt", "same"), ("z.bin", "same too"), ("z.txt", "same too"), ("e.txt", " "), ("e.txt", "\n")])
    assert [g[:3] for g in got] == [("readme.md", "ingested", 1), ("readme.md", "ingested", 2), ("x.txt", "ingested", 1), ("x.txt", "duplicate", None), ("y.txt", "duplicate", None), ("z.bin", "error", None), ("z.txt", "ingested", 1), ("e.txt", "error", None), ("e.txt", "error", None)]
    assert len({g[4] for g in got if g[1] == "ingested"}) == 4 and got[3][4] == got[4][4] == got[2][4]
    held = texts(store)
    assert "".join(c for _, c in held[got[0][4]]).replace(" ", "") == one.replace(" ", "") and held[got[1][4]] == [(0, two)] and held[got[2][4]] == [(0, "same")]
    assert all([i for i, _ in own] == list(range(len(own))) for own in held.values())
    documents = {r.id: r for r in store.read("documents").collect()}
    assert len(documents) == 4 and [documents[g[4]].num_chunks for g in got[:2]] == [g[3] for g in got[:2]] == [len(held[g[4]]) for g in got[:2]]
    assert [documents[g[4]].is_current for g in got[:2]] == [False, True]
    again = ingested(spark, store, [("other.md", one), ("readme.md", "third")])
    assert [g[1:3] for g in again] == [("duplicate", None), ("ingested", 3)] and again[0][4] == got[0][4]


def test_replaced_within_a_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    df = batch(spark, [("a.txt", "old"), ("a.txt", "new"), ("b.txt", "plain")]).withColumn("replace", F.col("path") == "001")
    got = [(r.filename, r.status, r.version) for r in sorted(ingest.Ingestor(store, settings=SMALL).ingest(df).collect(), key=lambda r: r.path)]
    assert got == [("a.txt", "ingested", None), ("a.txt", "ingested", 1), ("b.txt", "ingested", 1)]
    assert sorted(c for own in texts(store).values() for _, c in own) == ["new", "plain"]


def test_folder_with_equal_names(spark, tmp_path):
    for d in "ab":
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "readme.md").write_text(f"# Of {d}\n\ntext of folder {d}")
    kb = KnowledgeBase(spark, Settings(base_path=f"file://{tmp_path}/kb"))
    got = kb.ingest_path(f"file://{tmp_path}/in")
    assert [(r["status"], r["version"], r["num_chunks"]) for r in got] == [("ingested", 1, 1), ("ingested", 2, 1)]
    assert "of folder b" in kb.search(SearchRequest("folder text", min_score=0.0)).results[0]["text"]
    with pytest.raises(ValueError):
        kb.ingest_path(f"file://{tmp_path}/in", doc_key="k")
    one = kb.ingest_path(f"file://{tmp_path}/in/a/readme.md", replace=True, doc_key="own", valid_from=datetime.date(2024, 1, 1))
    assert one[0]["status"] == "duplicate"


def test_failing_embedder_is_an_error_of_its_file(spark, tmp_path):
    class Picky(embed.HashingEmbedder):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise TimeoutError("refused")
            return super().embed(texts)

    store = Store(spark, f"file://{tmp_path}/s")
    got = ingested(spark, store, [("a.txt", "good"), ("b.txt", "poison"), ("c.txt", "fine")], embedder=Picky(64))
    assert [g[1] for g in got] == ["ingested", "error", "ingested"] and "refused" in got[1][5]
    assert sorted(c for own in texts(store).values() for _, c in own) == ["fine", "good"]


def test_a_crash_leaves_the_last_commit(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    ingested(spark, store, [("a.txt", "one")])
    before = store.last

    def dies(self, n, commit):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            ingested(spark, store, [("b.txt", "two")])
    assert store.last == before and [r.filename for r in store.read("documents").collect()] == ["a.txt"]
    assert [g[1] for g in ingested(spark, store, [("b.txt", "two")])] == ["ingested"] and store.read("chunks").count() == 2


def test_only_the_first_of_two_writers_wins(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    ingested(spark, store, [("a.txt", "one")])
    base, documents = store.last, store.read("documents")
    ingested(spark, store, [("b.txt", "two")])
    with pytest.raises(ConcurrentWrite):
        store.write(documents, base=base)
    assert store.read("documents").count() == 2


def test_a_writer_that_was_late_tries_again(spark, tmp_path, monkeypatch):
    """Another process stores one of two files while this one is at work."""
    store, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    ingested(spark, store, [("first.txt", "one")])
    publish, late = Store._publish, []

    def slow(self, n, commit):
        if self is store and not late:
            late.append(n)
            ingested(spark, other, [("a.txt", "same"), ("k.txt", "theirs")])
        publish(self, n, commit)

    monkeypatch.setattr(Store, "_publish", slow)
    got = ingested(spark, store, [("b.txt", "same"), ("k.txt", "ours")])
    assert late and [g[:3] for g in got] == [("b.txt", "duplicate", None), ("k.txt", "ingested", 2)]
    assert sorted(r.filename for r in store.read("documents").collect()) == ["a.txt", "first.txt", "k.txt", "k.txt"]
    assert store.read("chunks").count() == 4 and len(list((tmp_path / "s" / "documents").iterdir())) == 3


def test_appended_chunks_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST", 2)
    monkeypatch.setattr(stores, "KEPT", 2)
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(5):
        ingested(spark, store, [(f"{i}.txt", f"text {i}")])
    assert sorted(c for own in texts(store).values() for _, c in own) == [f"text {i}" for i in range(5)]
    assert len(store._commit(store.last)["chunks"]) <= 2 and len(list((tmp_path / "s" / "commits").glob("[0-9]*"))) <= 4
    left = store.read("documents").filter("filename <> '3.txt'")
    store.write(left)
    assert store.read("chunks").count() == 4


def test_migrations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.migrate() == 2
    ingested(spark, store, [("a.txt", "one")])
    assert store.migrate("-1") == 1 and "doc_key" not in store.read("documents").columns
    assert store.migrate("head") == 2 and store.read("documents").first().doc_key == "a.txt"
    assert store.migrate("base") == 0 == store.revision and store.read("chunks").count() == 0
    assert store.migrate("+2") == 2 and store.read("documents").count() == 0
    for wrong in ("3", "-3", "x"):
        with pytest.raises(ValueError):
            store.migrate(wrong)


def test_pages_without_text_are_read_by_ocr(spark, monkeypatch):
    """With stand-ins for the reader, the renderer and the engine, as none of them is here."""

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    class Reader:
        metadata = types.SimpleNamespace(title="Scan")

        def __init__(self, stream):
            self.pages = [Page(t or None) for t in stream.read().decode().split("|")]

    class Image:
        def __init__(self, i):
            self.i = i

        def render(self, scale):
            return self

        def to_pil(self):
            return self

        def convert(self, mode):
            return [[self.i]]

    class Document(list):
        def __init__(self, data):
            super().__init__(Image(i) for i in range(9))

        def close(self):
            pass

    class Engine:
        def __call__(self, image):
            box = lambda top, left: [[left, top], [left + 5, top], [left + 5, top + 10], [left, top + 10]]
            return types.SimpleNamespace(boxes=[box(0, 9), box(0, 1), box(0, 5)], txts=["page", "of", "low"], scores=[0.9, 0.9, 0.1])

    import sys

    from brindle.operators import ocr
    from brindle.sources.loaders import load

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    monkeypatch.setitem(sys.modules, "pypdfium2", types.SimpleNamespace(PdfDocument=Document))
    monkeypatch.setitem(sys.modules, "rapidocr", types.SimpleNamespace(RapidOCR=Engine))
    ocr._engine.cache_clear()
    data = b"a page with a text layer, long enough||short"
    got = load("s.pdf", data, ocr.PageOcr(Settings()))
    assert [(s.page, s.text, s.ocr) for s in got.sections] == [(1, "a page with a text layer, long enough", False), (2, "of page", True), (3, "of page", True)] and got.metadata == {"title": "Scan"}
    assert [s.ocr for s in load("s.pdf", data, ocr.PageOcr(Settings(ocr_mode="force"))).sections] == [True] * 3
    assert [s.text for s in load("s.pdf", data, ocr.PageOcr(Settings(ocr_mode="off"))).sections][1:] == ["", "short"]
    monkeypatch.delitem(sys.modules, "rapidocr")
    monkeypatch.setitem(sys.modules, "rapidocr", None)
    ocr._engine.cache_clear()
    with pytest.raises(ocr.OcrUnavailable):
        load("s.pdf", data, ocr.PageOcr(Settings()))
    monkeypatch.setitem(sys.modules, "pytesseract", types.SimpleNamespace(get_tesseract_version=lambda: 5, image_to_string=lambda image, lang: f" {lang} "))
    assert load("s.pdf", data, ocr.PageOcr(Settings(ocr_engine="tesseract"))).sections[1].text == "eng"
    ocr._engine.cache_clear()


def test_sections_by_key(spark):
    df = spark.createDataFrame([(1, "a.txt", b"x"), (2, "a.txt", b"y"), (3, "a.pdf", b"z")], "file long, filename string, content binary")
    got = {r.file: (r.text, r.error) for r in files.sections(df, "file").collect()}
    assert got["1"] == ("x", None) and got["2"] == ("y", None) and "pypdf" in got["3"][1]
