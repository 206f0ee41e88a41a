"""Parsers, chunks, stems and the whole search against plain versions."""

import io
import json
import re
import zipfile
from html import unescape

import numpy as np
import pytest

from brindle.functions.text import Porter
from brindle.operators import chunk
from brindle.queries import QUERIES
from brindle.sources import loaders
from tests.test_operators import docx

SF = "/root/testdata/sf0.001"


def test_title_outside_head_is_text():
    got = loaders.load("a.html", b"<html><head><title>Page</title></head><body><svg><title>Chart</title></svg><p>after</p></body></html>")
    assert got.metadata == {"title": "Page"} and got.sections[0].text.split() == ["Chart", "after"]


def test_merged_cells_stand_at_each_place():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda text, inner="": f"<w:tc><w:tcPr>{inner}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [cell("wide", '<w:gridSpan w:val="2"/>') + cell("c"), cell("tall", '<w:vMerge w:val="restart"/>') + cell("y") + cell("z"), cell("", "<w:vMerge/>") + cell("q") + cell("r")]
    body = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert loaders.load("a.docx", out.getvalue()).sections[0].text.splitlines() == ["wide | wide | c", "tall | y | z", "tall | q | r", ""][:3]
    assert loaders.load("a.docx", docx([("Heading 2", "H"), ("table", ["a", "b"])])).sections[0].text == "\n## H\n\na | b\n"


def test_chunks_of_prose_lists_and_headings():
    one = chunk.Chunker(100, 10).split("Hello world.")
    assert [(c.text, c.start, c.end) for c in one] == [("Hello world.", 0, 12)]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(20))
    many = chunk.Chunker(200, 40).split(text)
    assert len(many) > 5 and all(len(c.text) <= 200 and text[c.start : c.end] == c.text for c in many)
    words = chunk.Chunker(50, 20).split(" ".join(f"w{i}" for i in range(200)))
    assert all(b.start < a.end for a, b in zip(words, words[1:]))
    marked = "# Title\nintro\n\n## A\n" + "alpha " * 10 + "\n\n## B\n" + "beta " * 10
    heads = [c.text for c in chunk.Chunker(80, 0, markdown=True).split(marked)]
    assert any(t.startswith("## A") for t in heads) and any(t.startswith("## B") for t in heads)


def test_chunks_by_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    length = chunk.tokenizer_length(path)
    text = "An unbelievably long-winded sentence about tokenisation, repeated. " * 30
    rows = chunk.chunk(spark.createDataFrame([(1, text)], "id int, text string"), 40, 8, tokenizer=path).collect()
    assert len(rows) > 5 and all(length(r.content) <= 40 and text[r.char_start : r.char_end] == r.content for r in rows)
    assert max(len(r.content) for r in rows) > 100 and length("<|endoftext|>") > 1


@pytest.mark.parametrize(
    ("word", "stem"),
    # Examples of the published algorithm.
    [*(x.split(":") for x in "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vileli:vile operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal sensibiliti:sensibl triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens replacement:replac adoption:adopt communism:commun activate:activ effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll".split())],
)
def test_stems(word, stem):
    assert Porter.stem(word) == stem


def test_analysed_documents(spark):
    """Whole words, without stop words, each stemmed."""
    from brindle.functions.text import STOPWORDS

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["english_lexemes"](spark, SF).collect():
        tokens = [t for t in re.findall(r"[^\W_]+(?:-[^\W_]+)*", docs[r.doc_id].lower())]
        words = [w for t in tokens for w in ([t, *t.split("-")] if "-" in t else [t])]
        assert list(r.lexemes) == [Porter.stem(w) for w in words if w not in STOPWORDS]


def test_pages_as_text(spark):
    """Every page's words in order, as a plain removal of tags leaves them."""
    pages = {f"{r.page_id}.html": r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["html_to_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        html = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", pages[r.filename] or "")
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
        assert json.loads(r.metadata).get("title") == (unescape(title[1]).strip() or None if title else None) and r.error is None
        for tag in loaders.DROPPED:
            html = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "\n", html)
        html = re.sub(r"(?is)<h([1-6])\b[^>]*>", lambda m: " " + "#" * int(m[1]) + " ", html)
        assert r.text.split() == unescape(re.sub(r"<[^>]+>", "\n", html)).split()


def test_search_equals_plain_version(spark):
    """Both searches, fusion and cut over chunks of all documents, with numpy."""
    from brindle.operators.embed import HashingEmbedder

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.item_id % 100 == 0}
    made, cut = HashingEmbedder(64), chunk.Chunker(512, 64)
    pieces = [(f"{r.doc_id}:{i}", r.doc_id, c.text) for r in docs for i, c in enumerate(cut.split(r.text))]
    vectors = np.array(made.embed([t for _, _, t in pieces]), np.float64)
    terms = [re.findall("[a-z0-9]+", t.lower()) for _, _, t in pieces]
    want = set()
    for q, text in items.items():
        v = np.array(made.embed([text])[0], np.float64)
        norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(v)
        cosine = np.divide(vectors @ v, norms, out=np.full(len(norms), -9.0), where=norms > 0)
        asked = set(re.findall("[a-z0-9]+", text.lower()))
        found = np.array([sum(t in asked for t in own) for own in terms])
        score = 0.1 * found / np.log(1 + np.array([max(len(own), 1) for own in terms]))
        by_vector = sorted(range(len(pieces)), key=lambda i: (-round(cosine[i], 12), pieces[i][0]))[:40]
        by_word = sorted(np.flatnonzero(found).tolist(), key=lambda i: (-score[i], pieces[i][0]))[:40]
        rank = {}
        for order, name in ((by_vector, 0), (by_word, 1)):
            for k, i in enumerate(order, 1):
                rank.setdefault(i, [None, None])[name] = k
        fused = sorted(rank, key=lambda i: (-sum(1 / (60 + r) for r in rank[i] if r), rank[i][0] or 10**6, rank[i][1] or 10**6, pieces[i][0]))
        kept = [i for i in fused[:3] if cosine[i] >= 0]
        want |= {(q, k, pieces[i][1], pieces[i][2]) for k, i in enumerate(kept, 1)}
    got = {(r.query_id, r["rank"], r.doc_id, r.content) for r in QUERIES["knowledge_base_search"](spark, SF).collect()}
    assert got == want


def plain_split(text, size, overlap, separators):
    """The recursive split on strings: the first separator that is there, pieces that begin with it, small ones joined, large ones split further."""
    at = next((i for i, s in enumerate(separators) if s == "" or re.search(s, text)), len(separators) - 1)
    if separators[at] == "":
        pieces = list(text)
    else:
        cut = [m.start() for m in re.finditer(separators[at], text)]
        pieces = [p for p in (text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])) if p]
    out, small = [], []

    def join():
        held = []
        for piece in [*small, None]:
            if piece is None or sum(map(len, held)) + len(piece) > size:
                if held:
                    out.append("".join(held).strip())
                while held and piece is not None and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                    held.pop(0)
            if piece is not None:
                held.append(piece)
        small.clear()

    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        join()
        out += plain_split(piece, size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [piece.strip()]
    join()
    return [x for x in out if x]


@pytest.mark.parametrize(("name", "size", "overlap"), [("chunk_recursive", 512, 64), ("chunk_markdown", 400, 40)])
def test_chunks_equal_plain_split(spark, name, size, overlap):
    """Every document's chunks in order, each the text at its offsets."""
    if name == "chunk_recursive":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        separators = [re.escape(s) for s in chunk.TEXT_SEPARATORS]
    else:
        texts = {r.filename: r.text for r in QUERIES["html_to_text"](spark, SF).collect()}
        separators = chunk.MARKDOWN_SEPARATORS
    got = {}
    for r in QUERIES[name](spark, SF).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
        assert texts[r.id][r.char_start : r.char_end] == r.content and r.chunk_index == len(got[r.id]) - 1
    assert got == {k: own for k, t in texts.items() if t and t.strip() and (own := plain_split(t, size, overlap, separators))}
