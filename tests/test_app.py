import base64
import json

import pytest

from brindle import cli, server
from brindle.app import KnowledgeBase
from brindle.config import Settings
from brindle.model import SearchRequest


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    return KnowledgeBase(spark, Settings(base_path=f"file://{tmp_path_factory.mktemp('app')}"))


def test_command_line(kb, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Clinics\n\nFlu clinics open on Monday.")
    (tmp_path / "docs" / "b.txt").write_text("Taxes are due in April.")
    (tmp_path / "q.jsonl").write_text('{"id": "c", "question": "flu clinics", "expected": [{"filename": "a.md"}]}')
    run = lambda *a: (cli.main(list(a), kb), capsys.readouterr().out)
    assert run("init") == (0, "schema version 2\n")
    code, out = run("ingest", f"file://{tmp_path}/docs", "--metadata", '{"dept": "x"}')
    assert code == 0 and out.count("ingested") == 2
    assert run("ingest", f"file://{tmp_path}/docs/a.md")[1].startswith("duplicate")
    assert "a.md" in run("query", "flu clinics")[1] and "[1]" in run("ask", "flu clinics")[1]
    assert json.loads(run("query", "flu", "--json", "--filters", '{"dept": "x"}')[1])["status"] == "ok"
    assert cli.main(["query", "x", "--filters", '{"$bad": 1}'], kb) == 2
    code, out = run("eval", f"{tmp_path}/q.jsonl", "--compare")
    assert code == 0 and all(m in out for m in ("vector", "hybrid", "hybrid+rerank"))
    assert run("migrate", "--status")[1] == "schema version 2, latest 2\n" and cli.main(["ingest", "x", "y", "--doc-key", "k"], kb) == 2
    code, out = run("ingest", f"file://{tmp_path}/docs/b.txt", "--replace", "--valid-until", "2999-01-01", "--review-by", "2998-01-01")
    assert code == 0 and str(kb.documents()[0]["valid_until"]) == "2999-01-01"
    listed = run("list")[1].splitlines()
    assert len(listed) == 2
    assert run("delete", listed[0].split()[0])[0] == 0 and run("delete", "none")[0] == 1
    assert len(run("list")[1].splitlines()) == 1


def test_http(kb):
    ask = lambda *a: server.handle(kb, *a)
    assert ask("GET", "/health")[0] == 200
    status, got = ask("POST", "/documents", [{"filename": "n.txt", "content": base64.b64encode(b"new words here").decode(), "metadata": {"k": 1}, "valid_until": "2999-01-01"}, {"filename": "n.txt", "content": "", "metadata": {"page": 1}}])
    assert status == 200 and [r["status"] for r in got] == ["ingested", "error"]
    own = got[0]["document_id"]
    assert ask("GET", f"/documents/{own}")[1]["filename"] == "n.txt" and len(ask("GET", f"/documents/{own}/versions")[1]) == 1
    assert ask("POST", "/query", {"query": "new words", "top_k": 1})[1]["results"][0]["filename"] == "n.txt"
    assert ask("POST", "/query", {"query": "x", "filters": {"$no": 1}})[0] == 400 == ask("POST", "/query", {"query": ""})[0] == ask("GET", "/documents?limit=0")[0]
    assert ask("DELETE", f"/documents/{own}")[0] == 200 and ask("DELETE", f"/documents/{own}")[0] == 404 == ask("GET", "/documents/none")[0] == ask("PUT", "/x")[0]
    assert ask("GET", "/documents?limit=5&include_history=true")[0] == 200


def test_judged_command(spark, tmp_path, capsys):
    kb = KnowledgeBase(spark, Settings(base_path=f"file://{tmp_path}/kb"))
    kb.upload_all([{"filename": "fees.txt", "content": b"The renewal fee is 300 dollars."}, {"filename": "hours.txt", "content": b"Offices open at eight."}])
    rows = [{"id": "fee", "question": "renewal fee", "expected": [], "reference": "The fee is 300 dollars"}, {"id": "none", "question": "zzz", "reference": "Something"}, {"id": "skip", "question": "open"}]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    out = tmp_path / "report.json"
    assert cli.main(["deepeval", f"{tmp_path}/q.jsonl", "--resume"], kb) == 1
    assert cli.main(["deepeval", f"{tmp_path}/q.jsonl", "--out", str(out), "--metrics", "retrieval"], kb) == 0
    report = json.loads(out.read_text())
    assert report["summary"]["complete"] and report["summary"]["questions_judged"] == 2 and report["summary"]["skipped_no_reference"] == 1 and report["summary"]["refused"] == 1
    by = {c["id"]: c for c in report["cases"]}
    assert by["fee"]["scores"]["contextual_recall"]["passed"] and by["fee"]["returned"][0] == "[1] fees.txt"
    assert by["none"]["scores"]["contextual_recall"]["score"] == 0.0 and "nothing was retrieved" in by["none"]["scores"]["contextual_recall"]["reason"]
    report["cases"][0] |= {"status": "pipeline_error"}
    report["cases"][1] |= {"answer": "kept"}
    out.write_text(json.dumps(report))
    assert cli.main(["deepeval", f"{tmp_path}/q.jsonl", "--out", str(out), "--metrics", "retrieval", "--resume"], kb) == 0
    again = {c["id"]: c for c in json.loads(out.read_text())["cases"]}
    assert again["fee"]["status"] == "ok" and again["none"]["answer"] == "kept"
    assert cli.main(["deepeval", f"{tmp_path}/q.jsonl", "--only", "fee", "--limit", "1"], kb) == 0 and "1 questions judged" in capsys.readouterr().out


def test_batch_of_searches_equals_single_ones(kb):
    kb.upload_all([{"filename": f"s{i}.txt", "content": t.encode(), "metadata": {"k": i % 2}} for i, t in enumerate(["permits for boats", "renewal of permits", "boats and harbours", "the harbour office renews permits"])])
    asked = [SearchRequest("renewals of a permit", min_score=0.0), SearchRequest("boat", hybrid=False, min_score=0.0), SearchRequest("harbour", filters={"k": 1}), SearchRequest("the of and")]
    plain = lambda r: (r.status, [(x["rank"], x["filename"], x["found_by"], x["vector_score"], x["keyword_score"]) for x in r.results])
    together = kb._retriever().search_all(asked)
    assert [plain(r) for r in together] == [plain(kb.search(r)) for r in asked]
    assert any(x["keyword_score"] for x in together[0].results)  # stems: renewals finds renewal
