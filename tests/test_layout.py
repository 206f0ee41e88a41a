import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_llm_subpackage():
    allowed = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for path in [*ROOT.glob("*.py"), *ROOT.glob("brindle/**/*.py"), *ROOT.glob("tests/*.py")]:
        if path not in allowed and "llm" not in path.relative_to(ROOT).parts and path != Path(__file__):
            assert "brindle.llm" not in path.read_text(), path


def test_entry_works_without_it(tmp_path):
    code = "import sys; sys.modules['brindle.llm'] = None\nimport __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    block = "import importlib.abc, sys\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == 'brindle.llm':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n"
    out = subprocess.run([sys.executable, "-c", block + code.split("\n", 1)[1]], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1] == "True"
