"""The library stands without the training-data operators."""

import ast
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def modules():
    for d, _, names in os.walk(os.path.join(ROOT, "screentone")):
        if os.path.basename(d) not in ("llm", "__pycache__"):
            yield from (os.path.join(d, n) for n in names if n.endswith(".py"))


def test_nothing_else_imports_the_subpackage():
    for path in modules():
        with open(path) as f:
            tree = ast.parse(f.read())
        for node in ast.walk(tree):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('screentone.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'e3_shape_marks' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT}, timeout=120)
