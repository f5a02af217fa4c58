"""The library does not depend on the optional training-data operators."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_nothing_outside_imports_the_optional_operators():
    for path in (ROOT / "logloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any("llm" in x.split(".") for x in imports(path)), path


def test_core_queries_live_without_a_package_of_the_optional_operators():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_lists_sql_only_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hybrid_rrf" in e.queries()
