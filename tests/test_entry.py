import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_names_match():
    from tidemark.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) >= 150


def test_library_stands_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/tidemark", copy / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False", "False", "True"], out.stderr[-800:]


def test_nothing_else_imports_the_llm_package():
    for folder, _, names in os.walk(f"{ROOT}/tidemark"):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read(), n
