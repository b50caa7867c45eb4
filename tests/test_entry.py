"""The driver contract, with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "tactica"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(HERE, "tactica")):
        if os.path.basename(folder) == "llm":
            continue
        for n in (n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, n)) as f:
                assert "tactica.llm" not in f.read()


def test_oracles_have_their_queries():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) >= 50
