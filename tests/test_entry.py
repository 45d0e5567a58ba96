"""The driver's contract, also without the training-data folders."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0
    assert queries["queue_status"](spark, sf).count() == 6


def test_without_the_training_data_folders(tmp_path):
    for name in ("memlake", "tests", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') and n[2].isdigit()], 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
    assert done.stdout.split(" ", 1)[1].strip() == "[] False True"


def test_without_a_library_of_the_training_data_operators(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('hidden')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 90, any(n.startswith('op1') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
    assert done.stdout.split() == ["True", "False", "False", "True"]
