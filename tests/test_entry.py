"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


SAY = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1], any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_operators(tmp_path, left):
    for x in ("emberplan", "__spark_entry__.py", *left):
        src = os.path.join(ROOT, x)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(src):  # the pipeline may itself be absent
            shutil.copy(src, tmp_path / x)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 90


def test_entry_does_not_swallow_a_mistaken_import(tmp_path):
    shutil.copytree(os.path.join(ROOT, "emberplan"), tmp_path / "emberplan", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import emberplan.no_such_module\n")
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode != 0 and "no_such_module" in said.stderr


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
