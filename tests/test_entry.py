"""The driver contract without the optional folders."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in [*q, *s] if n != 'output_folders' and n != 'orphans'); print(len(q))"


@pytest.mark.parametrize("gone", [("webstrata/llm",), ("webstrata/llm", "corpus_pipeline.py")])
def test_entry_point_without_training_data(tmp_path, gone):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        path = there / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=there, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 80
