"""The entry point works whatever part of the corpus operators was taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LOOK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and len(q) > 100 and "harmonize_flagship" in q
print("pipeline" in q, any(n.startswith("op10_") for n in q))
"""


@pytest.mark.parametrize("gone, left", [(["tallyweave/llm", "tests/llm"], "False False"), (["tallyweave/llm", "tests/llm", "corpus_pipeline.py"], "False False"), (["corpus_pipeline.py"], "False True"), ([], "True True")])
def test_entry_without_optional_parts(tmp_path, gone, left):
    if any(not (ROOT / name).exists() for name in ("tallyweave/llm", "corpus_pipeline.py")):
        pytest.skip("the corpus operators are not there")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name)
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}
    said = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split("\n")[0] == left
    if gone and "tests/llm" in gone:
        listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert listed.returncode == 0, listed.stdout + listed.stderr
