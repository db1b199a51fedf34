"""The entry without the queries on training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


def entry(root):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root}, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_imports_without_the_folders(tmp_path):
    """Both folders gone, with the pipeline and without it: the other queries are all there."""
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/privacyframes", tmp_path / "privacyframes", ignore=ignore)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    alone = entry(str(tmp_path))
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert entry(str(tmp_path)) == alone
    assert int(alone[0]) > 150 and alone[1:3] == ["0", "False"] and int(alone[3]) > 150
