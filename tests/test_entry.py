"""The entry points with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
TELL = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(x.startswith('op') for x in q), 'pipeline' in q)"


def told(folder):
    done = subprocess.run([sys.executable, "-c", TELL], cwd=folder, capture_output=True, text=True, env={"PYTHONPATH": str(folder)}, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_works_without_text_operators(tmp_path):
    for name in ("tidegate", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    n, texts, pipeline = told(tmp_path)
    assert int(n) > 100 and texts == "0" and pipeline == "False"
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert told(tmp_path) == [n, "0", "False"]
