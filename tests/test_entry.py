import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    assert not (copy / "postlens/llm").exists()
    said = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    all_queries, with_sql, optional = map(int, said.stdout.split())
    assert all_queries >= 38 and with_sql >= 37 and optional == 0
