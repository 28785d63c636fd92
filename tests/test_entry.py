import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_survive_without_the_optional_part(tmp_path):
    """A copy without the optional subpackage, its tests and the corpus pipeline still lists all panel queries."""
    for name in ("panelforge", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{ROOT}/{name}"):
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"
    for gone in (None, "corpus_pipeline.py"):
        if gone and (tmp_path / gone).exists():
            (tmp_path / gone).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        n, m, extra = done.stdout.strip().splitlines()[-1].split(" ", 2)
        assert int(n) > 100 and int(m) > 100 and extra == "[]"
