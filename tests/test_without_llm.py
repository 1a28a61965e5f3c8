"""The engine without its optional subpackage: both folders and the pipeline gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import __spark_entry__ as e
from marlstone import session
names = e.queries()
assert len(names) > 150 and set(e.oracle_sql()) <= set(names)
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names)
spark = session.build(2, "without", **{"spark.sql.shuffle.partitions": "2"})
assert e.entry(spark).count() == 20 and names["prefilter_reason"](spark, e.SMOKE_DIR).count() > 0
"""


def test_rest_works_without_llm(tmp_path):
    for name in ("marlstone", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        else:
            shutil.copy(source, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
