"""Queries run from another working folder, with the package on no one's path but the driver's."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.append({root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
print("rows", entry.queries()["c8_davies_bouldin"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    script = SCRIPT.format(root=ROOT, folder=f"file://{tmp_path}/shared")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    rest = tmp_path / "rest"
    shutil.copytree(ROOT, rest, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print('names', len(q), len(s), sum(n.startswith('op') or n == 'pipeline' for n in q))"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (rest / name).unlink()
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-B", "-c", ask], cwd=rest, env=env, capture_output=True, text=True, timeout=120)
        names = done.stdout.split()
        assert names[:1] == ["names"] and int(names[1]) > 150 and int(names[2]) > 100 and names[3] == "0", done.stderr[-2000:]
