"""The entry without the optional text-pipeline operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
assert not any(name.startswith("op") for name in entry.queries()), "operators are still there"
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert entry.queries()["corpus_size"](spark, "/root/testdata/sf0.001").count() >= 1
"""


def test_imports_and_runs_without_the_text_pipeline(folder):
    copy = Path(folder) / "copy"
    hidden = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=hidden)
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(copy)], cwd=folder,
                          capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
