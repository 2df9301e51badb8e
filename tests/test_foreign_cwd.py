"""Queries with Python UDFs run when the caller's working directory is not
the repository (the workers cannot import the package from there)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("e", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
s = (SparkSession.builder.master("local[2]").config("spark.ui.showConsoleProgress", "false")
     .config("spark.sql.shuffle.partitions", "4").getOrCreate())
s.sparkContext.setLogLevel("ERROR")
print("ROWS", E.queries()["cell_pam"](s, "/root/testdata/sf0.001").count(),
      E.queries()["refine_once"](s, "/root/testdata/sf0.001").count())
"""


def test_udf_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="tessera-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-3000:]
    rows = out.stdout.split("ROWS")[1].split()
    assert int(rows[0]) > 0 and int(rows[1]) == 5
