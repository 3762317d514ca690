"""The driver contract works from another working directory in a plain session
(Python workers must import the package through ship_package)."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
rows = E.entry(spark).collect()
assert [r["metric"] for r in rows] == ["Inception Score", "FID", "sFID", "Precision", "Recall"], rows
assert E.queries()["metrics_ema"](spark, "/root/testdata/sf0.001").count() == 1000
print("ENTRY_OK")
"""


def test_entry_from_other_cwd():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ENTRY_OK" in out.stdout, out.stderr[-3000:]
