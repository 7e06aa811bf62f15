"""The package reaches the workers although neither they nor the driver start in its folder."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
from cellweave.operators.metrics import silhouette
points = spark.createDataFrame([(0, [0., 0.], 0), (1, [0., 1.], 0), (2, [4., 0.], 1), (3, [5., 0.], 1)],
                               "id long, z array<double>, label long")
print("sil", round(silhouette(points).first()[0], 5))
"""


def test_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "sil 0.77916" in done.stdout, done.stderr[-2000:]
