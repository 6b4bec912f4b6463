import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
from pyspark.sql import SparkSession
from faultline.operators.graph import reachability
from faultline.session import checkpoint_dir

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 0)], "src string, dst string, cost int")
roots = spark.createDataFrame([("a", "a")], "root string, node string")
print(sorted(map(tuple, reachability(edges, roots).collect())), checkpoint_dir(spark) == checkpoint_dir(spark))
"""


def test_a_local_session_without_the_setting_gets_a_folder(tmp_path):
    """In a fresh process without Spark defaults that name a folder."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip() == "[('a', 'a', 0), ('a', 'b', 1), ('a', 'c', 1)] True"
