"""The shared folder of sessions with and without a setting."""

import subprocess
import sys

STOCK = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from graphrec.functions import lineage
if len(sys.argv) > 1:
    spark.sparkContext.setCheckpointDir(sys.argv[1])
d = lineage.written(spark.range(10), "rows")
folder = lineage.work_dir(spark, "x")
assert d.count() == 10 and lineage.shared_folder(spark) in folder
assert len(sys.argv) < 2 or sys.argv[1].removeprefix("file://") in folder
b = lineage.bucketed(spark.range(10), "id", "buckets", 2)
assert b.count() == 10
lineage.unbucketed(b)
lineage.dropped(d)
print("fine")
"""


def stock(tmp_path, *arguments):
    """A session of its own, without this machine's defaults."""
    import os

    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK_SUBMIT"))}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env.get("PYTHONPATH", "")])}
    return subprocess.run([sys.executable, "-c", STOCK, *arguments], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)


def test_a_stock_session_gets_a_folder(tmp_path):
    done = stock(tmp_path)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_a_checkpoint_folder_is_taken(tmp_path):
    done = stock(tmp_path, f"file://{tmp_path}/own")
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
