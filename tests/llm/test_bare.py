"""Every operator in a session without settings, from a folder without the package: executors get what they need with the job."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name in ("pipeline", "damped_trend"):
        assert query(spark, {data!r}).count() > 0, name
        print(name, flush=True)
"""


def test_without_settings_and_package_on_executors(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS", "SPARK_ENV_LOADED")}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, data=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert len(done.stdout.split()) == 15
