"""What a session needs on a cluster: code for its workers and a shared folder."""

import os
import subprocess
import sys

import pytest

from sparkprep import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
q = E.queries()
names = [n for n in ("f01_forecast_ar", "op13_periodic_runs") if n in q]
print("ROWS", [q[n](spark, "/root/testdata/sf0.001").count() > 0 for n in names])
"""


def test_workers_get_the_package_from_any_working_directory(tmp_path):
    """A driver started elsewhere, without PYTHONPATH: its workers must still find the code."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [True" in out.stdout and "False" not in out.stdout, out.stderr[-2000:]


def test_a_cluster_session_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
