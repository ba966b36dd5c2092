"""Scratch paths live below the session's checkpoint folder; staged tables; packaging."""

import os
import subprocess
import sys
import tempfile

import pytest

from shardline.session import checkpoint_root, drop_staged, exists, shared_path, staged


def test_shared_paths_are_below_the_checkpoint_dir(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir().rstrip("/")
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a.startswith(root + "/x-") and b.startswith(root + "/x-") and a != b


def test_staged_tables_can_be_dropped(spark):
    df = staged(spark.range(5), "t-staged")
    assert df.count() == 5 and exists(spark, df.staged_at)
    drop_staged(df)
    assert not exists(spark, df.staged_at)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session)


def test_workers_need_no_installed_package():
    """Python workers get the package from the driver, from any working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from shardline.session import build_session
from shardline.operators.ordered import prefix_sum
spark = build_session("local[2]", 2)
df = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "k int, t int, v int")
print("SUMS", sorted(r.s for r in prefix_sum(df, ["k"], ["t"], "v", "s").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True,
                         timeout=180)
    assert "SUMS [0, 5]" in out.stdout, out.stderr[-2000:]
