"""The shared folder: where it is unset, and what is removed."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from shakeprint.functions import lineage

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
from pyspark.sql import SparkSession
from shakeprint.functions import lineage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert lineage.materialise(spark.range(5)).count() == 5
print("FOLDER", lineage.shared_dir(spark))
"""


def test_materialise_without_the_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    folder = next(line.split(" ", 1)[1] for line in done.stdout.splitlines() if line.startswith("FOLDER"))
    assert not os.path.exists(folder)  # removed as the driver ended


def test_a_cluster_needs_the_setting():
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none", master="spark://host:7077"), conf=SimpleNamespace(get=lambda key, default: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(session)


def test_remove(spark):
    df, path = lineage.materialise_at(spark.range(3))
    assert df.count() == 3 and path.startswith(lineage.shared_dir(spark))
    lineage.remove(spark, path)
    lineage.remove(spark, path)
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(path).count()
