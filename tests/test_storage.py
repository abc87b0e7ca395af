"""The shared folder: named by the session, or a local session's own; gone when the driver ends."""

import os
import subprocess
import sys

from .conftest import REPO

_SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from quern.sources.storage import shared_path
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) == {base!r}
path = shared_path(spark, "t")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3
assert shared_path(spark, "t").rpartition("/")[0] == path.rpartition("/")[0]
print("AT", path.rpartition("/")[0])
"""


def folder_of(tmp_path, base):
    """Runs a session whose defaults hold ``base`` alone."""
    (tmp_path / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {base}\n" if base else "")
    ran = subprocess.run([sys.executable, "-c", _SCRIPT.format(repo=REPO, base=base)], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=240)
    assert ran.returncode == 0, ran.stderr[-2000:]
    return next(x for x in ran.stdout.splitlines() if x.startswith("AT "))[3:]


def test_session_without_a_folder(tmp_path):
    at = folder_of(tmp_path, None)
    assert at.startswith("file:///") and not os.path.exists(at[7:])


def test_named_folder(tmp_path):
    at = folder_of(tmp_path, f"file://{tmp_path}/shared")
    assert at.startswith(f"file://{tmp_path}/shared/quern-") and not os.path.exists(at[7:]) and os.path.isdir(tmp_path / "shared")
