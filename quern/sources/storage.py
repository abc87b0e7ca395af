"""Where tables lie that outlive one query, and go with the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of local sessions that name none, and each application's own folder below the shared one, by application.
_LOCAL: dict[str, str] = {}
_OWN: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as a full URI: the folder that all executors see.  A local session without one gets a folder
    under the system's temporary one; elsewhere it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        base = _LOCAL[sc.applicationId]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place for a table, in the application's folder, which is deleted when the driver ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _OWN:
        _OWN[key] = f"{key[1]}/quern-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_OWN[key])
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{_OWN[key]}/{name}-{uuid.uuid4().hex}"
