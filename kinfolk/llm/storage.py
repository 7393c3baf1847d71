"""Tables that cut lineage: written to the shared folder the cluster names, then read again.

``spark.checkpoint.dir`` names the folder that driver and executors share. It is read from the
session; only where it is unset and the master is local (tests, notebooks) a local folder is used instead, which goes
when the process ends. On a cluster without the setting ``RuntimeError`` is raised: executors would scatter their files. A written table
survives the loss of executors, which cached blocks and local checkpoints do not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        folder = tempfile.mkdtemp(prefix="kinfolk-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _FALLBACK[app] = "file://" + folder
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reader of what was written."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
