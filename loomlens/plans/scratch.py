"""Where written tables and streams keep what more than one job reads."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share: ``spark.checkpoint.dir``, or for a master within one machine a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid4().hex[:12]}"
