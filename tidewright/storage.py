"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster, whose
    machines share no such folder, RuntimeError."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        d = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(d)
    return d
