"""Cutting lineage: checkpoints in the shared folder that the cluster names."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in ``spark.checkpoint.dir`` (in local mode, where that is unset, in a folder of our own)."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skirmish-"))
    return df.checkpoint()
