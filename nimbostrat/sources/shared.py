"""Where tables go that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; in local mode, where that may be unset, below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder or spark.conf.get('spark.sql.warehouse.dir') + '/checkpoints'}/{name}-{uuid.uuid4().hex}"
