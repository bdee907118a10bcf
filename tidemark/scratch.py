"""Where operators that write (sinks, streams) put their files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting only a local session may go on: executors of a cluster do not share a
    machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
