"""Written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the folder that the cluster shares (spark.checkpoint.dir) and reads it back; a temporary folder only in a local session that sets none."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="corvane-tables-"))
        root = _own[0]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
