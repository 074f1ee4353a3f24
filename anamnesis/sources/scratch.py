"""Tables between the steps of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a table in the folder that spark.checkpoint.dir names; one of its own only where that is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="anamnesis-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/anamnesis-steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
