"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder the session names in spark.checkpoint.dir; where none is set, a local folder on a local master and the warehouse on a cluster."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="gridweave-") if sc.master.startswith("local") and not sc.master.startswith("local-cluster") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"))
    return df.checkpoint()
