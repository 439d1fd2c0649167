"""Tables in the shared scratch folder: where iterative work cuts its lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, one of our own: in the warehouse, which a cluster's executors share, or, where
    driver and executors are one process, in the machine's temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.split("[")[0] == "local"
        where = os.path.join(tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir"), "skein-scratch")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table and read it back: the plan above ends there, for good."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
