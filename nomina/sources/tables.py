"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir (in the warehouse where that is unset) and read back; removed when
    the driver ends."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/nomina-checkpoints"
    path, schema = f"{where}/nomina-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _sweep() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return
