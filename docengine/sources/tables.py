"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes for each core than this is dealt out to the cores before work begins.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if it is so small that it may be one row group, which one task would read and work on.

    What is moved is bounded by SMALL bytes for each core. Larger tables have row groups enough and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
