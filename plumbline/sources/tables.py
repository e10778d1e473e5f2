"""Reading Parquet tables so that small ones use all cores, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A Parquet row group of usual size: a file below it is one task's work however it is split.
ROW_GROUP_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if it lies in fewer files than there are cores, and none can hold many row groups, its rows are dealt out.

    Tables of many files or of large ones are read as they are: their splits keep all cores busy.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files
    return rows.repartition(cores) if 1 << 20 <= size < ROW_GROUP_BYTES and len(rows.inputFiles()) < cores else rows
