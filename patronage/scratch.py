"""Tables written once and read several times.

A job that reads the same intermediate rows more than once (rank, then count; or one pass per
fit iteration) must see the *same* rows each time, also after an executor is lost. Such rows are
written to the shared folder the cluster names in ``spark.checkpoint.dir``, below a folder named after
the application. ``clear_scratch`` removes that folder when its results have been used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.errors import InputProblem

SETTING = "spark.checkpoint.dir"
# Whether the shuffle files of a job go when it has ended, or when the driver happens to collect its plan.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Where a local master, which has one machine and no shared folder, keeps its tables if the setting is missing.
LOCAL_FOLDER = "/tmp/checkpoints"


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables. The setting is read, never changed."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise InputProblem(f"{SETTING} is not set.", "Name a folder every executor can reach.")
        folder = LOCAL_FOLDER
    return f"{folder.rstrip('/')}/patronage-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as parquet and read back: short lineage, columns pruned on every read, little disk."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_apart(df: DataFrame, label: str, column: str, values: list) -> list[DataFrame]:
    """``df`` written as ``stored`` does, in one table for each of the values of a column; rows with other values are left out.
    Each can be discarded by itself."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.where(F.col(column).isin(values)).write.option("compression", "zstd").partitionBy(column).parquet(path)
    kind = df.schema[column].dataType
    rest = df.drop(column).schema
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    tables = []
    for value in values:
        folder = jvm.Path(f"{path}/{column}={value}")
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        table = spark.read.schema(rest).parquet(folder.toString()) if there else spark.createDataFrame([], rest)
        tables.append(table.withColumn(column, F.lit(value).cast(kind)).select(df.columns))
    return tables


def discard(table: DataFrame) -> None:
    """Removes the files of a table that ``stored`` returned, once no result needs them any more."""
    spark = table.sparkSession
    folder = scratch_folder(spark)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for file in table.inputFiles():
        path = jvm.Path(file)
        if folder.split("://")[-1].lstrip("/") in file:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs within give their shuffle files back as soon as they have ended. For steps that store or collect what they make: a
    DataFrame made within must not be left to be run twice outside. Afterwards the session's setting is as it was."""
    own = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, own)


def clear_scratch(spark: SparkSession) -> None:
    """Removes every table this application has stored; DataFrames that still read them fail from then on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
