"""Storage and planning helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A side is broadcast only while its written size is at most this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path, as the JVM has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/evalweave-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.mkdirs(where.getParent())
    fs.create(where).close()  # only what exists can be marked
    fs.deleteOnExit(where)
    fs.delete(where, True)
    return path


def materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """Writes df as Parquet into the shared folder; the table read back (its lineage is those files) and its bytes."""
    table, size, _ = written(df)
    return table, size


def written(df: DataFrame) -> tuple[DataFrame, int, str]:
    """As ``materialise``, and the table's path, for tables that ``remove`` takes away before the application ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    fs, where = file_system(spark, path)
    return spark.read.schema(df.schema).parquet(path), fs.getContentSummary(where).getLength(), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no plan reads any more."""
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def sized(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its written size allows; else as it is, and joins with it shuffle."""
    return F.broadcast(df) if size <= limit else df


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name not among columns (case-insensitively), made from name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
