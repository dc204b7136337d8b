"""Tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veritrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def laid(df: DataFrame, name: str, by: str | None = None, kinds: StructType | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again; ``by``: a column by whose values they lie in folders, so that a filter on it reads only those; ``kinds``: what the columns are read as."""
    path = f"{shared_dir(df.sparkSession)}/veritrail/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(kinds or df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, parts: int, order: list[str], lying: bool = False) -> DataFrame:
    """The rows as a table that lies in ``parts`` buckets by ``key``, sorted within each, read again.

    Joins and groups by the key and anything else then find their rows in one bucket and shuffle nothing: the setting says
    that a part of a join's keys is enough to lie together. A key's rows must be few, as a package's are. ``lying``: the
    rows already are in so many partitions by the key, and aren't shuffled again.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"veritrail_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/veritrail/{table}"
    rows = df if lying else df.repartition(parts, key)
    rows.write.option("compression", "zstd").bucketBy(parts, key).sortBy(*order).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), with the folder set if nothing has set it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
