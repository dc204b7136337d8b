"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes a query's shuffle files at its end rather than when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows go to Python in batches of about so many bytes, however long the texts and sets in them are.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veritrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, batch: int | None = None, by: str | None = None, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again.

    The table stays there until that folder is cleaned, as later reads (and retries of lost tasks) need it. The shuffle
    files behind it go as soon as it is written. ``batch``: most rows that go to Python at once; their bytes are bounded too.
    ``by``: a column by whose values the rows lie in folders, so that ``drop`` can delete some of them. ``path``: the
    folder, instead of one made up from ``name``. ``options``: of the Parquet writer.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/veritrail/{name}-{uuid.uuid4().hex}"
    own = {CLEAN_UP: "true"} | BATCH_BYTES | ({BATCH_ROWS: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = df.write.options(**{"compression": "zstd"} | (options or {}))
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame, only: str = "") -> None:
    """Delete tables made by ``written`` that no later step reads: everything made from them has been written itself.

    ``only``: just the folder of that name in a table written ``by`` a column.
    """
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f for file in df.inputFiles() if (f := file.rsplit("/", 1)[0]).endswith(only)}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, or ``least`` if that is more."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the held-out rows. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@functools.lru_cache(maxsize=2)
def made(encoder: Callable[[], Callable[[str], bytes]]) -> Callable[[str], bytes]:
    """The encoder, made once in each Python worker, whatever number of tasks it runs."""
    return encoder()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists, and arrays of numbers in them as Numpy arrays.

    ``make()`` runs once per task on the executor and returns the function from the columns of a batch to the columns
    of its result.
    """
    spark = df.sparkSession
    types = spark.createDataFrame([], schema).schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step({n: values(batch.column(n)) for n in batch.schema.names}), schema=arrow)

    return df.mapInArrow(run, types)


def values(column: pa.Array) -> list:
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.null_count:
        return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())[:-1])
    return column.to_pylist()


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
