"""Splits and samples that repeat: the order within a stratum is that of a seeded hash or of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import ranked


def split(rows: DataFrame, strata: list[str], key: str, seed: int, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """Adds split (train, dev, holdout) within each stratum, by a seeded hash of the key."""
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")))
    placed = ranked(hashed, strata, ["_hash", key], "_place", "_size")
    first, second = F.bround(F.col("_size") * F.lit(train)), F.bround(F.col("_size") * F.lit(dev))
    return placed.withColumn("split", F.when(F.col("_place") < first, "train").when(F.col("_place") < first + second, "dev").otherwise("holdout")).drop("_hash", "_place", "_size")


def even(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The rows at places int(i * n / k) of each group of n, for i below k; all rows of smaller groups."""
    placed = ranked(rows, by, [order], "_place", "_n").withColumn("_i", F.floor((F.col("_place") * k + F.col("_n") - 1) / F.col("_n")))
    return placed.where((F.col("_i") < k) & (F.col("_i") * F.col("_n") < (F.col("_place") + 1) * k)).drop("_place", "_n", "_i")
