"""Statistics over findings, outcomes, judgements and errors: column expressions and grouped frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.storage import laid

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z = 1.959963984540054


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or null."""
    return F.when(b.isNull() | (b == 0), F.lit(empty)).otherwise(a / b)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clipped to [0, 1]; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p, z2 = k / n, Z * Z
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), middle - spread), F.least(F.lit(1.0), middle + spread)


def ranked(rows: DataFrame, by: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """Adds each row's place (from 0) in its group by ``order``, and the group's size, however large a group is.

    Rows are dealt out by ranges of (group, order), so one group lies in as many tasks as its rows need, and sorted there;
    the place is the one within the task plus what the group has in tasks before. One number a task and group is summed.
    ``order`` should end with a key, or equal rows are placed as they come. A null group is a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    dealt = laid(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_task", F.shiftright("_at", 33))
    counts = dealt.groupBy("_task", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    told = counts.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in by], "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size))
    same = F.col("_task") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(told, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(place), size)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: what the product and the sum lose by rounding is worked out and added back."""

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)  # 2^27 + 1 cuts the 53 bits of a double in two
        return high, v - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    out = s + (lost + rest)
    return F.when(F.isnan(out), s).otherwise(out)


def quantile(q: float, value: str) -> Column:
    """The exact quantile of ``ranked`` rows as an aggregate: the two neighbours of its place, weighted (linear between ranks).

    The weighted sum is rounded once, as SQL engines do it: equal neighbours give just their value, so that bounds include it.
    """
    at = (F.col("size") - 1) * F.lit(q)
    low = F.floor(at)
    below = F.max(F.when(F.col("place") == low, F.col(value).cast("double")))
    above = F.coalesce(F.max(F.when(F.col("place") == low + 1, F.col(value).cast("double"))), below)
    weight = F.max(at - low)
    return fused(below, 1 - weight, above * weight)


def quantiles(rows: DataFrame, by: list[str], value: str, **names: float) -> DataFrame:
    """One row a group with count n, mean, and the quantiles named; null values count nowhere, and a group without any isn't listed."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    return placed.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[quantile(q, value).alias(n) for n, q in names.items()])


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, and exact quartiles (linear between ranks) per group."""
    return quantiles(rows, by, value, q1=0.25, median=0.5, q3=0.75)


def residuals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of predicted - reference: mean, min, max of the absolute, root mean square, norm, and spread of the signed."""
    d = F.col("predicted") - F.col("reference")
    return rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.min(F.abs(d)).alias("min_abs"), F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.sqrt(F.sum(d * d)).alias("l2"), F.stddev_pop(d).alias("spread"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of verdicts: one row (n, agreement, kappa)."""
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n")).persist()
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("nx")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "v").agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("chance"))
    both = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return both.select("n", po.alias("agreement"), ratio(po - pe, 1 - pe, None).alias("kappa"))


def fleiss(counts: DataFrame, verdict_cols: list[str]) -> DataFrame:
    """Fleiss' kappa from one row per case with the number of raters per verdict."""
    raters = sum((F.col(c) for c in verdict_cols), F.lit(0))
    agree = sum((F.col(c) * (F.col(c) - 1) for c in verdict_cols), F.lit(0)) / (raters * (raters - 1))
    shares = [F.sum(c) / F.sum(raters) for c in verdict_cols]
    pe = sum((s * s for s in shares), F.lit(0.0))
    rows = counts.where(raters > 1).agg(F.count("*").alias("n"), F.avg(agree).alias("p"), pe.alias("pe"))
    return rows.select("n", F.col("p").alias("agreement"), ratio(F.col("p") - F.col("pe"), 1 - F.col("pe"), None).alias("kappa"))


def bands(rows: DataFrame, order: list[str], by: str) -> DataFrame:
    """Equal-count thirds cut at n // 3 and 2n // 3 (the rest goes to the last bands), within the column ``by``."""
    band = F.when(F.col("_place") < F.floor(F.col("_size") / 3), 0).when(F.col("_place") < F.floor(2 * F.col("_size") / 3), 1).otherwise(2)
    return ranked(rows, [by], order, "_place", "_size").withColumn("band", band).drop("_place", "_size")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, by one aggregation without a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


#: The cumulative chances of 0 to 9 draws in a Poisson resample, in parts of 2^32.
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(10)]
#: Odd factors that spread the bits of row and replicate.
ROW_FACTOR, REPLICATE_FACTOR, MIX = 0x9E3779B1, 0x85EBCA6B, 0x45D9F3B


def draws(rows: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each replicate (column) draws each row: a hash of both numbers, so any task can work it out by itself."""
    mask = np.uint64(0xFFFFFFFF)
    x = (rows.astype(np.uint64)[:, None] * np.uint64(ROW_FACTOR) + replicates.astype(np.uint64)[None, :] * np.uint64(REPLICATE_FACTOR)) & mask
    for _ in range(3):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MIX) & mask
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(POISSON, np.uint64), x, side="right")


def bootstrap(rows: DataFrame, id_col: str, metrics: list[str], replicates: int = 5000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(metric, n, point, ci_lo, ci_hi, robust): the mean of each metric, with the bounds of its resampled means.

    Each row is drawn a Poisson number of times in each replicate, worked out from its whole-number id and the replicate's
    number, so a resample isn't dealt out: each task adds up its own rows, and one sum a replicate and task is shuffled.
    Bounds are the means at places int(low n) and int(high n) of the sorted replicates. Null values count nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total, block = np.zeros((len(metrics), replicates)), np.zeros((len(metrics), replicates)), 512
        numbers = np.arange(replicates)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i in range(0, len(ids), block):
                drawn = draws(ids[i : i + block], numbers).astype(np.float64)
                for m in range(len(metrics)):
                    x = batch.column(f"m{m}").to_numpy(zero_copy_only=False)[i : i + block].astype(np.float64)
                    there = ~np.isnan(x)
                    weight[m] += drawn[there].sum(0)
                    total[m] += x[there] @ drawn[there]
        for m in range(len(metrics)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, m, np.int32)), pa.array(numbers.astype(np.int32)), pa.array(weight[m]), pa.array(total[m])], names=["m", "replicate", "w", "x"])

    values = rows.select(F.pmod(F.col(id_col).cast("long"), F.lit(1 << 32)).alias("id"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metrics)])
    sums = values.mapInArrow(run, "m int, replicate int, w double, x double").groupBy("m", "replicate").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    means = sums.where("w > 0").groupBy("m").agg(F.sort_array(F.collect_list(F.col("x") / F.col("w"))).alias("means"))
    point = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("point")) for i, c in enumerate(metrics)])
    at = lambda q: F.try_element_at("means", F.floor(q * F.size("means")).cast("int") + 1)
    out = rows.agg(point.alias("p")).select(F.explode("p").alias("p")).select("p.*").join(means, "m").select("metric", "n", "point", at(low).alias("ci_lo"), at(high).alias("ci_hi"))
    return out.withColumn("robust", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def audited(left: DataFrame, right: DataFrame, key: list[str], names: tuple[str, str] = ("no variant", "no outcome")) -> DataFrame:
    """(key, outcomes, state): the rows of ``left`` with the number of theirs in ``right``, and the keys that only one side has.

    The right side is counted first, so a key with many outcomes meets its variant as one row. What would be lost in an
    inner join is listed: ``names`` say which side is missing.
    """
    counted = right.groupBy(*key).agg(F.count("*").alias("outcomes")).withColumn("_r", F.lit(True))
    both = left.select(*key).withColumn("_l", F.lit(True)).join(counted, key, "full_outer")
    state = F.when(F.col("_l").isNull(), names[0]).when(F.col("_r").isNull(), names[1]).otherwise("matched")
    return both.select(*key, F.coalesce("outcomes", F.lit(0)).alias("outcomes"), state.alias("state"))
