"""What a set of filters removes together, in every order of applying them.

Each document fails some of the five filters: a mask of five bits. All that any order does to a document follows from
its mask, so documents are counted by part and mask (all, good, toxic), and each such histogram is a row of 32 counts.
The rows are multiplied by whole-number matrices of 32 masks by 600 columns (120 orders of 5 steps): 1 where a document
with that mask is kept after the step, removed at it, failing but removed before, or failing that filter alone.

Whether a text repeats one of a smaller id is settled on digests: rows are first counted by digest, part, labels and
mask, so that a text that a third of the table shares is a handful of rows before its smallest id is looked for.

Defined cases: a null text is empty, a null part is the empty string. Words are what stands between white space. A null
id neither repeats nor is repeated, and has no labels; rows that share an id and a text don't repeat each other. A
document is good (toxic) if any of its label rows says so. Repeated rows count as often as they occur. An empty table
gives an empty result. Columns other than the id, the text, the part and the labels are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import to_arrow

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
REPEAT = 1 << FILTERS.index("E")
KINDS = ("documents", "good", "toxic")


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at one text: A short, B repetitive, C capitals, D special characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    failing = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))


def facts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, label_id: str) -> DataFrame:
    """(digest, part, good, toxic, mask, n, first, n_first): documents counted by what they have in common.

    ``first`` is the smallest id among them, which ``n_first`` of them have.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", text_mask(F.col("text")).alias("mask"), F.when(F.col("id").isNotNull(), F.unhex(F.sha2("text", 256))).alias("digest"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = rows.join(known, rows["id"] == known["label_id"], "left").select("id", "digest", "part", "mask", "n", flag("good"), flag("toxic"))
    return joined.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))


def histograms(rows: DataFrame) -> DataFrame:
    """(part, documents, good, toxic): for each part three arrays of 32 counts, by mask."""
    smallest = F.min("first").over(Window.partitionBy("digest"))
    originals = F.when(F.col("digest").isNull(), F.col("n")).when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + REPEAT).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    each = rows.withColumn("smallest", smallest).withColumn("originals", originals).select("part", "good", "toxic", F.explode(split).alias("m")).select("part", "good", "toxic", "m.mask", "m.n")
    counts = each.groupBy("part", "mask").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2**STEPS - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_arrays("masks", c), i), F.lit(0).cast("long"))).alias(c)
    by_part = counts.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("documents", "good", "toxic")], F.collect_list("mask").alias("masks"))
    return by_part.select("part", *[filled(c) for c in KINDS])


def incidence() -> dict[str, np.ndarray]:
    """The matrices of 32 masks by 600 columns; column 5 i + j is step j + 1 of order i."""
    masks = np.arange(2**STEPS)[:, None]
    columns = [(sum(1 << FILTERS.index(f) for f in order[:j]), 1 << FILTERS.index(order[j])) for order in ORDERS for j in range(STEPS)]
    before, own = np.array(columns, np.int64).T
    fails, gone = (masks & own) > 0, (masks & before) > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    return {k: v.astype(np.int64) for k, v in out.items()}


def outcomes(hist: DataFrame) -> DataFrame:
    """Six hundred rows for each part: the histograms times the matrices."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    types = hist.sparkSession.createDataFrame([], "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names)).schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = incidence()
        letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        member = np.eye(STEPS, dtype=np.int64)[letters]  # 600 columns by filter
        orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            stacked = np.concatenate([batch.column(k).flatten().to_numpy().reshape(-1, 2**STEPS) for k in KINDS])
            n = batch.num_rows
            cells = {k: stacked[:n] @ m for k, m in matrices.items()}
            lost = stacked[n:] @ matrices["removed"]
            cells |= {"good_lost": lost[:n], "toxic_lost": lost[n:], "shapley": (cells["removed"] @ member)[:, letters]}
            for i, part in enumerate(batch.column("part").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(orders), pa.array(steps), *[pa.array(cells[k][i]) for k in names]], schema=arrow)

    return hist.mapInArrow(run, types)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return outcomes(histograms(facts(docs, labels, id_col, text_col, part_col, label_id)))
