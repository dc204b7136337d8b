"""Texts classified by weighted logistic regression over TF-IDF, and the sentences that score highest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veritrail.functions import text as texts
from veritrail.storage import laid

#: Lengths of character runs; texts of about so many characters are worked on together.
SIZES, CHARS = (3, 4, 5), 1 << 18
#: Vectors have thousands of entries, so a task reads fewer of them at once than of other rows.
BATCH, VECTORS = "spark.sql.parquet.columnarReaderBatchSize", "128"
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def spread(h: np.ndarray, salt: int, features: int) -> np.ndarray:
    """Hashes as features, others for each salt."""
    h = (h ^ np.uint64(salt)) * M2
    h = (h ^ (h >> np.uint64(29))) * M1
    return ((h >> np.uint64(32)) % np.uint64(features)).astype(np.int64)


def featurer(features: int):
    """A function from squashed texts to (owner, feature) of each word, pair of words and character run of 3 to 5, in time linear in their length.

    Words, pairs and runs have ``features`` features each. Owners are indexes of the texts, in order within each kind.
    """

    class Kept(dict):
        def __missing__(self, word):
            if len(self) >= 200_000:
                self.clear()
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    kept = Kept()

    def step(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [[w for w in t.split(" ") if w] for t in own]
        h = np.array([kept[w] for ws in words for w in ws], np.uint64)
        of = np.repeat(np.arange(len(own)), [len(ws) for ws in words])
        pair = of[1:] == of[:-1]
        owners, out = [of, of[1:][pair]], [spread(h, 1, features), features + spread((h[:-1] * M1 + h[1:])[pair], 2, features)]
        c = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(own)), [len(t) for t in own])
        run = c
        for n in range(2, SIZES[-1] + 1):
            run = run[:-1] * M1 + c[n - 1 :]
            if n in SIZES:
                inside = of[n - 1 :] == of[: len(of) - n + 1]
                owners.append(of[n - 1 :][inside])
                out.append(2 * features + spread(run[inside], n, features))
        return np.concatenate(owners), np.concatenate(out)

    return step


def portions(own: list[str | None]):
    """Some texts at a time, with the index of the first."""
    first, held, size = 0, [], 0
    for t in own:
        held.append(t or "")
        size += len(held[-1])
        if size >= CHARS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def counted(rows: DataFrame, text_col: str, features: int) -> DataFrame:
    """The rows with the vector ``counts`` of their features instead of their text, written once: every later step reads it as a vector."""
    vector = VectorUDT().sqlType()

    @F.arrow_udf(vector)
    def counts(squashed: pa.Array) -> pa.Array:
        step, sizes, indices, values = featurer(features), [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for _, own in portions(squashed.to_pylist()):
            of, feature = step(own)
            at, n = np.unique(of * (3 * features) + feature, return_counts=True)
            sizes.append(np.bincount(at // (3 * features), minlength=len(own)))
            indices.append((at % (3 * features)).astype(np.int32))
            values.append(n.astype(float))
        ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        rows = len(ends) - 1
        fields = np.zeros(rows, np.int8), np.full(rows, 3 * features, np.int32), *(pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (indices, values))
        return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields], vector.names)

    kept = [c for c in rows.columns if c != text_col]
    kinds = StructType([*(rows.schema[c] for c in kept), StructField("counts", VectorUDT())])
    return laid(rows.select(*kept, counts(texts.squash(F.col(text_col))).alias("counts")), "features", kinds=kinds)


def balanced(rows: DataFrame, label_col: str) -> DataFrame:
    """Adds the weight that makes both labels count alike: n / (labels * n of the label)."""
    counts = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}  # one row a label
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col(label_col) == label, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit(rows: DataFrame, text_col: str, label_col: str, features: int = 1 << 15, regularisation: float = 0.01, iterations: int = 40) -> PipelineModel:
    """A model of rows with labels 0 and 1: word 1- and 2-grams and character 3- to 5-grams, hashed, weighted by IDF.

    All steps run over all rows as Spark jobs; what the driver holds is the coefficients.
    """
    stages = [
        IDF(inputCol="counts", outputCol="features", minDocFreq=2),
        LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="weight", regParam=regularisation, maxIter=iterations),
    ]
    known = counted(rows.where(F.col(label_col).isNotNull()).select(text_col, label_col), text_col, features)
    conf = rows.sparkSession.conf
    before = conf.get(BATCH)
    try:
        conf.set(BATCH, VECTORS)
        return Pipeline(stages=stages).fit(balanced(known, label_col))
    finally:
        conf.set(BATCH, before)


def chance(model: PipelineModel):
    """A column function from squashed texts to the model's chance of label 1: the weights of all features that occur, summed."""
    idf, regression = model.stages
    weights, offset = np.asarray(idf.idf.toArray()) * regression.coefficients.toArray(), regression.intercept

    @F.pandas_udf("double")
    def chances(squashed):
        import pandas as pd

        step, out = featurer(len(weights) // 3), np.full(len(squashed), offset)
        for first, own in portions(squashed.tolist()):
            of, feature = step(own)
            out[first : first + len(own)] += np.bincount(of, weights[feature], len(own))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return chances


def scored(model: PipelineModel, rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``score``, the model's chance of label 1; a null text has no features."""
    return rows.withColumn("score", chance(model)(texts.squash(F.col(text_col))))


def top_sentences(model: PipelineModel, docs: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, place, sentence, score) of the k sentences of each document that score highest, earlier ones first among equals.

    Sentences are ranked within a document, after each has been scored in its own row.
    """
    rows = docs.select(id_col, F.posexplode(texts.sentences(F.col(text_col))).alias("place", "sentence"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "place")
    return scored(model, rows, "sentence").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
