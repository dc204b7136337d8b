"""Packing along a space-filling curve.

Each document's tokens give a hashed vector, projected to four dimensions by a fixed random matrix; the Hilbert index of
that point orders the documents, so neighbours on the curve have like vectors. The documents are laid end to end in
that order (ties by id) and cut every ``length`` tokens: only the last sequence isn't full.

The place of a document is the sum of all lengths before it: a range sort of a few dozen bytes a document, sums within
each range, and one number per range through the driver. Token ids are written once and meet their places in one join.

Defined cases: a null or empty text is just the end id; long documents are cut into as many pieces as needed; repeated
rows are packed as often as they occur; equal texts have equal keys and lie side by side; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, made, partitions, to_arrow, written

DIMENSIONS, BITS, WIDTH = 4, 12, 256
#: Fixed value: what ends a document.
END_ID = 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of whole numbers below 2^bits (Skilling's transform, all rows at once)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (WIDTH, DIMENSIONS))


def curve_keys(docs: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as token ids."""
    counts = np.stack([np.bincount((d.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=WIDTH) for d in docs])
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return hilbert(np.minimum(((1 << BITS) / (1 + np.exp(-1.7 * (vectors @ matrix)))).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], id_col: str = "doc_id", text_col: str = "text", length: int = 2048) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ids is binary, 32-bit little-endian.

    ``encoder()`` is called on the executors and gives the function from a text to its 16-bit ids.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]

    def make():
        encode, matrix, end = made(encoder), projection(), np.uint16(END_ID).tobytes()

        def step(rows):
            ids = [encode(t or "") + end for t in rows["text"]]
            return {"id": rows["id"], "n": [len(x) // 2 for x in ids], "key": curve_keys([np.frombuffer(x, np.uint16) for x in ids], matrix).tolist(), "ids": ids}

        return step

    encoded = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, n long, key long, ids binary")
    tokens = written(encoded.withColumn("row", F.monotonically_increasing_id()), "packing-tokens")

    schema = "row long, before long, part int"
    types = spark.createDataFrame([], schema).schema
    arrow = to_arrow(types)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy()
            sums = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "before": total + sums - n, "part": np.full(len(n), part, np.int32)}, schema=arrow)
            total += int(sums[-1]) if len(sums) else 0

    order = ["key", "id", "row"]
    ranged = tokens.select("row", "id", "key", "n").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(ranged.mapInArrow(places, types), "packing-places")
    sums = placed.join(tokens.select("row", "n"), "row").groupBy("part").agg(F.sum("n").alias("n")).collect()
    first, total = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        first.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(first or [(0, 0)], "part int, base long")  # one row per range
    at = placed.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("before")).alias("at"))

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    cut_types = spark.createDataFrame([], schema).schema
    cut_arrow = to_arrow(cut_types)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in cut_arrow.names}
            for i, n, place, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "at", "ids")), strict=True):
                ids = np.frombuffer(raw, np.uint16).astype("<u4")
                start = 0
                while start < n:
                    offset = (place + start) % length
                    size = min(length - offset, n - start)
                    for name, value in zip(cut_arrow.names, (i, start, size, ids[start : start + size].tobytes(), n, (place + start) // length, offset), strict=True):
                        out[name].append(value)
                    start += size
            yield pa.RecordBatch.from_pydict(out, schema=cut_arrow)

    return tokens.select("row", "id", "n", "ids").join(at, "row").select("id", "n", "at", "ids").mapInArrow(cut, cut_types).withColumnRenamed("id", id_col)


def crc32_of(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


