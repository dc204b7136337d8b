"""Vector codes: vectors cut into parts, each part replaced by the index of its nearest codebook entry.

Components become whole numbers, floor(scale * x). Equal parts of one position are one weighted row from then on
(one aggregation, so a vector that a third of the table shares is a single row); the rounds of Lloyd's method run over
these distinct rows, with all sums in whole numbers, so results don't depend on the order of rows or tasks. What goes
through the driver is the codebooks and their sums, of a size given by ``parts``, ``entries`` and the vectors' length.
The last assignment is joined back to the vectors by position and part; a very common part is a skewed key of the
vectors' side of that join only, which Spark splits, as the other side has each part once.

Defined cases: rows without a vector, with an empty one, or with a null or non-finite component are dropped; so are
vectors of another length than the one with the smallest id, as they can't be cut alike. Null ids come last. Rows that
share an id are ordered by their components, and repeated rows count as often as they occur. With fewer than
``entries`` vectors the codebooks are that much smaller; an empty table gives an empty result. A length that ``parts``
doesn't divide is an error, and so is a component of 2^26 or more after scaling, whose distances could pass 64 bits.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import to_arrow, written

#: Scaled components stay below this, so that squared distances of parts of up to 512 components fit in 64 bits.
LARGEST = 1 << 26


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *others: str) -> DataFrame:
    """(id, ints, others) of the rows whose vector is complete and finite."""
    x = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    complete = x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)

    def scaled(v: Column) -> Column:
        n = F.floor(v.cast("double") * scale)
        return F.when(F.abs(n) < LARGEST, n).otherwise(F.raise_error(F.lit("a scaled component is 2^26 or more")).cast("long")).cast("int")

    return vectors.where(complete).select(F.col(id_col).alias("id"), F.transform(x, scaled).alias("ints"), *[F.col(c).alias(f"_{c}") for c in others])


def smallest(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids, ascending. Ids alone are ordered first, so the second pass reads few vectors."""
    order = F.col("id").asc_nulls_last()
    ids = [r["id"] for r in rows.select("id").orderBy(order).limit(n).collect()]
    if len(ids) == n and ids[-1] is not None:
        rows = rows.where(F.col("id") <= F.lit(ids[-1]))
    return [r["ints"] for r in rows.orderBy(order, "ints").limit(n).collect()]


def nearest(points: np.ndarray, entries: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it, for each row of whole numbers; ties go to the lower index.

    Floating point is used only while every intermediate is a whole number below 2^53, where it is exact.
    """
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    table = entries.astype(kind)
    squares = (table * table).sum(1)
    codes, errors = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    for i in range(0, len(points), rows):
        x = points[i : i + rows].astype(kind)
        d = squares - 2 * (x @ table.T)
        codes[i : i + rows] = best = d.argmin(1)
        errors[i : i + rows] = d[np.arange(len(x)), best] + (x * x).sum(1)
    return codes, errors


def parts_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, row numbers, matrix of parts) of a batch."""
    position = batch.column("position").to_numpy()
    matrix = batch.column("part").flatten().to_numpy().reshape(-1, width).astype(np.int64)
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        yield int(p), rows, matrix[rows]


def pieces(position_count: int, width: int) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("position"), F.slice("ints", p * width + 1, width).alias("part")) for p in range(position_count)])


def distinct_parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(position, part, weight): each part of a position once, with the number of vectors that have it."""
    out = rows.select(F.explode(pieces(parts, width)).alias("p")).select("p.*")
    return written(out.groupBy("position", "part").agg(F.count("*").alias("weight")), "vector-parts")


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one weighted round; entries that nothing chose stay as they are."""
    parts, entries, width = books.shape
    types = distinct.sparkSession.createDataFrame([], "position int, entry int, n long, sums array<long>").schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, rows, matrix in parts_of(batch, width):
                codes, _ = nearest(matrix, books[p])
                np.add.at(total[p], codes, matrix * weight[rows, None])
                np.add.at(n[p], codes, weight[rows])
        at, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"position": at, "entry": entry, "n": n[at, entry], "sums": list(total[at, entry])}, schema=arrow)

    each = distinct.mapInArrow(run, types).select("position", "entry", "n", F.posexplode("sums").alias("i", "x"))
    sums = each.groupBy("position", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    out = books.copy()
    out[sums["position"], sums["entry"], sums["i"]] = sums["x"].to_numpy(np.int64) // sums["n"].to_numpy(np.int64)
    return out


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[np.ndarray, DataFrame | None]:
    """The codebooks (part, entry, component) and the distinct parts they were fitted on (None for an empty table)."""
    rows = whole(vectors, id_col, vector_col, scale)
    first = smallest(rows, entries)
    if not first:
        return np.zeros((parts, 0, 0), np.int64), None
    size = len(first[0])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    alike = rows.where(F.size("ints") == size)
    if any(len(v) != size for v in first):
        first = smallest(alike, entries)
    books = np.array(first, np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    distinct = distinct_parts(alike, parts, size // parts)
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    return books, distinct


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(position, part, code, error) of each distinct part."""
    types = distinct.sparkSession.createDataFrame([], "position int, part array<int>, code int, error long").schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, matrix in parts_of(batch, books.shape[2]):
                code[rows], error[rows] = nearest(matrix, books[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part").cast(arrow.field("part").type), pa.array(code), pa.array(error)], schema=arrow)

    return distinct.select("position", "part").mapInArrow(run, types)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal text by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, distinct: DataFrame | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """(id, label, code, error): two hex digits for each part, and the squared distance summed over parts."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)
    if distinct is None:
        return spark.createDataFrame([], f"`{id_col}` {kind[id_col]}, `{label_col}` {kind[label_col]}, code string, error long")
    parts, _, width = books.shape
    rows = whole(vectors, id_col, vector_col, scale, label_col).where(F.size("ints") == parts * width)
    # the id and the label travel with the first part only
    named = F.struct("id", F.col(f"_{label_col}").alias("label"))
    cut = rows.withColumn("row", F.monotonically_increasing_id()).select("row", named.alias("named"), F.explode(pieces(parts, width)).alias("p"))
    cut = cut.select("row", F.when(F.col("p.position") == 0, F.col("named")).alias("named"), "p.position", "p.part")
    found = cut.join(assigned(distinct, books), ["position", "part"]).select("row", "named", F.struct("position", F.lpad(F.lower(F.hex("code")), 2, "0").alias("hex")).alias("c"), "error")
    each = found.groupBy("row").agg(F.first("named", ignorenulls=True).alias("named"), F.sort_array(F.collect_list("c")).alias("c"), F.sum("error").alias("error"))
    return each.select(F.col("named.id").alias(id_col), F.col("named.label").alias(label_col), F.concat_ws("", F.col("c.hex")).alias("code"), "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes by codebooks fitted on the same table.

    ``label_error`` is the error summed over all rows of the label; null labels count as one.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    books, distinct = fit(vectors, id_col, vector_col, parts, entries, rounds, scale)
    codes = written(encode(vectors, books, distinct, id_col, vector_col, label_col, scale), "vector-codes")
    totals = codes.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col(label_col).eqNullSafe(F.col("_label"))).select(id_col, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, scale: int = 1024) -> DataFrame:
    """The rows with ``vector``: the entries that a code stands for, put together and scaled back (the middle of each step)."""
    entries = [F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in e]) for e in part]) for part in books]
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(e, at(p)) for p, e in enumerate(entries)]))
