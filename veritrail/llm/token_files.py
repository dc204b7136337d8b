"""Token files: documents as lists of token ids in Parquet, in the order of their ids, for whole or selective reads.

Texts are dealt to files by ranges of (id, digest of the text, row) and sorted within each, so the files in their order
hold all documents in ascending order, and a hot id is spread over as many files as its rows need. Each task encodes its
texts and writes one file: a row holds the id, the number of tokens, the tokens before it in its file, the file's number
and the list of ids. Row groups, pages and encodings are set for the reader: ids are dictionary-encoded (or
delta-packed), numbers delta-packed, pages small, and every column has a page index, so a reader that asks for some
documents skips the pages of the others, and one that asks for counts never touches the ids.

The place of a document among all tokens is the sum of the files before it, one number a file, and its place there.

Defined cases: a null or empty text is just the end id; null ids come first; rows that share an id are ordered by the
digest of their text, and repeated rows are written as often as they occur; very long texts are one row; an empty table
gives files without rows; columns other than the id, the text and ``keep`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, made, partitions, to_arrow, written

IDS = "ids.list.element"


def byte_pair_encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as 16-bit numbers.

    ``ranks_path`` holds the tokenizer's vocabulary in the form of a faster library, which gives the same ids. A text
    that holds a special token's string goes to the tokenizer itself.
    """
    import base64
    from array import array

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids_of(text: str) -> bytes:
        plain = not any(s in text for s in special)
        return array("H", encode(text) if plain else whole.encode(text, add_special_tokens=False).ids).tobytes()

    return ids_of


def layout(encoding: str = "dictionary", row_group_bytes: int = 32 << 20, row_group_rows: int = 50_000, page_bytes: int = 64 << 10, page_rows: int = 200) -> dict[str, str]:
    """Options of the Parquet writer: a row group or page ends at so many bytes or documents. ``encoding``: how ids are stored, dictionary or delta."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    return {
        "parquet.writer.version": "v2", "parquet.block.size": str(row_group_bytes), "parquet.block.row.count.limit": str(row_group_rows), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "false", f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(),
    }


def write(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None, keep: tuple[str, ...] = (), **options) -> None:
    """Write the files of ``docs`` to a new folder.

    ``encoder()`` is called on the executors and gives the function from a text to its 16-bit ids. ``keep``: further
    columns stored with each document. ``options`` are those of ``layout``.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    own = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("none"), *keep).alias("kept")]
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = docs.select(*own).repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order).select("id", "text", "kept")
    types = spark.createDataFrame([], f"id {kinds[id_col]}, n_tokens long, before long, file int, ids array<int>, kept {dict(dealt.dtypes)['kept']}").schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, before, file = made(encoder), np.uint16(end_id).tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            raw = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // 2 for x in raw], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.uint16).astype(np.int32)))
            columns = [batch.column("id"), pa.array(n), pa.array(before + ends - n), pa.array(np.full(len(n), file, np.int32)), ids, batch.column("kept")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            before += int(ends[-1]) if len(ends) else 0

    out = dealt.mapInArrow(run, types)
    written(out.select(F.col("id").alias(id_col), "n_tokens", "before", "file", "ids", *[F.col(f"kept.{c}").alias(c) for c in keep]), "token-files", path=path, options=layout(**options))


def starts(files: DataFrame) -> DataFrame:
    """(file, base): the tokens in all files before each. One number a file goes through the driver."""
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    rows, total = [], 0
    for r in sorted(sums, key=lambda r: r["file"]):
        rows.append((r["file"], total))
        total += r["n"]
    return files.sparkSession.createDataFrame(rows, "file int, base long")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Each document's columns with ``start``, without its ids, which aren't read."""
    files = spark.read.parquet(path).drop("ids")
    return files.join(F.broadcast(starts(files)), "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "file")


def read(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """Each document with ``start`` and its ids. ``condition``: an expression over the stored columns, pushed to the scan, whose pages are skipped by it."""
    files = spark.read.parquet(path)
    base = starts(files)
    rows = files.where(condition) if condition else files
    return rows.join(F.broadcast(base), "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "file")


def with_crc32(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of documents read back: the checksum of their ids as little-endian unsigned 32-bit numbers."""
    kind = dict(rows.dtypes)[id_col]
    crc = lambda b: {"id": b["id"], "start": b["start"], "n_tokens": list(map(len, b["ids"])), "ids_crc32": [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in b["ids"]]}
    out = arrow_map(rows.select(F.col(id_col).alias("id"), "start", "ids"), lambda: crc, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
