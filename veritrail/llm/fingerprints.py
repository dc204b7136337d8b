"""Canonical exact digests of documents.

A text is canonicalised (Unicode NFKC, case folding, runs of white space folded to one space, ends trimmed) and hashed
with 128-bit xxHash. Documents with one digest are then compared by their canonical bytes: a grouping on (digest,
bytes) combines copies before the shuffle, so a group that holds a third of all rows costs one row per task. Should two
different canonical texts ever share a digest, the digests of that bucket get a suffix that tells them apart.

Defined cases: a null text is the empty text; empty and all-blank texts share one fingerprint; repeated rows and ties
give equal fingerprints; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, to_arrow


def canonical(text: str | None) -> bytes:
    """The canonical bytes that decide whether two texts are the same."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def check(canon: bytes) -> str:
    """What tells texts of one digest apart in the fingerprint, if ever needed."""
    return hashlib.sha256(canon).hexdigest()[:16]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, suffix, canon): canon is the compressed canonical text, equal if and only if the bytes are."""

    def make():
        pack = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress

        def step(rows):
            canon = [canonical(t) for t in rows["text"]]
            return {"id": rows["id"], "digest": [digest(c) for c in canon], "suffix": [check(c) for c in canon], "canon": [pack(c) for c in canon]}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, digest string, suffix string, canon binary").withColumnRenamed("id", id_col)


def collisions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests that more than one canonical text has, found by comparing bytes inside each bucket."""
    texts = digests(docs.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col).groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def settle(rows: DataFrame, clash: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Fingerprint columns from (digest, suffix) columns: the digest, with the suffix where the digest is in ``clash``.

    ``clash`` is looked up by an ordinary join, and only if it has rows at all.
    """
    if clash.isEmpty():
        return rows.withColumns({out: F.col(d) for out, (d, _) in columns.items()})
    for out, (d, s) in columns.items():
        hit = clash.select(F.col("digest").alias("_clash"))
        rows = rows.join(hit, rows[d] == hit["_clash"], "left").withColumn(out, F.when(F.col("_clash").isNull(), F.col(d)).otherwise(F.concat_ws("-", d, s))).drop("_clash")
    return rows


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): equal fingerprints if and only if the canonical texts are equal."""
    rows = digests(docs, id_col, text_col).drop("canon")
    return settle(rows, collisions(docs, text_col), {"fingerprint": ("digest", "suffix")}).select(id_col, "fingerprint")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside the next by ascending id (the last: the first), and what an edit that mixes the two gives.

    The rows are dealt by ranges of the id. The first row of a range is also sent to the range before, so a task has
    the successors of all its rows; no window over the whole table is needed. Null ids come first, ties go by text.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(text_col).alias("text"))
    ranges = 4 * partitions(spark)
    bounds = sorted({int(q) for q in rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    rows = rows.withColumn("part", _range_of(bounds).cast("int"))
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not firsts:
        firsts = [(0, 0)]
    heads = spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "key long, part int")
    copies = rows.drop("part").join(F.broadcast(heads), "key").select("id", "key", "text", "part", F.lit(True).alias("head"))
    packed = _pack_text(rows.select("id", "key", "text", "part", F.lit(False).alias("head")).unionByName(copies), kind)
    dealt = packed.repartition(partitions(spark), "part").sortWithinPartitions("part", "head", "key", "packed")
    schema = f"id {kind}, n_chars long, edited_sha256 string, digest string, suffix string, edited_digest string, edited_suffix string, near_edited double, near_next double"
    types = spark.createDataFrame([], schema).schema
    arrow = to_arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        before = None
        for batch in batches:
            out = {n: [] for n in arrow.names}
            for i, part, head, z in zip(*(batch.column(n).to_pylist() for n in ("id", "part", "head", "packed")), strict=True):
                if head and (before is None or before[0] != part):
                    continue
                text = unpack(z).decode("utf-8", "surrogatepass")
                canon = canonical(text)
                if before is not None and before[0] == part:
                    _, own_id, own, own_canon = before
                    n = len(own)
                    edited = own[: n - n // 4] + text[: n // 4]
                    changed = canonical(edited)
                    for name, value in zip(arrow.names, (own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(own_canon), check(own_canon), digest(changed), check(changed), float(own_canon == changed), float(own_canon == canon)), strict=True):
                        out[name].append(value)
                before = None if head else (part, i, text, canon)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return dealt.mapInArrow(run, types).withColumnRenamed("id", id_col)


def _range_of(bounds: list[int]):
    """Index of the range of ``key``: a constant sorted array, searched by halving."""

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"if(key <= {bounds[mid]}L, {search(low, mid)}, {search(mid + 1, high)})"

    return F.expr(search(0, len(bounds)))


def _pack_text(rows: DataFrame, kind: str) -> DataFrame:
    """Compressed texts, to move fewer bytes."""

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def step(cols):
            return {**{n: cols[n] for n in ("id", "key", "part", "head")}, "packed": [pack((t or "").encode("utf-8", "surrogatepass")) for t in cols["text"]]}

        return step

    return arrow_map(rows, make, f"id {kind}, key long, part int, head boolean, packed binary")
