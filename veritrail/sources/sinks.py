"""Sinks whose bytes depend on the rows alone: snapshots of packages, and bundles of files with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` without it; other paths stay."""
    start = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(start)), F.substring(path, len(start) + 1, F.length(path))).otherwise(path)


def snapshot(findings: DataFrame, violations: DataFrame, key: str = "package_id", volatile: tuple[str, ...] = (), root: str | None = None, path_col: str | None = None) -> DataFrame:
    """(key, snapshot, digest): one JSON document a package, equal for equal findings in whatever order they come.

    Findings are sorted by pattern, node and the rest, violations by severity, path, focus node and the rest. Columns in
    ``volatile`` (times, run ids) are left out, null fields aren't written, and ``path_col`` is given relative to ``root``.
    """

    def listed(rows: DataFrame, name: str, first: list[str]) -> DataFrame:
        if path_col in rows.columns and root:
            rows = rows.withColumn(path_col, relative(F.col(path_col), root))
        rest = sorted(c for c in rows.columns if c not in (key, *volatile, *first))
        fields = [c for c in first if c in rows.columns] + rest
        return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    both = listed(findings, "firings", ["pattern_id", "node"]).join(listed(violations, "violations", ["severity", "path", "focus_node"]), key, "full_outer")
    text = F.to_json(F.struct(key, "firings", "violations"), {"ignoreNullFields": "true"})
    return both.select(key, text.alias("snapshot"), F.sha2(text, 256).alias("digest"))


#: Most lines, about, of a piece of a bundle's file.
LINES = 100_000


def write_bundle(rows: DataFrame, path: str, files: int, lines: int = LINES, compression: str = "none", total: int | None = None) -> DataFrame:
    """Write rows as JSON lines into ``files`` numbered folders and return the manifest that is written beside them.

    What is a file to the manifest lies in pieces of about ``lines`` lines, as many as the number of rows asks for, so
    that neither the task that sorts a piece nor the one that digests it grows with the rows. A line's folder and piece
    follow from its values alone, and lines are sorted within a piece, so equal rows give equal bytes however they are
    dealt out before; with a ``compression`` (``gzip``) too. Rows are shuffled as they are and become lines afterwards.
    A line is small; pieces are even, whatever key a third of the rows share. ``total``: how many rows there are, if known.
    """
    names = sorted(rows.columns)
    pieces = max(1, -(-(rows.count() if total is None else total) // (files * lines)))
    place = F.pmod(F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in names]), F.lit(files * pieces))
    dealt = rows.select(*names, F.floor(place / pieces).cast("int").alias("_bucket"), (place % pieces).cast("int").alias("_piece")).repartition(files * pieces, "_bucket", "_piece")
    line = dealt.select(F.to_json(F.struct(*names), {"ignoreNullFields": "true"}).alias("value"), F.col("_bucket").alias("bucket"), F.col("_piece").alias("piece"))
    line = line.sortWithinPartitions("bucket", "piece", "value")
    line.write.partitionBy("bucket", "piece").option("maxRecordsPerFile", 0).option("compression", compression).text(f"{path}/rows")
    found = manifest(rows.sparkSession, path)
    found.coalesce(1).sortWithinPartitions("bucket").write.json(f"{path}/manifest")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, lines, bytes, sha256) of a bundle's files as they lie there: the digest of the one piece, or that of all pieces' digests in order. A piece is one row here; the lines of those that are compressed are counted as they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/rows")
    text = F.col("content").cast("string")
    plain = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    place = lambda name, path="path": F.regexp_extract(path, f"{name}=([0-9]+)", 1).cast("int").alias(name)
    each = files.select(place("bucket"), place("piece"), F.when(F.endswith("path", F.lit(".txt")), plain).otherwise(0).cast("long").alias("lines"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    digests = F.transform(F.sort_array(F.collect_list(F.struct("piece", "sha256"))), lambda x: x["sha256"])
    whole = each.groupBy("bucket").agg(F.sum("lines").alias("plain"), F.sum("bytes").alias("bytes"), digests.alias("digests"))
    more = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt.*").text(f"{path}/rows")
    more = more.groupBy(place("bucket", "_metadata.file_path")).agg(F.count("*").alias("packed"))
    whole = whole.join(F.broadcast(more), "bucket", "left").withColumn("lines", F.col("plain") + F.coalesce("packed", F.lit(0)))
    return whole.select("bucket", "lines", "bytes", F.when(F.size("digests") == 1, F.col("digests")[0]).otherwise(F.sha2(F.concat_ws("", "digests"), 256)).alias("sha256"))


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, state) of the files that aren't what the manifest says: missing, extra or changed."""
    told = spark.read.schema("bucket int, lines long, bytes long, sha256 string").json(f"{path}/manifest").select("bucket", F.col("sha256").alias("told"))
    both = told.join(manifest(spark, path).select("bucket", F.col("sha256").alias("found")), "bucket", "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "extra").when(F.col("told") != F.col("found"), "changed")
    return both.select("bucket", state.alias("state")).where("state IS NOT NULL")


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a bundle."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{path}/rows")
