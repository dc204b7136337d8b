"""Every registered query against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from veritrail.plans import catalog, comparisons, documents, extraction, goals, mutants, packs, reviews, shapes, studies  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple("" if v is None else round(v, 3) if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    spark.sparkContext.setCheckpointDir("/tmp/veritrail-tests")
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(map(plain, got.select(*names).collect()), key=str)
    b = sorted(map(plain, want.fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b


def test_short_quotes_are_found(spark, tmp_path):
    texts = ["one two three four five six seven eight", "xone two three four five six seven, eight", "one", "tone two", "a  b\nc d", "", "six seven eightfold nine"]
    quotes = ["one two three four five six seven", "ne two th", "one", "six seven eight", "a  b", "b\nc", "", "two three", "three four five six seven, eight", "absent"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.QUERIES["tx_11"](spark, str(tmp_path)).select("item_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(i, j) for i, q in enumerate(quotes) for j, t in enumerate(texts) if q in t]


def test_reach_goes_on_to_the_end_of_long_chains(spark):
    from veritrail.operators import graph

    spark.sparkContext.setCheckpointDir("/tmp/veritrail-tests")
    edges = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(70)] + [(1, "70", "3")], "package_id long, s string, o string").coalesce(1).cache()
    starts = spark.createDataFrame([(1, "0")], "package_id long, node string").coalesce(1)
    assert sorted(int(r.node) for r in graph.reach(starts, edges).collect()) == list(range(71))


def same_rows(spark, duck, name, folder):
    got = catalog.QUERIES[name](spark, folder)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.fetchall()))


def test_bounds_of_equal_neighbours_include_their_value(spark, tmp_path):
    prices = [(f"b{n}", round(900 + p / 10, 1)) for n in range(20, 60) for p in range(n) for _ in range(3)]
    parts = [(i, b, "ECONOMY", 5, p) for i, (b, p) in enumerate(prices)]
    lines = [(i, 1, i, 1, "N", p, 1.0, 0.0, 0.0) for i, (_, p) in enumerate(prices)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_extendedprice double, l_quantity double, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    own = duckdb.connect()
    for t in ("part", "lineitem"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert same_rows(spark, own, "drv_9", str(tmp_path))


def test_chunks_are_cut_without_the_spaces_of_any_script(spark, tmp_path):
    texts = [" " * 3 + "a" * 39, "　" + "a" * 40 + "  ", "b" * 298 + " " * 5, "\t" + "c" * 39, "d" * 601 + "\r", " " * 50, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(spark, own, "tx_22", str(tmp_path))
