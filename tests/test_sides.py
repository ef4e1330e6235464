"""Views that store the sides of their joins, and make the joined rows when they are read."""

import random

import pytest

from tidemark.plans.view import SIDES, UnsupportedSQLError, compile_ivm
from tidemark.sources.versioned import Catalog


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


VIEWS = [
    "SELECT a.v, b.h FROM a JOIN b ON a.k = b.k",
    "SELECT a.v + b.h AS x, c.z FROM a JOIN b ON a.k = b.k LEFT JOIN c ON b.h = c.h AND c.z < 3",
    "SELECT p.v AS one, q.v AS other FROM a p JOIN a q ON p.k = q.k AND p.v <= q.v WHERE p.v IS NOT NULL",
    "SELECT t.n, b.h FROM b JOIN (SELECT k, COUNT(*) AS n FROM a GROUP BY k) t ON t.k = b.k",
    "SELECT a.v FROM a LEFT ANTI JOIN c ON a.k = c.h",
    "SELECT a.k, c.z FROM a FULL OUTER JOIN c ON a.k = c.h",
]


@pytest.fixture(params=["10m", "0"])
def broadcast(request, spark):
    """With tables that are broadcast, and with none: then joins are dealt out."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("sql", VIEWS)
def test_rows_equal_a_fresh_computation(spark, tmp_path, broadcast, sql):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    dl = Catalog(spark, "dl", str(tmp_path))
    two = lambda n, names: spark.createDataFrame([(some(4), some(6)) for _ in range(n)], names)
    a, b, c = dl.create("a", two(30, "k int, v int")), dl.create("b", two(20, "k int, h int")), dl.create("c", two(5, "h int, z int"))
    view = compile_ivm(sql, spark=spark, catalogs={"dl": dl}, name="mv", stored=SIDES)
    assert not view.exists
    view.create()
    assert view.exists and bag(view.query_mv()) == bag(view.recompute())
    assert view.query_mv().schema.simpleString() == view.recompute().schema.simpleString()
    a.insert(two(10, "k int, v int"))
    b.delete_where("h > 3 OR k = 1")
    assert view.maintain() is not None
    c.insert(two(3, "h int, z int"))
    view.maintain()
    assert view.maintain() is None and bag(view.query_mv()) == bag(view.recompute())
    a.delete_where("true")
    view.maintain()
    assert bag(view.query_mv()) == bag(view.recompute())


def test_what_is_kept_does_not_grow_with_the_joined_rows(spark, tmp_path):
    dl = Catalog(spark, "dl", str(tmp_path))
    a = dl.create("a", spark.range(200_000).selectExpr("id % 2 AS k", "id AS v"))
    dl.create("b", spark.range(200_000).selectExpr("id % 2 AS k", "id AS h"))
    view = compile_ivm("SELECT a.v, b.h FROM a JOIN b ON a.k = b.k", spark=spark, catalogs={"dl": dl}, name="mv", stored=SIDES)
    view.create()  # of 2 * 10 ** 10 rows
    a.delete_where("v % 10 = 0")
    view.maintain()
    assert bag(view.query_mv().where("v IN (9, 10) AND h < 6")) == [(9, 1), (9, 3), (9, 5)]


def test_a_join_of_few_bytes_is_not_left_to_one_task(spark, tmp_path, broadcast):
    dl = Catalog(spark, "dl", str(tmp_path))
    dl.create("a", spark.range(300).selectExpr("0 AS k", "id AS v"))
    dl.create("b", spark.range(300).selectExpr("0 AS k", "id AS h"))
    view = compile_ivm("SELECT a.v, b.h FROM a JOIN b ON a.k = b.k", spark=spark, catalogs={"dl": dl}, name="mv", stored=SIDES)
    view.create()
    tasks = view.query_mv().selectExpr("spark_partition_id() AS p").distinct().count()
    assert view.query_mv().count() == 90_000 and (tasks > 1 or broadcast != "0")


def test_blocks_of_left_rows_lose_none_and_take_little_room(spark, tmp_path):
    """Of each key some left rows, from few to more than a block in each share; written, a pair takes some two bits."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "0")
    dl = Catalog(spark, "dl", str(tmp_path))
    held = [1, 7, 8, 9, 300, 1030, 2050, 2800]
    dl.create("a", spark.createDataFrame([(k, v) for k, n in enumerate(held) for v in range(n)], "k int, v int").selectExpr("k", "1000 * v + k AS v"))
    dl.create("b", spark.range(8 * 701).selectExpr("CAST(id % 8 AS INT) AS k", "1000003 * id AS h"))
    view = compile_ivm("SELECT a.v, b.h FROM a JOIN b ON a.k = b.k", spark=spark, catalogs={"dl": dl}, name="mv", stored=SIDES)
    view.create()
    view.query_mv().write.parquet(f"{tmp_path}/out")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 701 * sum(held)
    assert out.where("v % 1000 <> h / 1000003 % 8").isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * 701 * sum(held)


@pytest.mark.parametrize("sql", ["SELECT v FROM a", "SELECT a.k, COUNT(*) AS n FROM a JOIN b ON a.k = b.k GROUP BY a.k", "SELECT a.v FROM a JOIN b ON a.k = b.k LIMIT 3"])
def test_other_views_are_refused(spark, tmp_path, sql):
    dl = Catalog(spark, "dl", str(tmp_path))
    for name, other in (("a", "v"), ("b", "h")):
        dl.create(name, spark.createDataFrame([(1, 2)], f"k int, {other} int"))
    with pytest.raises(UnsupportedSQLError, match="stored_sides"):
        compile_ivm(sql, spark=spark, catalogs={"dl": dl}, name="mv", stored=SIDES)
