"""Sums over joins that are made from sums of the joined sides."""

import random
import threading

import pytest

from tidemark.plans.view import Factors, compile_ivm
from tidemark.sources.versioned import Catalog


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_join_of_a_trillion_rows_is_summed_up(spark, tmp_path):
    dl = Catalog(spark, "dl", str(tmp_path))
    a = dl.create("a", spark.range(1_000_000).selectExpr("id % 2 AS k", "CAST(id % 1000 AS DECIMAL(18,2)) / 4 AS v").selectExpr("k", "CAST(v AS DECIMAL(18,2)) AS v"))
    b = dl.create("b", spark.range(1_000_000).selectExpr("id % 2 AS k", "id % 5 AS h"))
    view = compile_ivm("SELECT b.h, SUM(a.v) AS s, COUNT(*) AS n FROM a JOIN b ON a.k = b.k GROUP BY b.h", spark=spark, catalogs={"dl": dl}, name="sums")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)  # rather than not to end
    stop.start()
    try:
        view.create()
        a.delete_where("k = 1 AND v < 100")
        b.insert(spark.range(10).selectExpr("CAST(NULL AS BIGINT) AS k", "id AS h"))
        b.insert(spark.range(10).selectExpr("id % 2 AS k", "CAST(7 AS BIGINT) AS h"))
        view.maintain()
        got = bag(view.query_mv())
    finally:
        stop.cancel()
    one = a.as_of().groupBy("k").agg({"v": "sum"}).toDF("k", "s").join(a.as_of().groupBy("k").count(), "k")
    other = b.as_of().groupBy("k", "h").count().withColumnRenamed("count", "m")
    want = one.join(other, "k").selectExpr("h", "s * m AS s", "count * m AS n").groupBy("h").agg({"s": "sum", "n": "sum"}).selectExpr("h", "CAST(`sum(s)` AS DECIMAL(28,2))", "`sum(n)`")
    assert got == bag(want) and len(got) == 6


VIEWS = [
    "SELECT b.h, SUM(a.v) AS s, SUM(b.x) AS t, COUNT(a.v) AS m, COUNT(*) AS n, AVG(b.x) AS mean FROM a JOIN b ON a.k = b.k GROUP BY b.h",
    "SELECT a.g, c.z, SUM(b.x) AS t, COUNT(*) AS n FROM a JOIN b ON a.k = b.k JOIN c ON b.h = c.h GROUP BY a.g, c.z",
    "SELECT COUNT(*) AS n, SUM(a.v) AS s, SUM(c.z) AS z FROM a JOIN b ON a.k = b.k AND a.g = b.h JOIN c ON b.h = c.h",
    "SELECT c.z, SUM(a.v) AS s FROM a CROSS JOIN c GROUP BY c.z HAVING SUM(a.v) > 0",
    "SELECT a.g, COUNT(*) AS n FROM a JOIN b ON a.k <=> b.k WHERE b.x IS NOT NULL GROUP BY a.g",
    "SELECT p.g, SUM(q.v) AS s, COUNT(*) AS n FROM a p JOIN a q ON p.k = q.k GROUP BY p.g",
]
#: Read both sides in one aggregate or group key, or join by more than equality: these are computed row by row.
WHOLE = [
    "SELECT a.g + b.h AS gh, COUNT(*) AS n FROM a JOIN b ON a.k = b.k GROUP BY a.g + b.h",
    "SELECT b.h, SUM(a.g * b.x) AS s FROM a JOIN b ON a.k = b.k GROUP BY b.h",
    "SELECT b.h, COUNT(*) AS n FROM a JOIN b ON a.k = b.k AND a.g < b.x GROUP BY b.h",
]


@pytest.mark.parametrize("sql", [*VIEWS, *WHOLE])
def test_sums_equal_a_fresh_computation(spark, tmp_path, sql):
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    dl = Catalog(spark, "dl", str(tmp_path))
    rows = lambda n: spark.createDataFrame([(some(4), some(3), rng.choice([None, str(rng.randint(-999, 999) / 100)])) for _ in range(n)], "k int, g int, v string").selectExpr("k", "g", "CAST(v AS DECIMAL(18,2)) AS v")
    more = lambda n: spark.createDataFrame([(some(4), some(3), some(9)) for _ in range(n)], "k int, h int, x int")
    a, b, c = dl.create("a", rows(40)), dl.create("b", more(30)), dl.create("c", spark.createDataFrame([(0, 1), (0, 2), (1, 2), (None, 3)], "h int, z int"))
    view = compile_ivm(sql, spark=spark, catalogs={"dl": dl}, name="sums")
    _, _, merge = view._parts()
    assert merge and bool(Factors.of(merge, None)) == (sql in VIEWS)
    view.create()
    assert bag(view.query_mv()) == bag(view.recompute())
    assert view.query_mv().schema.simpleString() == view.recompute().schema.simpleString()
    a.insert(rows(10))
    b.delete_where("x > 5 OR k = 1")
    c.insert(spark.createDataFrame([(2, 9)], "h int, z int"))
    view.maintain()
    assert bag(view.query_mv()) == bag(view.recompute())
    a.delete_where("true")
    view.maintain()
    assert bag(view.query_mv()) == bag(view.recompute())
