"""A maintained view equals the same query computed afresh, as a bag, with nulls equal."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.view import FULL, Naming, UnsupportedSQLError, compile_ivm, tables_named
from tidemark.sources.versioned import Catalog

SCHEMA = "k int, v int, s string, d int"
VIEWS = [
    "SELECT k + 1 AS x, upper(s) AS y FROM r WHERE v > 1",
    "SELECT s, SUM(v) AS a, COUNT(*) AS b, AVG(v) AS c, COUNT(v) + 1 AS e, MIN(d) AS lo, MAX(v) AS hi FROM r GROUP BY s",
    "SELECT SUM(v) AS a, COUNT(*) AS b FROM r",
    "SELECT DISTINCT k, s FROM r",
    "SELECT a.k, b.v, p.s FROM r a JOIN r b ON a.k = b.v JOIN q p ON b.k = p.k WHERE a.d > 1",
    "SELECT q.s, SUM(r.v) AS a, COUNT(r.k) AS n FROM q LEFT JOIN r ON r.k = q.k AND r.d > 2 GROUP BY q.s",
    "SELECT r.k, q.s FROM r FULL OUTER JOIN q ON r.k = q.k",
    "SELECT * FROM r WHERE k NOT IN (SELECT k FROM q)",
    "SELECT k, (SELECT COUNT(*) FROM q WHERE q.k = r.k) AS n FROM r WHERE EXISTS (SELECT 1 FROM q WHERE q.v = r.v) OR d > 5",
    "SELECT k FROM r EXCEPT ALL SELECT k FROM q",
    "SELECT k, SUM(d) OVER (PARTITION BY s) AS t FROM r",
]


def batch(rng, n):
    hole = lambda x: None if rng.random() < 0.2 else x
    return [(hole(rng.randint(1, 4)), hole(rng.randint(1, 4)), hole(rng.choice("ab")), rng.randint(0, 9)) for _ in range(n)]


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def cycles(spark, tmp_path_factory):
    """Two tables, their versions after three batches of changes each, and the catalog."""
    rng = random.Random(5)
    catalog = Catalog(spark, "dl", str(tmp_path_factory.mktemp("cat")))
    for t in ("r", "q"):
        catalog.create(t, spark.createDataFrame(batch(rng, 10), SCHEMA))
    start = catalog.latest_version()
    catalog.table("r").insert(spark.createDataFrame(batch(rng, 3), SCHEMA))
    first = catalog.latest_version()
    for t in ("r", "q"):
        held = catalog.table(t).as_of().collect()
        catalog.table(t).delete(spark.createDataFrame(rng.sample(held, 4), SCHEMA))
        catalog.table(t).insert(spark.createDataFrame(batch(rng, 3), SCHEMA))
    catalog.table("r").update("d > 4", {"v": F.col("v") + 1})
    return catalog, start, first


@pytest.mark.parametrize("sql", VIEWS)
def test_maintained_equals_recomputed(spark, tmp_path, cycles, sql):
    catalog, start, first = cycles
    views = Catalog(spark, "views", str(tmp_path))
    view = compile_ivm(sql, spark=spark, catalogs={"dl": catalog, "views": views}, mv_catalog="views", sources={t: {"catalog": "dl"} for t in "rq"})
    assert view.strategy == "incremental"
    view.create({"dl": start})
    for to in (first, catalog.latest_version()):
        view.maintain({"dl": to})
        assert bag(view.query_mv()) == bag(view.recompute({"dl": to}))
    assert view.pending() == 0 and view.maintain() is None


def test_full_refresh_stores_only_what_changed(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(i, i % 10) for i in range(40)], "k int, g int"))
    view = compile_ivm("SELECT g, COUNT(*) AS n FROM t GROUP BY g", spark=spark, catalogs={"dl": catalog}, strategy=FULL)
    view.create()
    catalog.table("t").delete_where("k = 3")
    version = view.maintain()
    assert view.strategy == FULL and view.fallback_reason == "forced" and "full_refresh" in view.features
    assert view.table.changes(version, version).count() == 2


def test_rejected_sql(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(1, 2)], "a int, b int"))
    for sql, code in [("SELECT 1 AS x", "no_table"), ("SELECT a FROM t WHERE rand() < 0.5", "non_deterministic"), ("SELECT a, current_date() AS d FROM t", "non_deterministic"), ("SELECT a FROM t HAVING a > 1", "having_no_agg"), ("SELEC a FROM t", "syntax")]:
        with pytest.raises(UnsupportedSQLError) as e:
            compile_ivm(sql, spark=spark, catalogs={"dl": catalog})
        assert e.value.code == code
    view = compile_ivm("SELECT a FROM t ORDER BY a LIMIT 1", spark=spark, catalogs={"dl": catalog})
    assert (view.strategy, view.fallback_reason) == (FULL, "limit")
    assert compile_ivm("SELECT a, SUM(b) AS s FROM t WHERE b > 0 GROUP BY a", spark=spark, catalogs={"dl": catalog}).features == {"select", "where", "group_by", "sum"}


def test_incremental_aggregate_reads_no_base_table_again(spark, tmp_path):
    """The merge rule adds the change to stored sums: after maintenance no file of the first version has been read."""
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, v int"))
    view = compile_ivm("SELECT g, SUM(v) AS s FROM t GROUP BY g", spark=spark, catalogs={"dl": catalog})
    view.create()
    old, now = view.cursors(), catalog.table("t").insert(spark.createDataFrame([(1, 5)], "g int, v int"))
    catalog.scratch = lambda df, made: df  # plans are seen whole
    changes = view._incremental(old, {"dl": now}, [("dl", "main.t")], [])
    plans = "".join(d._jdf.queryExecution().optimizedPlan().toString() + " ".join(d.inputFiles()) for d in changes.values())
    assert catalog.table("t")._base_path(1) not in plans


EXTREMES = [
    "SELECT s, MIN(d) AS lo, MAX(d) AS hi, MIN(s) AS first, COUNT(*) AS n FROM r GROUP BY s",
    "SELECT MIN(v) AS lo, MAX(d) AS hi, COUNT(*) AS n, SUM(v) AS total, AVG(v) AS mean FROM r",
    "SELECT MAX(a.d) AS hi, MIN(b.d) AS lo, COUNT(*) AS n FROM r a JOIN q b ON a.k = b.k",
]


@pytest.mark.parametrize("sql", EXTREMES)
def test_extremes_are_merged_through_deletes_and_an_empty_table(spark, tmp_path, sql):
    """Rows with and without an extreme go, some come and go within a cycle, all go, and some come again."""
    catalog = Catalog(spark, "dl", str(tmp_path))
    first = [(1, 1, "a", 5), (1, 2, "a", 1), (2, 3, "a", 9), (2, None, "b", 4), (1, 1, "b", 4), (None, 1, None, 7)]
    for t in ("r", "q"):
        catalog.create(t, spark.createDataFrame(first, SCHEMA))
    view = compile_ivm(sql, spark=spark, catalogs={"dl": catalog})
    assert view.strategy == "incremental" and view._parts()[2] is not None
    view.create()
    rounds = [
        (["s = 'a' AND d = 5"], [(1, 4, "a", 3)]),
        (["d = 9 OR d = 1"], []),
        ([], [(1, 4, "a", 99)]),
        (["d = 99"], [(7, 7, "z", 0), (7, 7, "z", 8)]),
        (["true"], []),
        ([], [(1, 1, "a", 2), (1, 5, None, 6)]),
    ]
    for gone, come in rounds:
        if come:
            catalog.table("r").insert(spark.createDataFrame([*come, (3, 3, "a", -50)], SCHEMA))
            catalog.table("r").delete_where("d = -50")
        for condition in gone:
            catalog.table("r").delete_where(condition)
        view.maintain()
        assert bag(view.query_mv()) == bag(view.recompute()), (gone, come)
    assert catalog.files.names(f"{catalog.root}/_scratch") == []


def test_global_aggregate_reads_no_base_table_again(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, v int"))
    view = compile_ivm("SELECT SUM(v) AS s, MAX(v) AS hi, COUNT(*) AS n FROM t", spark=spark, catalogs={"dl": catalog})
    view.create()
    catalog.scratch = lambda df, made: df
    for change in (lambda t: t.insert(spark.createDataFrame([(1, 5)], "g int, v int")), lambda t: t.delete_where("v = 3")):
        old, now = view.cursors(), change(catalog.table("t"))
        changes = view._incremental(old, {"dl": now}, [("dl", "main.t")], [])
        plans = "".join(d._jdf.queryExecution().optimizedPlan().toString() + " ".join(d.inputFiles()) for d in changes.values())
        assert catalog.table("t")._base_path(1) not in plans
        view.catalog.commit(changes, cursors={view._cursor("dl"): now})


def test_names_are_taken_from_the_parsed_query(spark, tmp_path):
    found = tables_named(spark, "WITH own AS (SELECT a FROM t) SELECT 'FROM lit' AS x, own.a AS col FROM own JOIN dl.main.u ON EXISTS (SELECT 1 FROM s.v WHERE v.a IN (SELECT b FROM w)) -- FROM comment")
    assert found == {("t",), ("dl", "main", "u"), ("s", "v"), ("w",)}
    assert tables_named(spark, "SELEC 1") is None
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(1, "dl.main.t")], "a int, s string"))
    view = compile_ivm("SELECT a FROM dl.main.t WHERE s = 'dl.main.t'", spark=spark, catalogs={"dl": catalog})
    view.create()
    assert view.query_mv().count() == 1


class Other(Naming):
    def mv_table(self):
        return f"mv_{self.view}"

    def state_table(self):
        return f"_state_hidden_{self.view}"

    def cursors_table(self):
        return "my_cursors"

    def aux_column(self, purpose):
        return f"aux_{purpose}"


def test_names_chosen_by_a_project(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path))
    catalog.create("t", spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, v int"))
    view = compile_ivm("SELECT g, SUM(v) AS s, MIN(v) AS lo, COUNT(v) AS n FROM t GROUP BY g", spark=spark, catalogs={"dl": catalog}, name="sums", naming=Other("sums"))
    view.create()
    catalog.table("t").delete_where("v < 4")
    view.maintain()
    assert catalog.tables() == ["main._state_hidden_sums", "main.mv_sums", "main.t"]
    assert all(c.startswith("aux_") for c in catalog.table("_state_hidden_sums").as_of().columns)
    assert bag(view.query_mv()) == bag(view.recompute())
    view.show_cursors()
    assert spark.table("my_cursors").first()["last_snapshot"] == catalog.table("t").catalog.cursors()[view._cursor("dl")]
