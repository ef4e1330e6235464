import asyncio

import pytest
from pyspark.sql import functions as F

from tidemark.cli import main
from tidemark.functions.upkeep import pending_maintenance, safe_to_expire
from tidemark.operators.bag import signed
from tidemark.orchestrator import CatalogNotFoundError, CyclicDependencyError, MissingColumnError, MissingTableError, Orchestrator
from tidemark.project import InvalidSetupError, MissingCatalogsError, MissingSetupError, MVCompilationError, load_directory
from tidemark.sources.plugins import Effector, FlushResult, Sink, Source, SyncResult
from tidemark.sources.versioned import Catalog
from tidemark.streaming.watch import change_stream, maintain_on_change, watch

ORDERS = [(1, 100, "east"), (2, 200, "west"), (3, 150, "east")]
TOTALS = "SELECT region, SUM(amount) AS total FROM orders GROUP BY region"


@pytest.fixture
def made(spark, tmp_path):
    o = Orchestrator(spark)
    o.add_catalog("dl", str(tmp_path / "data")).create("orders", spark.createDataFrame(ORDERS, "id int, amount int, region string"))
    o.add_ivm("dl", "totals", TOTALS)
    o.add_ivm("dl", "big", "SELECT region FROM totals WHERE total > 240")
    return o


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def change(spark, o):
    t = o.catalogs["dl"].table("orders")
    t.insert(spark.createDataFrame([(4, 300, "west")], "id int, amount int, region string"))
    t.delete_where("id = 1")


def test_chain_reports_and_both_ways_to_advance(spark, made):
    made.verify()
    made.initialize()
    made.initialize()
    assert rows(made.catalogs["dl"].table("big").as_of()) == [("east",)]
    assert made.tree().splitlines() == ["dl (catalog)", "  main.orders (base table)", "  dl.main.totals (MV)", "  dl.main.big (MV)"]
    change(spark, made)
    assert [(s.view, s.level, s.pending_snapshots, s.pending_rows) for s in made.get_maintenance_plan("rows_changed").steps] == [("dl.main.totals", 0, 2, 2), ("dl.main.big", 1, 0, 0)]
    assert rows(pending_maintenance(spark, made.views.values()))[1] == ("dl", "totals", "dl", 2)
    assert made.advance_one().result().view == "dl.main.totals"
    assert asyncio.run(made.advance_one_async()).view == "dl.main.big"
    assert made.advance_one() is None
    assert rows(made.catalogs["dl"].table("totals").as_of()) == [("east", 150), ("west", 500)]
    assert rows(made.catalogs["dl"].table("big").as_of()) == [("west",)]
    assert all(s.skipped for s in made.maintain(parallelism=2))
    low = safe_to_expire(spark, made.views.values()).first()
    assert low["min_required_snapshot"] <= low["latest_snapshot"]
    assert safe_to_expire(spark, []).count() == 0


def test_errors(spark, made, tmp_path):
    made.add_ivm("nowhere", "x", "SELECT 1 AS a FROM orders")
    with pytest.raises(CatalogNotFoundError):
        made.verify()
    for sql, error in (("SELECT a FROM missing", MissingTableError), ("SELECT nope FROM orders", MissingColumnError)):
        o = Orchestrator(spark)
        o.add_catalog("dl", made.catalogs["dl"])
        o.add_ivm("dl", "x", sql)
        with pytest.raises(error):
            o.verify()
    o = Orchestrator(spark)
    o.add_catalog("dl", made.catalogs["dl"])
    o.add_ivm("dl", "one", "SELECT id FROM two")
    o.add_ivm("dl", "two", "SELECT id FROM one")
    with pytest.raises(CyclicDependencyError):
        o.levels()


class Fill(Source):
    def setup(self, spark, catalog):
        if not catalog.has(self.table):
            catalog.create(self.table, spark.createDataFrame([], "id int, name string"))

    def sync(self, spark, catalog):
        catalog.table(self.table).insert(spark.createDataFrame([(self.options, "n")], "id int, name string"))
        return SyncResult(rows_inserted=1)


class Keep(Sink):
    def __init__(self, *args, batched=True):
        super().__init__(*args, options={"to": "memory"})
        self.batched, self.seen = batched, []
        assert self.fqn == f"dl.main.{self.table}" and self.options["to"] == "memory"

    def flush(self, changes):
        self.seen.append((changes.snapshot_start, changes.snapshot_end, sorted((r.change_type, r.id) for r in changes.changes().collect()), changes.current().count()))
        return FlushResult(1)


class Store(Effector):
    columns = [("source_id", "int"), ("result", "string")]
    on_error = "store"

    def handle_insert(self, row):
        if row["amount"] > 900:
            raise ValueError("too much")
        return None if row["amount"] < 10 else {"source_id": row["id"], "result": "in"}

    def handle_update(self, old, new):
        return {"source_id": new["id"], "result": f"{old['amount']}>{new['amount']}"}

    def handle_delete(self, row):
        return {"source_id": row["id"], "result": "out"}


def test_sources_sinks_effectors(spark, tmp_path):
    o = Orchestrator(spark)
    catalog = o.add_catalog("dl", str(tmp_path))
    o.add_source(Fill("dl", "names", 7))
    catalog.create("orders", spark.createDataFrame(ORDERS, "id int, amount int, region string"))
    o.add_ivm("dl", "east", "SELECT id, amount FROM orders WHERE region = 'east'")
    o.add_ivm("dl", "named", "SELECT name, COUNT(*) AS n FROM names GROUP BY name")
    one, each = Keep("dl", "orders"), Keep("dl", "east", batched=False)
    o.add_sink(one)
    o.add_sink(each)
    o.add_effector(Store("dl", "orders", "made"))
    o.initialize()
    assert rows(catalog.table("named").as_of()) == [("n", 1)]
    assert o.flush_sinks() == {"Keep_orders": [], "Keep_east": []}
    orders = catalog.table("orders")
    orders.insert(spark.createDataFrame([(4, 30, "east"), (5, 5, "east"), (6, 999, "west")], "id int, amount int, region string"))
    orders.update("id = 2", {"amount": F.lit(250)})
    orders.delete_where("id = 3")
    o.maintain()
    o.flush_sinks()
    assert len(one.seen) == 1 and len(one.seen[0][2]) == 6
    assert [x[2] for x in each.seen] == [[("delete", 3), ("insert", 4), ("insert", 5)]]
    found = o.flush_effectors()["Store_orders"]
    assert (found.rows_inserted, found.rows_skipped, found.rows_errored) == (4, 1, 1)
    assert rows(catalog.table("made").as_of()) == sorted([(4, "in", None), (None, None, "too much"), (2, "200>250", None), (3, "out", None)], key=repr)
    assert o.flush_effectors()["Store_orders"].rows_inserted == 0


def test_watch_and_stream(spark, made, tmp_path):
    made.initialize()
    change(spark, made)
    steps = [s for cycle in watch(made, interval=0, rounds=2) for s in cycle]
    assert [s.view for s in steps] == ["dl.main.totals", "dl.main.big"]
    change(spark, made)
    seen = []
    query = maintain_on_change(made, made.catalogs["dl"].table("orders"), str(tmp_path / "ck"), seen.extend, available_now=True)
    query.awaitTermination(60)
    assert any(not s.skipped for s in seen)
    assert rows(made.catalogs["dl"].table("totals").as_of()) == [("east", 150), ("west", 800)]


def project(folder, spark, view=TOTALS):
    (folder / "catalogs" / "dl" / "analytics").mkdir(parents=True)
    (folder / "setup.py").write_text(f"def catalogs():\n    return {{'dl': {str(folder / 'data')!r}}}\n")
    (folder / "catalogs" / "dl" / "order_totals.sql").write_text(view + ";\n")
    (folder / "catalogs" / "dl" / "analytics" / "regions.sql").write_text("SELECT DISTINCT region FROM orders")
    (folder / "catalogs" / "dl" / "notes.txt").write_text("not a view")


def test_projects_and_command_line(spark, tmp_path, capsys):
    with pytest.raises(MissingSetupError):
        load_directory(spark, tmp_path)
    project(tmp_path / "p", spark)
    first = load_directory(spark, tmp_path / "p", errors := [])
    assert len(errors) == 2 and isinstance(errors[0], MVCompilationError)
    first.catalogs["dl"].create("orders", spark.createDataFrame(ORDERS, "id int, amount int, region string"))
    assert sorted(load_directory(spark, tmp_path / "p").views) == ["dl.analytics.regions", "dl.main.order_totals"]
    assert main(["--project-dir", str(tmp_path / "p"), "plan"]) == 0
    assert main(["--project-dir", str(tmp_path / "p"), "maintain", "--plain"]) == 0
    assert "dl.main.order_totals: up to date" in capsys.readouterr().out
    assert main(["--project-dir", str(tmp_path / "p"), "watch", "--rounds", "1"]) == 0
    assert main(["--project-dir", str(tmp_path / "p"), "dev", "--rounds", "1", "--polling-interval", "0"]) == 0
    assert main(["--project-dir", str(tmp_path / "new"), "init"]) == 0
    assert main(["--project-dir", str(tmp_path / "none"), "plan"]) == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "setup.py").write_text("x = 1")
    with pytest.raises(InvalidSetupError):
        load_directory(spark, tmp_path / "bad")
    (tmp_path / "bad" / "setup.py").write_text("def catalogs():\n    return {}")
    with pytest.raises(MissingCatalogsError):
        load_directory(spark, tmp_path / "bad")


def test_a_stream_sees_committed_versions_only(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path / "data"))
    table = catalog.create("orders", spark.createDataFrame(ORDERS, "id int, amount int, region string"))
    table.insert(spark.createDataFrame([(4, 1, "east")], "id int, amount int, region string"))
    catalog.stage("main.orders", signed(spark.createDataFrame([(99, 1, "lost")], "id int, amount int, region string")))  # never committed
    seen = []

    def run(fail=False):
        def handle(changes, start, end):
            seen.extend((r.change_type, r.id) for r in changes.collect())
            if fail:
                raise RuntimeError("stop")

        change_stream(table, "copy", str(tmp_path / "ck"), handle, available_now=True).awaitTermination(60)

    run()
    assert seen == [("insert", 4)]
    table.delete_where("id = 1")
    catalog.create("other", spark.createDataFrame([(1,)], "x int"))
    seen.clear()
    with pytest.raises(Exception, match="stop"):
        run(fail=True)
    run()
    assert seen == [("delete", 1)] * 2  # again after the failure
    run()
    assert len(seen) == 2


def test_output_and_cursor_of_an_effector_are_one_commit(spark, tmp_path, monkeypatch):
    o = Orchestrator(spark)
    catalog = o.add_catalog("dl", str(tmp_path))
    orders = catalog.create("orders", spark.createDataFrame(ORDERS, "id int, amount int, region string"))
    o.add_effector(Store("dl", "orders", "made"))
    o.initialize()
    orders.insert(spark.createDataFrame([(k, 50, "east") for k in range(10, 15)], "id int, amount int, region string"))
    monkeypatch.setattr("tidemark.orchestrator.OUTPUT_ROWS", 2)
    create = catalog.files.create
    monkeypatch.setattr(catalog.files, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        o.flush_effectors()
    assert catalog.table("made").as_of().count() == 0
    monkeypatch.setattr(catalog.files, "create", create)
    before = catalog.latest_version()
    assert o.flush_effectors()["Store_orders"].rows_inserted == 5
    assert catalog.latest_version() == before + 1 and catalog.table("made").as_of().count() == 5
    assert o.flush_effectors()["Store_orders"].rows_inserted == 0


def test_a_name_in_a_literal_or_a_column_is_no_dependency(spark, made):
    made.add_ivm("dl", "other", "SELECT id AS totals, 'FROM big' AS big FROM orders WHERE region <> 'totals'")
    assert made._reads("dl.main.other") == set() and made._reads("dl.main.big") == {"dl.main.totals"}
    assert made.levels() == [["dl.main.other", "dl.main.totals"], ["dl.main.big"]]


def test_verify_compiles_views_that_wait_for_no_source(spark, made):
    made.add_source(Fill("dl", "names", 7))
    made.add_ivm("dl", "named", "SELECT name FROM names")
    made.verify()
    assert set(made.views) == {"dl.main.totals"}  # names and totals are not there yet
    made.add_ivm("dl", "bad", "SELECT nope FROM orders")
    with pytest.raises(MissingColumnError):
        made.verify()
