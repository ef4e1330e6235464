"""One query for each kind of view, maintained through a cycle over the sample tables, with its SQL.

The base tables start without the rows whose key is divisible by ten; then
these are inserted, and of the rows that were there those with key % 7 = 1 are
deleted. A query creates its view on the first state and maintains it to the
last, so its rows are those of the plain SELECT over `key % 10 = 0 OR key % 7 <> 1`.
Money is DECIMAL inside views, so sums are exact; some columns get nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.upkeep import pending_maintenance, safe_to_expire
from .operators.bag import signed
from .plans.view import FULL, ROWS, SIDES, MaterializedView, compile_ivm, tables_named
from .sources.versioned import Catalog
from .sources.workspace import workspace

#: name: (table of the data set, key, columns), in SQL that Spark and DuckDB share.
BASES = {
    "ords": ("orders", "o_orderkey", "o_orderkey, nullif(o_custkey % 1000, 7) AS custkey, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS priority, nullif(CAST(o_orderkey % 13 AS INT), 5) AS code"),
    "items": ("lineitem", "l_orderkey", "l_orderkey, l_partkey AS partkey, CAST(l_quantity AS INT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag AS flag, l_linestatus AS state"),
    "cust": ("customer", "c_custkey", "c_custkey, c_custkey % 1000 AS custkey, c_nationkey AS nationkey, nullif(c_mktsegment, 'BUILDING') AS segment"),
    "nat": ("nation", "n_nationkey", "n_nationkey AS nationkey, n_name AS nation, n_regionkey AS regionkey"),
    "reg": ("region", "r_regionkey", "r_regionkey AS regionkey, r_name AS region"),
    "sup": ("supplier", "s_suppkey", "s_suppkey, s_nationkey AS nationkey"),
    "docs": ("documents", "doc_id", "doc_id, lang, source, n_chars"),
    "labs": ("labels", "doc_id", "doc_id, quality, toxic"),
}

#: Views whose rows come from maintaining them; the SQL is the oracle's as well.
VIEWS = {
    "select_project_filter": "SELECT o_orderkey, price, status FROM ords WHERE code > 3",
    "projection_duplicates": "SELECT status, code FROM ords",
    "computed_projection": "SELECT o_orderkey + 1 AS k, upper(status) AS s, CASE WHEN code IS NULL THEN 'none' WHEN code > 6 THEN 'high' ELSE 'low' END AS band FROM ords",
    "agg_sum_count": "SELECT flag, state, CAST(SUM(qty) AS BIGINT) AS qty, CAST(SUM(price) AS DOUBLE) AS revenue, COUNT(*) AS n FROM items GROUP BY flag, state",
    "agg_avg": "SELECT flag, AVG(qty) AS mean_qty FROM items GROUP BY flag",
    "agg_min_max_delete": "SELECT custkey, MIN(price) AS low, MAX(price) AS high FROM ords GROUP BY custkey",
    "agg_count_col_nulls": "SELECT status, COUNT(code) AS known, COUNT(*) AS n, CAST(SUM(code) AS BIGINT) AS total FROM ords GROUP BY status",
    "agg_null_group": "SELECT code, COUNT(*) AS n FROM ords GROUP BY code",
    "agg_global": "SELECT COUNT(*) AS n, CAST(SUM(qty) AS BIGINT) AS qty, MAX(price) AS high FROM items",
    "agg_wrapped": "SELECT status, CAST(SUM(code) AS BIGINT) + COUNT(*) AS mixed FROM ords GROUP BY status",
    "agg_count_distinct": "SELECT flag, COUNT(DISTINCT partkey) AS parts FROM items GROUP BY flag",
    "having_sum": "SELECT custkey, CAST(SUM(price) AS DOUBLE) AS total FROM ords GROUP BY custkey HAVING SUM(price) > 200000",
    "having_count_hidden": "SELECT custkey FROM ords GROUP BY custkey HAVING COUNT(*) >= 3",
    "distinct_single": "SELECT DISTINCT status, priority FROM ords WHERE code IS NOT NULL",
    "distinct_group_by": "SELECT DISTINCT n FROM (SELECT custkey, COUNT(*) AS n FROM ords GROUP BY custkey) t",
    "join_two": "SELECT o.o_orderkey, c.c_custkey, c.segment FROM ords o JOIN cust c ON o.custkey = c.custkey",
    "join_two_where": "SELECT o.o_orderkey, c.nationkey FROM ords o JOIN cust c ON o.custkey = c.custkey WHERE o.code > 6 AND c.segment IS NOT NULL",
    "join_three": "SELECT o.o_orderkey, n.nation FROM ords o JOIN cust c ON o.custkey = c.custkey JOIN nat n ON c.nationkey = n.nationkey",
    "join_four": "SELECT r.region, CAST(SUM(o.price) AS DOUBLE) AS revenue, COUNT(*) AS n FROM ords o JOIN cust c ON o.custkey = c.custkey JOIN nat n ON c.nationkey = n.nationkey JOIN reg r ON n.regionkey = r.regionkey GROUP BY r.region",
    "join_self": "SELECT a.nation AS one, b.nation AS other FROM nat a JOIN nat b ON a.regionkey = b.regionkey AND a.nationkey < b.nationkey",
    "join_theta": "SELECT a.nationkey AS lo, b.s_suppkey AS hi FROM nat a JOIN sup b ON a.nationkey < b.nationkey",
    "join_cross": "SELECT n.nation, r.region FROM nat n CROSS JOIN reg r",
    "join_sum": "SELECT c.segment, CAST(SUM(o.price) AS DOUBLE) AS revenue, COUNT(*) AS n FROM ords o JOIN cust c ON o.custkey = c.custkey GROUP BY c.segment",
    "join_minmax": "SELECT c.nationkey, MIN(o.price) AS low, MAX(o.price) AS high FROM ords o JOIN cust c ON o.custkey = c.custkey GROUP BY c.nationkey",
    "left_join": "SELECT d.doc_id, d.lang, l.quality FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id",
    "left_join_where": "SELECT d.doc_id FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id WHERE l.quality IS NULL",
    "right_join": "SELECT l.doc_id AS labelled, d.doc_id, d.source FROM labs l RIGHT JOIN docs d ON d.doc_id = l.doc_id",
    "full_join": "SELECT a.doc_id AS one, b.doc_id AS other FROM (SELECT doc_id FROM labs WHERE quality = 1) a FULL OUTER JOIN (SELECT doc_id FROM docs WHERE lang = 'en') b ON a.doc_id = b.doc_id",
    "mixed_inner_left": "SELECT o.o_orderkey, c.segment, n.nation FROM ords o JOIN cust c ON o.custkey = c.custkey LEFT JOIN nat n ON c.nationkey = n.nationkey AND n.regionkey < 3",
    "outer_join_agg": "SELECT d.lang, COUNT(l.doc_id) AS labelled, COUNT(*) AS n FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "outer_join_distinct": "SELECT DISTINCT d.lang, l.toxic FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id",
    "in_semi": "SELECT doc_id, lang FROM docs WHERE doc_id IN (SELECT doc_id FROM labs WHERE toxic = 1)",
    "not_in_null_aware": "SELECT o_orderkey, code FROM ords WHERE code NOT IN (SELECT nationkey FROM nat WHERE regionkey = 1)",
    "in_under_or": "SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM labs WHERE toxic = 1) OR n_chars > 4000",
    "exists_correlated": "SELECT c.c_custkey FROM cust c WHERE EXISTS (SELECT 1 FROM ords o WHERE o.custkey = c.custkey AND o.code > 9)",
    "not_exists": "SELECT d.doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM labs l WHERE l.doc_id = d.doc_id)",
    "scalar_sum": "SELECT c.c_custkey, (SELECT CAST(SUM(o.price) AS DOUBLE) FROM ords o WHERE o.custkey = c.custkey) AS total FROM cust c",
    "scalar_count_zero": "SELECT d.doc_id, (SELECT COUNT(*) FROM labs l WHERE l.doc_id = d.doc_id) AS n FROM docs d",
    "two_scalars": "SELECT c.c_custkey, (SELECT COUNT(*) FROM ords o WHERE o.custkey = c.custkey) AS n, (SELECT MAX(p.price) FROM ords p WHERE p.custkey = c.custkey) AS high FROM cust c",
    "scalar_uncorrelated": "SELECT o_orderkey FROM ords WHERE price > (SELECT MAX(price) * 0.9 FROM ords)",
    "from_simple": "SELECT t.status AS s, t.price FROM (SELECT status, price, code FROM ords WHERE code > 2) t WHERE t.code < 9",
    "from_agg_filter": "SELECT t.custkey, t.n FROM (SELECT custkey, COUNT(*) AS n FROM ords GROUP BY custkey) t WHERE t.n > 2",
    "from_agg_join": "SELECT c.c_custkey, t.n FROM cust c JOIN (SELECT custkey, COUNT(*) AS n FROM ords GROUP BY custkey) t ON c.custkey = t.custkey",
    "with_nested_agg": "WITH t AS (SELECT custkey, COUNT(*) AS n FROM ords GROUP BY custkey) SELECT n, COUNT(*) AS customers FROM t GROUP BY n",
    "union_all": "SELECT code AS x FROM ords UNION ALL SELECT nationkey FROM cust UNION ALL SELECT nationkey FROM sup",
    "union_distinct": "SELECT code AS x FROM ords UNION SELECT nationkey FROM cust",
    "except_all": "SELECT code AS x FROM ords EXCEPT ALL SELECT nationkey FROM cust",
    "intersect_all": "SELECT code AS x FROM ords INTERSECT ALL SELECT nationkey FROM cust",
    "except_distinct": "SELECT nationkey AS x FROM cust EXCEPT SELECT code FROM ords",
    "intersect_distinct": "SELECT code AS x FROM ords INTERSECT SELECT nationkey FROM cust",
    "union_of_aggregates": "SELECT status AS name, COUNT(*) AS n FROM ords GROUP BY status UNION ALL SELECT flag, COUNT(*) FROM items GROUP BY flag",
    "window_rank": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY custkey ORDER BY price DESC, o_orderkey) AS place FROM ords",
    "grouping_sets": "SELECT flag, state, COUNT(*) AS n FROM items GROUP BY GROUPING SETS ((flag, state), (flag), ())",
    "top_k": "SELECT o_orderkey, price FROM ords ORDER BY price DESC, o_orderkey LIMIT 20",
}

#: Views whose joins meet many rows with many, so that what they return outgrows by far what they read.
MANY_TO_MANY = {"join_two", "join_three", "mixed_inner_left"}

_prepared: dict[tuple[str, str, str], tuple[Catalog, int]] = {}


def base(name: str) -> str:
    """The last state of a base table, in SQL over the data set."""
    table, key, cols = BASES[name]
    return f"SELECT {cols} FROM {table} WHERE {key} % 10 = 0 OR {key} % 7 <> 1"


def prepared(spark: SparkSession, sf_dir: str, name: str) -> tuple[Catalog, int]:
    """A catalog of one base table over a data set, past its changes, and its first version; made once a session."""
    held = (spark.sparkContext.applicationId, sf_dir, name)
    if held not in _prepared:
        table, key, cols = BASES[name]
        catalog = Catalog(spark, f"src_{name}", workspace(spark))
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        pick = [c.strip() for c in _split(cols)]
        start = catalog.commit({}, {f"main.{name}": rows.where(f"{key} % 10 <> 0").selectExpr(*pick)})
        catalog.commit({f"main.{name}": signed(rows.where(f"{key} % 10 = 0").selectExpr(*pick))})
        catalog.commit({f"main.{name}": signed(rows.where(f"{key} % 10 <> 0 AND {key} % 7 = 1").selectExpr(*pick), -1)})
        catalog.compact()
        _prepared[held] = (catalog, start)
    return _prepared[held]


def sources(spark: SparkSession, sf_dir: str, sql: str) -> tuple[dict[str, Catalog], dict[str, int]]:
    """The catalogs of the base tables that a query reads, by their own names, and the first version of each."""
    found = [prepared(spark, sf_dir, name) for name in BASES if (name,) in tables_named(spark, sql)]
    return {catalog.name: catalog for catalog, _ in found}, {catalog.name: start for catalog, start in found}


def _split(cols: str) -> list[str]:
    out, depth = [""], 0
    for c in cols:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _view(spark: SparkSession, source: dict[str, Catalog], sql: str, **options) -> MaterializedView:
    views = Catalog(spark, "views", workspace(spark))
    named = {name: {"catalog": f"src_{name}"} for name in BASES if f"src_{name}" in source}
    return compile_ivm(sql, spark=spark, catalogs={**source, "views": views}, name="mv", mv_catalog="views", sources=named, **options)


def maintained(spark: SparkSession, sf_dir: str, sql: str, **options) -> DataFrame:
    source, first = sources(spark, sf_dir, sql)
    view = _view(spark, source, sql, **options)
    view.create(first)
    view.maintain()
    return view.query_mv()


def full_refresh_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(spark, sf_dir, VIEWS["join_sum"], strategy=FULL)


def chained_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a view: both in one catalog, maintained in order."""
    sql = VIEWS["from_agg_filter"].replace("t.n > 2", "t.n > 0")
    source, first = sources(spark, sf_dir, sql)
    lower = _view(spark, source, sql)
    lower.create(first)
    upper = compile_ivm("SELECT n, COUNT(*) AS customers FROM mv GROUP BY n", spark=spark, catalogs=lower.catalogs, name="upper", mv_catalog="views")
    upper.create()
    for view in (lower, upper):
        view.maintain()
    return upper.query_mv()


def multi_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle for each version instead of one for all."""
    source, first = sources(spark, sf_dir, VIEWS["join_sum"])
    view = _view(spark, source, VIEWS["join_sum"])
    view.create(first)
    last = {name: catalog.latest_version() for name, catalog in source.items()}
    for step in range(1, max(last[name] - first[name] for name in last) + 1):
        view.maintain({name: min(first[name] + step, last[name]) for name in last})
    return view.query_mv()


def _small(spark: SparkSession, sf_dir: str, sql: str) -> tuple[Catalog, MaterializedView]:
    """A view over the nations in a catalog of its own."""
    catalog = Catalog(spark, "dl", workspace(spark))
    catalog.create("nat", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS nationkey", "n_name AS nation", "n_regionkey AS regionkey"))
    view = compile_ivm(sql, spark=spark, catalogs={"dl": catalog}, name="mv")
    view.create()
    return catalog, view


_BY_REGION = "SELECT regionkey, COUNT(*) AS n, CAST(SUM(nationkey) AS BIGINT) AS keys FROM nat GROUP BY regionkey"


def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, view = _small(spark, sf_dir, _BY_REGION)
    catalog.table("nat").update("nationkey % 3 = 0", {"regionkey": F.lit(9)})
    view.maintain()
    return view.query_mv()


def insert_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come and go within one cycle leave no trace."""
    catalog, view = _small(spark, sf_dir, _BY_REGION)
    extra = catalog.table("nat").as_of().where("nationkey < 5").selectExpr("nationkey + 100 AS nationkey", "nation", "regionkey")
    catalog.table("nat").insert(extra)
    catalog.table("nat").delete_where("nationkey >= 103")
    view.maintain()
    return view.query_mv()


def per_version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of a view: one cycle that moves two groups shows the old and the new row of each."""
    catalog, view = _small(spark, sf_dir, _BY_REGION)
    catalog.table("nat").update("nationkey = 0", {"regionkey": F.lit(1)})
    version = view.maintain()
    return view.table.changes(version, version).select("change_type", "regionkey", "n", "keys")


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, _ = _small(spark, sf_dir, _BY_REGION)
    before = catalog.latest_version()
    catalog.table("nat").delete_where("regionkey = 2")
    return catalog.table("nat").as_of(before).select("nationkey", "nation")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, view = _small(spark, sf_dir, _BY_REGION)
    for key in (1, 2):
        catalog.table("nat").delete_where(f"nationkey = {key}")
    return pending_maintenance(spark, [view])


def expirable(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, view = _small(spark, sf_dir, _BY_REGION)
    first = view.cursors()["dl"]
    for key in (1, 2):
        catalog.table("nat").delete_where(f"nationkey = {key}")
    found = safe_to_expire(spark, [view])
    return found.select("source_catalog", (F.col("min_required_snapshot") - first).alias("behind_first"), (F.col("latest_snapshot") > F.col("min_required_snapshot")).alias("has_pending"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(spark, sf_dir, VIEWS["join_four"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: (lambda spark, sf_dir, sql=sql, stored=SIDES if name in MANY_TO_MANY else ROWS: maintained(spark, sf_dir, sql, stored=stored)) for name, sql in VIEWS.items()}
    more = [full_refresh_forced, chained_views, multi_round, update_rows, insert_then_delete, per_version_changes, time_travel]
    return named | {f.__name__: f for f in more} | {"pending_maintenance": pending, "safe_to_expire": expirable}


def _with_bases(sql: str) -> str:
    used = ", ".join(f"{name} AS ({base(name)})" for name in BASES)
    if sql.startswith("WITH "):
        return f"WITH {used}, {sql[5:]}"
    return f"WITH {used} {sql}"


def oracle_sql() -> dict[str, str]:
    nat = "SELECT n_nationkey AS nationkey, n_name AS nation, {} AS regionkey FROM nation"
    moved = nat.format("CASE WHEN n_nationkey % 3 = 0 THEN 9 ELSE n_regionkey END")
    kept = nat.format("n_regionkey")
    extra = f"{kept} UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_nationkey < 3"
    one = nat.format("CASE WHEN n_nationkey = 0 THEN 1 ELSE n_regionkey END")
    return {name: _with_bases(sql) for name, sql in VIEWS.items()} | {
        "full_refresh_forced": _with_bases(VIEWS["join_sum"]),
        "chained_views": _with_bases("SELECT n, COUNT(*) AS customers FROM (SELECT custkey, COUNT(*) AS n FROM ords GROUP BY custkey) t GROUP BY n"),
        "multi_round": _with_bases(VIEWS["join_sum"]),
        "update_rows": f"WITH nat AS ({moved}) {_BY_REGION}",
        "insert_then_delete": f"WITH nat AS ({extra}) {_BY_REGION}",
        "per_version_changes": f"WITH a AS (WITH nat AS ({kept}) {_BY_REGION}), b AS (WITH nat AS ({one}) {_BY_REGION}) SELECT 'delete' AS change_type, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'insert', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
        "time_travel": "SELECT n_nationkey AS nationkey, n_name AS nation FROM nation",
        "pending_maintenance": "SELECT 'dl' AS mv_catalog, 'mv' AS mv_name, 'dl' AS source_catalog, CAST(2 AS BIGINT) AS pending_snapshots",
        "safe_to_expire": "SELECT 'dl' AS source_catalog, CAST(0 AS BIGINT) AS behind_first, TRUE AS has_pending",
    }
