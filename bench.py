"""Times headline queries; prints one JSON line.

BENCH_SF_DIR: data set (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
Each view is created on a first state of its base tables and maintained through
three cycles whose changes are 0.1 %, 1 % and 10 % of every table's rows, half
inserts and half deletes. `<name>` is the cycle of 1 %, `<name>.d0.1` and
`<name>.d10` the others; `.recompute` is the same SELECT computed afresh over
the same version and written as Parquet, as a commit is. "feed_rows" tells the
rows that each cycle wrote to the view's feed. Between cycles the view's tables
are compacted where due, as an orchestrator does, outside of the times. A first view is run unreported,
so that no query pays for a cold session.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VIEWS = ["agg_sum_count", "agg_global", "agg_min_max_delete", "join_four", "left_join", "not_exists", "except_all"]
#: Suffix of a cycle, and the share of rows it changes, in ten-thousandths.
CYCLES = [(".d0.1", 10), ("", 100), (".d10", 1000)]


def prepared(spark: SparkSession, sf: str):
    """A catalog of base tables with a first version and one for each cycle."""
    from tidemark import queries as q
    from tidemark.sources.versioned import Catalog
    from tidemark.sources.workspace import workspace

    catalog = Catalog(spark, "src", workspace(spark))
    first, cycles = {}, [{} for _ in CYCLES]
    for name, (table, _, cols) in q.BASES.items():
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        rows = rows.withColumn("_at", F.pmod(F.xxhash64(*rows.columns), F.lit(10_000)))
        pick = [c.strip() for c in q._split(cols)]
        edge, absent = 0, F.lit(False)
        for changes, (_, share) in zip(cycles, CYCLES, strict=True):
            middle, end = edge + share // 2, edge + share
            comes, goes = (F.col("_at") >= edge) & (F.col("_at") < middle), (F.col("_at") >= middle) & (F.col("_at") < end)
            absent, edge = absent | comes, end
            changes[f"main.{name}"] = rows.where(comes | goes).withColumn("_w", F.when(comes, 1).otherwise(-1).cast("long")).selectExpr(*pick, "_w")
        first[f"main.{name}"] = rows.where(~absent).selectExpr(*pick)
    versions = [catalog.commit({}, first)]
    for changes in cycles:
        versions.append(catalog.commit(changes))
    return catalog, versions


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark import queries as q
    from tidemark.sources.workspace import workspace

    source, versions = prepared(spark, sf)
    times: dict[str, float] = {}
    feed: dict[str, int] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    for name in ["join_sum", *VIEWS]:
        view = q._view(spark, source, q.VIEWS[name])
        view.create({"src": versions[0]})
        for (suffix, _), version in zip(CYCLES, versions[1:], strict=True):
            made: list = []
            timed(name + suffix, lambda: made.append(view.maintain({"src": version})))  # noqa: B023
            if not suffix:
                timed(f"{name}.recompute", lambda: view.recompute({"src": version}).write.parquet(f"{workspace(spark)}/{uuid.uuid4().hex}"))  # noqa: B023
            feed[name + suffix] = view.table.changes(made[0], made[0]).count() if made[0] else 0
            view.catalog.compact()
    times = {k: v for k, v in times.items() if k.split(".")[0] in VIEWS}
    feed = {k: v for k, v in feed.items() if k.split(".")[0] in VIEWS}
    try:
        from tidemark.llm import queries as corpus
    except ModuleNotFoundError:
        corpus = None
    for name, query in (corpus.queries() if corpus else {}).items():
        timed(name, lambda: query(spark, sf).write.format("noop").mode("overwrite").save())  # noqa: B023
    total = sum(v for k, v in times.items() if "." not in k)
    print(json.dumps({"metric": "seconds for headline queries", "value": round(total, 3), "unit": "sec", "queries": times, "feed_rows": feed, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
