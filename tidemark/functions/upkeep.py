"""What is pending, and which versions nobody needs any more."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.view import MaterializedView


def _cursor_rows(views: Iterable[MaterializedView]) -> list[tuple]:
    return [(v.mv_catalog, v.name, source, at, v.catalogs[source].latest_version(), v.pending_by_source()[source]) for v in views for source, at in v.cursors().items()]


def _cursors(spark: SparkSession, views: Iterable[MaterializedView]) -> DataFrame:
    return spark.createDataFrame(_cursor_rows(views), "mv_catalog string, mv_name string, source_catalog string, last_snapshot long, latest_snapshot long, pending_snapshots long")


def safe_to_expire(spark: SparkSession, views: Iterable[MaterializedView]) -> DataFrame:
    """(source_catalog, min_required_snapshot, latest_snapshot): versions before the minimum can be expired. No views give no rows."""
    return _cursors(spark, views).groupBy("source_catalog").agg(F.min("last_snapshot").alias("min_required_snapshot"), F.max("latest_snapshot").alias("latest_snapshot")).orderBy("source_catalog")


def pending_maintenance(spark: SparkSession, views: Iterable[MaterializedView]) -> DataFrame:
    """(mv_catalog, mv_name, source_catalog, pending_snapshots): versions that changed what a view reads."""
    return _cursors(spark, views).select("mv_catalog", "mv_name", "source_catalog", "pending_snapshots").orderBy("mv_catalog", "mv_name", "source_catalog")
