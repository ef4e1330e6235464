"""Triggers: polling for pending versions, and Structured Streaming queries that follow a catalog's log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..orchestrator import Orchestrator, Step
from ..sources.versioned import VersionedTable


def watch(orchestrator: Orchestrator, interval: float = 5.0, rounds: int | None = None) -> Iterator[list[Step]]:
    """Syncs sources, maintains what is pending, and yields the steps of each cycle that had any."""
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        if orchestrator.sources:
            orchestrator.sync_sources()
        if any(s.pending_snapshots for s in orchestrator.get_maintenance_plan().steps):
            yield [s for s in orchestrator.maintain() if not s.skipped]
            orchestrator.flush_sinks()
            orchestrator.flush_effectors()
            orchestrator.compact()
        if rounds is None or rounds > 0:
            time.sleep(interval)


def commits(table: VersionedTable) -> DataFrame:
    """The records of the table's catalog as an unbounded frame of text, a row per committed version."""
    return table.catalog.spark.readStream.schema("value string").option("wholetext", "true").format("text").load(f"{table.catalog.root}/_log/*.json")


def _started(table: VersionedTable, checkpoint: str, cycle: Callable[[DataFrame, int], None], available_now: bool, interval: str) -> StreamingQuery:
    writer = commits(table).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def change_stream(table: VersionedTable, reader: str, checkpoint: str, handle: Callable[[DataFrame, int, int], None], available_now: bool = False, interval: str = "5 seconds") -> StreamingQuery:
    """A streaming query that hands over a table's change feed: handle(changes, first version, last version).

    Only committed versions are seen, as the query follows the log and not the
    data files; those that did not change the table are passed over. The cursor
    of `reader` is kept in the catalog and moves when `handle` has returned, so
    after a failure the same versions come again, and none is left out.
    """
    catalog, key = table.catalog, ("stream", reader, table.fqn)

    def cycle(_: DataFrame, __: int) -> None:
        last, end = catalog.cursors().get(key, 0), catalog.latest_version()
        if table.changed_in(last + 1, end):
            handle(table.changes(max(last + 1, table._meta.created + 1), end), last + 1, end)
        if end > last:
            catalog.move_cursors({key: end})

    return _started(table, checkpoint, cycle, available_now, interval)


def maintain_on_change(orchestrator: Orchestrator, table: VersionedTable, checkpoint: str, then: Callable[[list[Step]], None] | None = None, available_now: bool = False, interval: str = "5 seconds") -> StreamingQuery:
    """A streaming query over the log of a table's catalog that runs a maintenance cycle for each micro-batch of commits."""

    def cycle(_: DataFrame, __: int) -> None:
        steps = orchestrator.maintain()
        if then:
            then(steps)

    return _started(table, checkpoint, cycle, available_now, interval)
