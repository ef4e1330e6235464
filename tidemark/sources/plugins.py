"""Classes that users extend: sources fill base tables, sinks and effectors carry a view's changes outside."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

from .versioned import Catalog, VersionedTable

Options = TypeVar("Options")


@dataclass(frozen=True)
class SyncResult:
    rows_inserted: int = 0
    rows_deleted: int = 0
    rows_updated: int = 0


class Source(ABC, Generic[Options]):
    """Brings rows into schema main of a catalog; `sync` may read any format that Spark reads."""

    def __init__(self, catalog: str, table: str, options: Options | None = None):
        self.catalog, self.table, self.options = catalog, table, options

    @property
    def fqn(self) -> str:
        return f"{self.catalog}.main.{self.table}"

    def setup(self, spark: SparkSession, catalog: Catalog) -> None:  # noqa: B027
        """Runs once, before the first sync."""

    @abstractmethod
    def sync(self, spark: SparkSession, catalog: Catalog) -> SyncResult: ...


@dataclass(frozen=True)
class ChangeSet:
    """The changes of a view in a range of versions, both ends included."""

    catalog: str
    schema: str
    table: str
    source: VersionedTable
    snapshot_start: int
    snapshot_end: int

    @property
    def fqn(self) -> str:
        return f"{self.catalog}.{self.schema}.{self.table}"

    def changes(self) -> DataFrame:
        return self.source.changes(self.snapshot_start, self.snapshot_end)

    def current(self) -> DataFrame:
        return self.source.as_of(self.snapshot_end)


@dataclass(frozen=True)
class FlushResult:
    rows_inserted: int = 0
    rows_deleted: int = 0
    rows_updated: int = 0


class Sink(ABC, Generic[Options]):
    """Takes a view's changes: batched, once for all versions since the last flush, or else once for each."""

    batched = True

    def __init__(self, catalog: str, table: str, options: Options | None = None, schema: str = "main"):
        self.catalog, self.table, self.options, self.schema = catalog, table, options, schema

    @property
    def fqn(self) -> str:
        return f"{self.catalog}.{self.schema}.{self.table}"

    @property
    def sink_name(self) -> str:
        return f"{type(self).__name__}_{self.table}"

    def setup(self, spark: SparkSession) -> None:  # noqa: B027
        """Runs once, when the orchestrator starts."""

    @abstractmethod
    def flush(self, changes: ChangeSet) -> FlushResult: ...


@dataclass
class EffectorResult:
    rows_inserted: int = 0
    rows_skipped: int = 0
    rows_errored: int = 0


class Effector(ABC):
    """Handles a view's changes row by row; what the handlers return is appended to `output_table`.

    on_error: "raise" ends the flush, "skip" drops the row, "store" keeps a row
    of nulls with the message in a further column `error`. A handler that
    returns None skips its row. Changes are handled version by version, and the
    images of an update are one call.
    """

    columns: list[tuple[str, str]] = []
    on_error = "raise"

    def __init__(self, catalog: str, table: str, output_table: str, schema: str = "main"):
        self.catalog, self.table, self.output_table, self.schema = catalog, table, output_table, schema

    @property
    def effector_name(self) -> str:
        return f"{type(self).__name__}_{self.table}"

    @property
    def output_schema(self) -> str:
        extra = [("error", "string")] if self.on_error == "store" else []
        return ", ".join(f"`{n}` {t}" for n, t in [*self.columns, *extra])

    def handle_insert(self, row: dict[str, Any]) -> dict[str, Any] | None:
        return None

    def handle_update(self, old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any] | None:
        return None

    def handle_delete(self, row: dict[str, Any]) -> dict[str, Any] | None:
        return None
