"""Parquet tables with versions, a change feed and time travel.

    <root>/<catalog>/_log/<version>.json           a commit: tables touched, cursors advanced
    <root>/<catalog>/_marks/<number>.json          a full copy is ready, or versions are expired
    <root>/<catalog>/_moves/<number>.json          cursors advanced without a version
    <root>/<catalog>/<schema>/<table>/changes/v=<version>/   signed rows
    <root>/<catalog>/<schema>/<table>/base/v=<version>/      full copies

Versions count through a catalog. Data are written first and the log record
last, with an exclusive create: that is the commit, for all tables and cursors
it names at once. A record is never changed, so a reader sees whole versions
only. Cursor moves alone make no version. Records are numbered without gaps, so
a look for news costs one test a kind, however long the log is.

A read joins the changes since the last full copy to that copy. Copies are made
by `compact`, apart from commits, where the changes have grown to a share of
the copy: what is copied is paid for by what was changed.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bag import W, applied, columns, expand, matching, name, net, plus, repeated, signed
from .files import Files

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"
#: A table is due for a copy when its changes since the last one hold this share of its rows, or so many versions.
COPY_SHARE, COPY_VERSIONS = 0.2, 100
KIND, PAIR = "_change", "_pair"


class VersionError(ValueError):
    """A version that does not exist, or no longer does."""


class CommitConflict(RuntimeError):
    """Another writer committed the version that was being prepared."""


@dataclass
class _Table:
    schema: dict
    created: int
    changed: list[int] = field(default_factory=list)
    bases: list[int] = field(default_factory=list)
    data: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    copied: dict[int, int] = field(default_factory=dict)
    signs: dict[int, str] = field(default_factory=dict)
    expired: int = -1


@dataclass(frozen=True)
class Staged:
    """Changes of a table that are written but belong to no version until a commit names them."""

    path: str
    rows: int
    sign: str  # "+" for inserts only, "-" for deletes only, else "both"


class Catalog:
    """A folder of versioned tables with one version counter."""

    def __init__(self, spark: SparkSession, catalog: str, root: str):
        self.spark, self.name, self.root = spark, catalog, f"{root.rstrip('/')}/{catalog}"
        self.files, self.lock = Files(spark), threading.RLock()
        self._version, self._tables, self._cursors, self._meta = 0, {}, {}, {}
        self._marks = self._moves = 0

    # -- the log ---------------------------------------------------------
    def refresh(self) -> None:
        """Reads records that were made since the last look."""
        with self.lock:
            for record in self._new("log", self._version):
                self._replay(record)
            for record in self._new("marks", self._marks):
                self._marks += 1
                table = self._tables[record["table"]]
                table.bases = sorted({*table.bases, record["version"]})
                table.expired = max(table.expired, record.get("expired", -1))
                if "rows" in record:
                    table.copied[record["version"]] = record["rows"]
            for record in self._new("moves", self._moves):
                self._moves += 1
                self._cursors.update({tuple(k): v for k, v in record["cursors"]})

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root}/_{kind}/{number:012d}.json"

    def _new(self, kind: str, last: int):
        while self.files.exists(self._path(kind, last + 1)):
            last += 1
            yield self.files.read(self._path(kind, last))

    def _record(self, kind: str, value: dict) -> None:
        """Adds a record after all others of its kind."""
        with self.lock:
            while True:
                self.refresh()
                if self.files.create(self._path(kind, (self._marks if kind == "marks" else self._moves) + 1), value):
                    self.refresh()
                    return

    def _replay(self, record: dict) -> None:
        self._version = version = record["version"]
        for key, change in record["tables"].items():
            if "schema" in change:
                self._tables[key] = _Table(change["schema"], version)
                self._tables[key].bases.append(version)
                self._tables[key].copied[version] = change["rows"]
            else:
                self._tables[key].changed.append(version)
                self._tables[key].signs[version] = change["sign"]
                self._tables[key].rows[version] = change["rows"]
            self._tables[key].data[version] = change["path"]
        self._cursors.update({tuple(k): v for k, v in record.get("cursors", [])})

    def latest_version(self) -> int:
        self.refresh()
        return self._version

    def tables(self) -> list[str]:
        self.refresh()
        return sorted(self._tables)

    def cursors(self) -> dict[tuple, int]:
        """What was processed last, by (kind, name, source catalog)."""
        self.refresh()
        return dict(self._cursors)

    def snapshots(self) -> DataFrame:
        """(snapshot_id, tables) of each commit."""
        self.refresh()
        rows = [(v, [k for k, t in self._tables.items() if v in t.data]) for v in range(1, self._version + 1)]
        return self.spark.createDataFrame(rows, "snapshot_id long, tables array<string>")

    def move_cursors(self, cursors: dict[tuple, int]) -> None:
        """Advances cursors where no data change; no version is made."""
        self._record("moves", {"cursors": [[list(k), v] for k, v in cursors.items()]})

    def stage(self, key: str, delta: DataFrame, onto: Staged | None = None) -> Staged:
        """Writes signed changes for a later commit; `onto` adds to what was staged before."""
        path = onto.path if onto else f"{self.root}/{key.replace('.', '/')}/changes/{uuid.uuid4().hex}"
        kind = F.when(name(W) > 0, INSERT).otherwise(DELETE)
        full = delta if KIND in delta.columns else delta.withColumn(KIND, kind).withColumn(PAIR, F.lit(None).cast("long"))
        seen = Observation()
        full.observe(seen, F.count("*").alias("n"), F.min(W).alias("lo"), F.max(W).alias("hi")).write.mode("append").parquet(path)
        n, lo, hi = (seen.get[x] for x in ("n", "lo", "hi"))
        sign = "+" if n and lo > 0 else "-" if n and hi < 0 else "both"
        return Staged(path, n + onto.rows, sign if sign == onto.sign or not n else "both") if onto else Staged(path, n, sign)

    def scratch(self, df: DataFrame, made: list[str]) -> DataFrame:
        """The rows of `df`, written once for a cycle that reads them several times; the path is added to `made`."""
        made.append(f"{self.root}/_scratch/{uuid.uuid4().hex}")
        df.write.parquet(made[-1])
        return self.spark.read.schema(df.schema).parquet(made[-1])

    def commit(self, changes: dict[str, DataFrame | Staged], created: dict[str, DataFrame] | None = None, cursors: dict[tuple, int] | None = None) -> int:
        """Writes signed changes and new tables as one version, with the cursors that they account for.

        Data are written before the lock is taken. If another writer makes the
        version first, what was written is removed again.
        """
        staged = {key: x if isinstance(x, Staged) else self.stage(key, x) for key, x in changes.items()}
        written: dict[str, dict] = {}
        for key, df in (created or {}).items():
            path, seen = f"{self.root}/{key.replace('.', '/')}/base/{uuid.uuid4().hex}", Observation()
            df.observe(seen, F.count("*").alias("n")).write.parquet(path)
            written[key] = {"schema": df.schema.jsonValue(), "path": path, "rows": seen.get["n"]}
        for key, x in staged.items():
            if x.rows:
                written[key] = {"path": x.path, "rows": x.rows, "sign": x.sign}
            else:
                self.files.remove(x.path)
        with self.lock:
            self.refresh()
            if not written:
                if cursors:
                    self.move_cursors(cursors)
                return self._version
            version = self._version + 1
            record = {"version": version, "tables": written, "cursors": [[list(k), v] for k, v in (cursors or {}).items()]}
            if not self.files.create(self._path("log", version), record):
                for x in written.values():
                    self.files.remove(x["path"])
                raise CommitConflict(f"version {version} of {self.name}")
            self.refresh()
        return version

    def compact(self) -> list[str]:
        """Copies the tables that are due for it; returns their keys."""
        due = [t for t in map(self.table, self.tables()) if t.copy_due()]
        for t in due:
            t.copy()
        return [t.key for t in due]

    def table(self, key: str, schema: str = "main") -> VersionedTable:
        return VersionedTable(self, key if "." in key else f"{schema}.{key}")

    def has(self, key: str) -> bool:
        self.refresh()
        return (key if "." in key else f"main.{key}") in self._tables

    def create(self, key: str, df: DataFrame, schema: str = "main") -> VersionedTable:
        """A new table with the rows of `df`."""
        key = key if "." in key else f"{schema}.{key}"
        if self.has(key):
            raise ValueError(f"{self.name}.{key} exists")
        reserved = {W, KIND, PAIR} & set(df.columns)
        if reserved:
            raise ValueError(f"reserved column names: {sorted(reserved)}")
        self.commit({}, {key: df})
        return self.table(key)


class VersionedTable:
    """A table of a catalog; every method that writes makes one version."""

    def __init__(self, catalog: Catalog, key: str):
        self.catalog, self.key = catalog, key

    @property
    def fqn(self) -> str:
        return f"{self.catalog.name}.{self.key}"

    @property
    def _meta(self) -> _Table:
        try:
            return self.catalog._tables[self.key]
        except KeyError:
            self.catalog.refresh()
            return self.catalog._tables[self.key]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._meta.schema)

    def _read(self, path: str, changes: bool = False) -> DataFrame:
        schema = self.schema
        if changes:
            schema = T.StructType([*schema.fields, T.StructField(W, T.LongType()), T.StructField(KIND, T.StringType()), T.StructField(PAIR, T.LongType())])
        return self.catalog.spark.read.schema(schema).parquet(path)

    def changed_in(self, start: int, end: int) -> list[int]:
        """Versions from start to end, both included, that changed this table."""
        return [v for v in self._meta.changed if start <= v <= end]

    def _base_path(self, version: int) -> str:
        return self._meta.data[version] if version == self._meta.created else f"{self.catalog.root}/{self.key.replace('.', '/')}/base/v={version}"

    def as_of(self, version: int | None = None) -> DataFrame:
        """The rows at a version (the latest by default)."""
        latest = self.catalog.latest_version()
        version = latest if version is None else version
        if version < self._meta.created or version > latest:
            raise VersionError(f"{self.fqn} has no version {version}")
        bases = [b for b in self._meta.bases if b <= version]
        if not bases:
            raise VersionError(f"version {version} of {self.fqn} is expired")
        base = bases[-1]
        rows = self._read(self._base_path(base))
        if self.changed_in(base + 1, version):
            delta = self.delta(base + 1, version)
            return rows.union(expand(delta)) if self.signs(base + 1, version) == {"+"} else applied(rows, delta)
        return rows

    def signs(self, start: int, end: int) -> set[str]:
        """What the versions of a range hold: "+" inserts only, "-" deletes only, or "both"."""
        return {self._meta.signs[v] for v in self.changed_in(start, end)}

    def delta(self, start: int, end: int, raw: bool = False) -> DataFrame:
        """Net signed changes of versions start to end, both included; changes of one sign, and raw ones, are not summed up by row."""
        self._check_range(start, end)
        versions = self.changed_in(start, end)
        if not versions:
            return signed(self.catalog.spark.createDataFrame([], self.schema))
        parts = plus([self._read(self._meta.data[v], changes=True).drop(KIND, PAIR) for v in versions])
        return parts if raw or self.signs(start, end) in ({"+"}, {"-"}) else net(parts)

    def changes(self, start: int, end: int) -> DataFrame:
        """The change feed: (snapshot_id, change_id, change_type, columns), a row per copy of a row.

        start and end are included; a start after the end gives no rows, an end
        that lies in the future is an error. Both images of an update have one
        change_id, others have none.
        """
        self._check_range(start, end)
        shape = [F.lit(0).cast("long").alias("snapshot_id"), F.lit(None).cast("long").alias("change_id"), F.lit("").alias("change_type")]
        out = self.catalog.spark.createDataFrame([], self.schema).select(*shape, "*")
        for v in self.changed_in(start, end):
            rows = repeated(self._read(self._meta.data[v], changes=True), F.abs(W))
            out = out.union(rows.select(F.lit(v).cast("long"), name(PAIR), name(KIND), *[name(c) for c in self.schema.names]))
        return out

    def _check_range(self, start: int, end: int) -> None:
        if end > self.catalog.latest_version():
            raise VersionError(f"version {end} of {self.catalog.name} is in the future")
        if start <= end and start <= self._meta.expired:
            raise VersionError(f"changes of {self.fqn} up to version {self._meta.expired} are expired")

    # -- writes ----------------------------------------------------------
    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[name(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def apply(self, delta: DataFrame, cursors: dict[tuple, int] | None = None) -> int:
        """Commits signed changes (columns and _w)."""
        return self.catalog.commit({self.key: net(delta)}, cursors=cursors)

    def insert(self, rows: DataFrame) -> int:
        return self.apply(signed(self._shaped(rows)))

    def delete(self, rows: DataFrame) -> int:
        """Takes away one copy for each row given, as far as there are copies."""
        wanted = net(signed(self._shaped(rows)))
        on = [name(c) for c in self.schema.names]
        held = net(signed(matching(self.as_of(), wanted.select(*on))))
        both = plus([held.select(*on, F.struct(name(W).alias("held"), F.lit(0).cast("long").alias("wanted")).alias("x")), wanted.select(*on, F.struct(F.lit(0).cast("long").alias("held"), name(W).alias("wanted")).alias("x"))])
        found = both.groupBy(*on).agg((-F.least(F.sum("x.held"), F.sum("x.wanted"))).alias(W))
        return self.apply(found)

    def delete_where(self, condition: Column | str) -> int:
        return self.apply(signed(self.as_of().where(condition), -1))

    def update(self, condition: Column | str, values: dict[str, Column]) -> int:
        """Sets columns in the rows that meet a condition; the feed holds both images, paired."""
        old = self.as_of().where(condition).withColumn(PAIR, F.monotonically_increasing_id())
        images = F.array(
            F.struct(*[name(c).alias(c) for c in self.schema.names], F.lit(-1).cast("long").alias(W), F.lit(BEFORE).alias(KIND)),
            F.struct(*[(values[f.name].cast(f.dataType) if f.name in values else name(f.name)).alias(f.name) for f in self.schema.fields], F.lit(1).cast("long").alias(W), F.lit(AFTER).alias(KIND)),
        )
        rows = old.select(F.explode(images).alias("x"), PAIR).select("x.*", PAIR)
        return self.catalog.commit({self.key: rows})

    # -- upkeep ----------------------------------------------------------
    def copy_due(self) -> bool:
        """Whether the changes since the last copy have grown to a share of it."""
        meta, last = self._meta, self._meta.bases[-1]
        later = [v for v in meta.changed if v > last]
        return bool(later) and (len(later) >= COPY_VERSIONS or sum(meta.rows[v] for v in later) >= COPY_SHARE * max(1, meta.copied.get(last, 0)))

    def copy(self) -> int:
        """Writes the table whole at the latest version, so that reads need fewer changes."""
        version = self.catalog.latest_version()
        if version not in self._meta.bases:
            path, seen = f"{self.catalog.root}/{self.key.replace('.', '/')}/base/v={version}", Observation()
            self.as_of(version).observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
            self.catalog._record("marks", {"table": self.key, "version": version, "rows": seen.get["n"]})
        return version

    def expire(self, before: int) -> None:
        """Gives up versions older than `before`: their changes and full copies go."""
        with self.catalog.lock:
            meta = self._meta
            held = [b for b in meta.bases if b <= before]
            if not held:
                return
            keep = held[-1]
            gone = [v for v in meta.changed if v < before and v <= keep]
            self.catalog._record("marks", {"table": self.key, "version": keep, "expired": max([meta.expired, *gone])})
            for b in held[:-1]:
                self.catalog.files.remove(self._base_path(b))
                meta.bases.remove(b)
            for v in gone:
                self.catalog.files.remove(meta.data[v])


__all__ = ["AFTER", "BEFORE", "DELETE", "INSERT", "Catalog", "CommitConflict", "Staged", "VersionError", "VersionedTable", "columns"]
