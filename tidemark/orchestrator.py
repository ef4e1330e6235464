"""Runs views in dependency order, with the sources, sinks and effectors around them."""

from __future__ import annotations

import asyncio
import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.bag import signed
from .plans.view import MaterializedView, Naming, compile_ivm, tables_named
from .sources.plugins import ChangeSet, Effector, EffectorResult, FlushResult, Sink, Source, SyncResult
from .sources.versioned import AFTER, BEFORE, DELETE, Catalog

#: Rows of an effector's output that the driver holds before they are written.
OUTPUT_ROWS = 10_000
DETAILS = ("none", "cursor_distance", "rows_changed")


class OrchestratorError(Exception):
    """A project that cannot run."""


class CatalogNotFoundError(OrchestratorError): ...


class NotVersionedError(OrchestratorError): ...


class MissingTableError(OrchestratorError): ...


class MissingColumnError(OrchestratorError): ...


class CyclicDependencyError(OrchestratorError): ...


@dataclass
class Step:
    """One view in a maintenance plan."""

    view: str
    level: int
    strategy: str
    pending_snapshots: int | None = None
    pending_rows: int | None = None
    skipped: bool = False
    version: int | None = None
    duration_ms: float | None = None


@dataclass
class MaintenancePlan:
    steps: list[Step] = field(default_factory=list)

    @property
    def levels(self) -> list[list[Step]]:
        out: list[list[Step]] = [[] for _ in range(max((s.level for s in self.steps), default=-1) + 1)]
        for s in self.steps:
            out[s.level].append(s)
        return out


class Orchestrator:
    def __init__(self, spark: SparkSession, naming: type[Naming] = Naming):
        self.spark, self.naming = spark, naming
        self.catalogs: dict[str, Catalog] = {}
        self.sources: list[Source] = []
        self.sinks: list[Sink] = []
        self.effectors: list[Effector] = []
        self.specs: dict[str, dict] = {}
        self.views: dict[str, MaterializedView] = {}
        self._one = ThreadPoolExecutor(1)

    # -- registration --------------------------------------------------------
    def setup_extensions(self, run) -> None:
        """Lets a project prepare the session (jars, functions)."""
        run(self.spark)

    def setup_secrets(self, run) -> None:
        """Lets a project set credentials in the session."""
        run(self.spark)

    def add_catalog(self, name: str, root: str | Catalog) -> Catalog:
        self.catalogs[name] = root if isinstance(root, Catalog) else Catalog(self.spark, name, root)
        return self.catalogs[name]

    def add_source(self, source: Source) -> None:
        self.sources.append(source)

    def add_sink(self, sink: Sink) -> None:
        self.sinks.append(sink)

    def add_effector(self, effector: Effector) -> None:
        self.effectors.append(effector)

    def add_ivm(self, catalog: str, name: str, view_sql: str, schema: str = "main", sources: dict[str, dict] | None = None, strategy: str | None = None) -> None:
        """Registers a view; it is compiled when what it reads exists."""
        key = f"{catalog}.{schema}.{name}"
        if key in self.specs:
            raise OrchestratorError(f"{key} is registered twice")
        self.specs[key] = {"name": name, "view_sql": view_sql, "mv_catalog": catalog, "mv_schema": schema, "sources": sources, "strategy": strategy}

    # -- dependencies ----------------------------------------------------------
    def _reads(self, key: str) -> set[str]:
        """Registered views that a view's parsed SQL reads, before anything is compiled."""
        spec, out = self.specs[key], set()
        named = tables_named(self.spark, spec["view_sql"]) or set()
        for other, s in self.specs.items():
            cat, schema, name = s["mv_catalog"].lower(), s["mv_schema"].lower(), s["name"].lower()
            mapped = {k.lower(): v for k, v in (spec["sources"] or {}).items()}.get(name)
            if mapped:
                bare = (mapped.get("catalog", "").lower(), mapped.get("schema", "main").lower()) == (cat, schema)
            else:
                bare = spec["mv_catalog"].lower() == cat and schema in ("main", spec["mv_schema"].lower())
            near = spec["mv_catalog"].lower() == cat
            if (cat, schema, name) in named or (near and (schema, name) in named) or (bare and (name,) in named):
                out.add(other)
        return out

    def levels(self) -> list[list[str]]:
        """Views in topological levels; those of a level do not read each other."""
        left = {k: self._reads(k) for k in self.specs}
        out: list[list[str]] = []
        while left:
            free = sorted(k for k, reads in left.items() if not reads & left.keys())
            if not free:
                raise CyclicDependencyError(" -> ".join(sorted(left)))
            out.append(free)
            for k in free:
                del left[k]
        return out

    def _compile(self, key: str) -> MaterializedView:
        if key not in self.views:
            spec = self.specs[key]
            try:
                self.views[key] = compile_ivm(spark=self.spark, catalogs=self.catalogs, naming=self.naming(spec["name"]), **spec)
            except AnalysisException as e:
                if e.getCondition() and e.getCondition().startswith("TABLE_OR_VIEW_NOT_FOUND"):
                    raise MissingTableError(f"{key}: {e}") from e
                if e.getCondition() and e.getCondition().startswith("UNRESOLVED_COLUMN"):
                    raise MissingColumnError(f"{key}: {e}") from e
                raise
        return self.views[key]

    # -- life --------------------------------------------------------------------
    def verify(self) -> None:
        """Raises if a catalog, a table or a column is missing, or views read each other in a circle."""
        for owner in [*self.sources, *self.sinks, *self.effectors]:
            if owner.catalog not in self.catalogs:
                raise CatalogNotFoundError(owner.catalog)
        for spec in self.specs.values():
            for name in {spec["mv_catalog"], *(s["catalog"] for s in (spec["sources"] or {}).values())}:
                if name not in self.catalogs:
                    raise CatalogNotFoundError(name)
                if not isinstance(self.catalogs[name], Catalog):
                    raise NotVersionedError(name)
        filled = {(s.catalog.lower(), s.table.lower()) for s in self.sources}  # tables that a source may yet create
        waiting: set[str] = set()
        for level in self.levels():
            for key in level:
                spec = self.specs[key]
                missing = {n for n in tables_named(self.spark, spec["view_sql"]) or () if any(t == n[-1] and not self.catalogs[c].has(f"main.{t}") for c, t in filled if c in self.catalogs)}
                if missing or any(k in waiting or not self._exists(k) for k in self._reads(key)):
                    waiting.add(key)
                else:
                    self._compile(key)

    def _exists(self, key: str) -> bool:
        spec = self.specs[key]
        return self.catalogs[spec["mv_catalog"]].has(f"{spec['mv_schema']}.{self.naming(spec['name']).mv_table()}")

    def initialize(self) -> None:
        """Sets sources up and syncs them, then creates the views that are not there yet, in dependency order.

        Sinks and effectors start at the present version, so what a view holds
        at first is not replayed. Calling this again does nothing new.
        """
        for source in self.sources:
            catalog = self.catalogs[source.catalog]
            source.setup(self.spark, catalog)
        if self.sources:
            self.sync_sources()
        for level in self.levels():
            for key in level:
                view = self._compile(key)
                if not view.exists:
                    view.create()
        for kind, plugins in (("sink", self.sinks), ("effector", self.effectors)):
            for p in plugins:
                catalog = self.catalogs[p.catalog]
                if kind == "effector":
                    if not catalog.has(f"{p.schema}.{p.output_table}"):
                        catalog.create(f"{p.schema}.{p.output_table}", self.spark.createDataFrame([], p.output_schema))
                else:
                    p.setup(self.spark)
                if self._plugin_key(kind, p) not in catalog.cursors():
                    catalog.move_cursors({self._plugin_key(kind, p): catalog.latest_version()})

    @staticmethod
    def _plugin_key(kind: str, p: Sink | Effector) -> tuple:
        return (kind, p.sink_name if kind == "sink" else p.effector_name, f"{p.catalog}.{p.schema}.{p.table}")

    def sync_sources(self) -> dict[str, SyncResult]:
        return {s.fqn: s.sync(self.spark, self.catalogs[s.catalog]) for s in self.sources}

    def get_maintenance_plan(self, detail_level: str = "cursor_distance") -> MaintenancePlan:
        """Steps by level; detail none, cursor_distance (from the log alone) or rows_changed (counts the feeds)."""
        if detail_level not in DETAILS:
            raise ValueError(f"detail_level is one of {DETAILS}")
        plan = MaintenancePlan()
        for depth, level in enumerate(self.levels()):
            for key in level:
                view = self._compile(key)
                step = Step(key, depth, view.strategy)
                if detail_level != "none":
                    step.pending_snapshots = view.pending()
                if detail_level == "rows_changed":
                    step.pending_rows = view.pending_rows()
                plan.steps.append(step)
        return plan

    def _execute(self, step: Step) -> Step:
        began, view = time.perf_counter(), self._compile(step.view)
        step.skipped = view.pending() == 0
        step.version = view.maintain()
        step.duration_ms = (time.perf_counter() - began) * 1000
        return step

    def maintain(self, verbose: bool = False, detail_level: str = "none", parallelism: int = 1) -> list[Step]:
        """Maintains all views; those of a level at once, up to `parallelism`."""
        done: list[Step] = []
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            for level in self.get_maintenance_plan(detail_level).levels:
                for step in pool.map(self._execute, level):
                    done.append(step)
                    if verbose:
                        print(describe(step), flush=True)
        return done

    def compact(self) -> dict[str, list[str]]:
        """Copies tables whose changes have grown to a share of them, by catalog; a job apart from maintenance."""
        return {name: catalog.compact() for name, catalog in self.catalogs.items()}

    async def maintain_async(self, parallelism: int = 1) -> list[Step]:
        done: list[Step] = []
        gate = asyncio.Semaphore(max(1, parallelism))

        async def one(step: Step) -> Step:
            async with gate:
                return await asyncio.to_thread(self._execute, step)

        for level in self.get_maintenance_plan("none").levels:
            done += await asyncio.gather(*map(one, level))
        return done

    def _next(self) -> Step | None:
        return next((s for s in self.get_maintenance_plan().steps if s.pending_snapshots), None)

    def advance_one(self) -> Future | None:
        """Starts the next pending step; None if nothing is pending."""
        step = self._next()
        return None if step is None else self._one.submit(self._execute, step)

    async def advance_one_async(self) -> Step | None:
        step = self._next()
        return None if step is None else await asyncio.to_thread(self._execute, step)

    # -- outside -------------------------------------------------------------------
    def _ranges(self, kind: str, p: Sink | Effector, batched: bool) -> list[tuple[int, int]]:
        catalog = self.catalogs[p.catalog]
        last, latest = catalog.cursors()[self._plugin_key(kind, p)], catalog.latest_version()
        changed = catalog.table(f"{p.schema}.{p.table}").changed_in(last + 1, latest)
        if not changed:
            return []
        return [(last + 1, latest)] if batched else [(v, v) for v in changed]

    def flush_sinks(self) -> dict[str, list[FlushResult]]:
        """Hands each sink what changed since its last flush; the cursor moves after each call that returns."""
        out: dict[str, list[FlushResult]] = {}
        for sink in self.sinks:
            catalog, out[sink.sink_name] = self.catalogs[sink.catalog], []
            table = catalog.table(f"{sink.schema}.{sink.table}")
            for start, end in self._ranges("sink", sink, sink.batched):
                out[sink.sink_name].append(sink.flush(ChangeSet(sink.catalog, sink.schema, sink.table, table, start, end)))
                catalog.move_cursors({self._plugin_key("sink", sink): end})
        return out

    def flush_effectors(self) -> dict[str, EffectorResult]:
        return {e.effector_name: self._flush_effector(e) for e in self.effectors}

    def _flush_effector(self, e: Effector) -> EffectorResult:
        catalog, result = self.catalogs[e.catalog], EffectorResult()
        table, output = catalog.table(f"{e.schema}.{e.table}"), f"{e.schema}.{e.output_table}"
        for start, end in self._ranges("effector", e, batched=False):
            rows, names, staged = [], [n for n, _ in e.columns], None
            olds: dict[int, dict] = {}
            # side effects are ordered, so rows come to the driver one partition at a time
            for r in table.changes(start, end).orderBy("change_id", F.col("change_type") == AFTER).toLocalIterator():
                row = r.asDict()
                pair, kind = row.pop("change_id"), row.pop("change_type")
                row.pop("snapshot_id")
                try:
                    if kind == DELETE:
                        made = e.handle_delete(row)
                    elif kind == AFTER:
                        made = e.handle_update(olds.pop(pair), row) if pair in olds else e.handle_insert(row)
                    elif kind == BEFORE:
                        olds[pair] = row
                        continue
                    else:
                        made = e.handle_insert(row)
                except Exception as x:
                    if e.on_error == "raise":
                        raise
                    result.rows_errored += 1
                    if e.on_error == "store":
                        rows.append(tuple([None] * len(names)) + (str(x),))
                    continue
                if made is None:
                    result.rows_skipped += 1
                else:
                    rows.append(tuple(made.get(n) for n in names) + ((None,) if e.on_error == "store" else ()))
                if len(rows) >= OUTPUT_ROWS:
                    result.rows_inserted += len(rows)
                    staged, rows = catalog.stage(output, signed(self.spark.createDataFrame(rows, e.output_schema)), staged), []
            result.rows_inserted += len(rows)
            if rows:
                staged = catalog.stage(output, signed(self.spark.createDataFrame(rows, e.output_schema)), staged)
            # output and cursor are one commit: a version is accounted for with its output or not at all
            catalog.commit({output: staged} if staged else {}, cursors={self._plugin_key("effector", e): end})
        return result

    # -- reports ---------------------------------------------------------------------
    def tree(self) -> str:
        """Catalogs with their base tables and views, as text."""
        lines = []
        for name in sorted(self.catalogs):
            lines.append(f"{name} (catalog)")
            own = {k: self._compile(k) for level in self.levels() for k in level if self.specs[k]["mv_catalog"] == name}
            hidden = {v.key for v in own.values()} | {v.state_key for v in own.values()}
            lines += [f"  {t} (base table)" for t in self.catalogs[name].tables() if t not in hidden]
            lines += [f"  {k} ({'MV' if v.strategy == 'incremental' else 'MV, full refresh'})" for k, v in own.items()]
        return "\n".join(lines)


def describe(step: Step) -> str:
    if step.skipped:
        return f"{step.view}: up to date"
    return f"{step.view}: {step.strategy}, version {step.version}, {step.duration_ms:.0f} ms"
