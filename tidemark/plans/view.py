"""Views that are kept up to date: compiling, creating, maintaining and reading them."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bag import W, minus, net
from ..sources.versioned import Catalog, VersionedTable
from .catalyst import Catalyst
from .delta import Deltas, netted
from .factor import CHANGED, NEW, Factors
from .merge import Mergeable

INCREMENTAL, FULL = "incremental", "full_refresh"
#: What a view stores: its rows, or the sides of its joins, of which its rows are made when it is read.
ROWS, SIDES = "rows", "sides"
#: Parts that the left rows of a key are dealt into where a large join is made when it is read; the right rows go to each.
SHARES = 4
#: Left rows of a key that are joined together there: a multiple of the eight values that Parquet packs at a time.
BLOCK = 256
_ABOVE = {"Project", "Filter", "Sort", "SubqueryAlias"}
_JOINS = {"Inner": "join", "Cross": "join", "LeftOuter": "left_join", "RightOuter": "right_join", "FullOuter": "full_join"}
_AGGREGATES = {"Sum": "sum", "Count": "count", "Average": "avg", "Min": "min", "Max": "max"}
_UNSTABLE = {"CurrentDate", "CurrentTimestamp", "Now", "LocalTimestamp", "CurrentTime"}


class UnsupportedSQLError(ValueError):
    """SQL that no view can be made of; `code` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Naming:
    """Names of what a view keeps; subclasses may choose others.

    Cursors are kept in the log of the view's catalog; `cursors_table` names the
    temporary view that `MaterializedView.show_cursors` makes of them.
    """

    def __init__(self, view: str):
        self.view = view

    def mv_table(self) -> str:
        return self.view

    def state_table(self) -> str:
        return f"_state_{self.view}"

    def cursors_table(self) -> str:
        return "_ivm_cursors"

    def aux_column(self, purpose: str) -> str:
        return f"_ivm_{purpose}"


@dataclass
class MaterializedView:
    """A compiled view.

    base_tables maps the keys of the tables read (schema.table) to their
    catalogs; strategy is "incremental" or "full_refresh", with the reason.
    A view stored as sides has no table of its rows: no change feed, and no view
    over it.
    """

    spark: SparkSession
    catalogs: dict[str, Catalog]
    view_sql: str
    name: str
    mv_catalog: str
    mv_schema: str
    naming: Naming
    base_tables: dict[str, str]
    features: set[str]
    strategy: str
    fallback_reason: str | None
    names: list[str]
    _plan: object = field(repr=False)
    _leaves: dict[str, tuple[str, str]] = field(repr=False)
    _bindings: dict[str, tuple[str, str]] = field(repr=False)
    inner_mvs: list = field(default_factory=list)
    stored: str = ROWS

    # -- addresses ---------------------------------------------------------
    @property
    def catalog(self) -> Catalog:
        return self.catalogs[self.mv_catalog]

    @property
    def key(self) -> str:
        return f"{self.mv_schema}.{self.naming.mv_table()}"

    @property
    def state_key(self) -> str:
        return f"{self.mv_schema}.{self.naming.state_table()}"

    @property
    def fqn(self) -> str:
        return f"{self.mv_catalog}.{self.key}"

    @property
    def table(self) -> VersionedTable:
        return self.catalog.table(self.key)

    def _cursor(self, source: str) -> tuple:
        return ("mv", self.key, source)

    def cursors(self) -> dict[str, int]:
        """The version of each source catalog that the view accounts for."""
        held = self.catalog.cursors()
        return {c: held[self._cursor(c)] for c in sorted(set(self.base_tables.values()))}

    def show_cursors(self) -> DataFrame:
        """(mv_name, source_catalog, last_snapshot) of this view, also as a temporary view under the name that `naming` gives."""
        rows = [(self.name, source, at) for source, at in self.cursors().items()]
        df = self.spark.createDataFrame(rows, "mv_name string, source_catalog string, last_snapshot long")
        df.createOrReplaceTempView(self.naming.cursors_table())
        return df

    def side_key(self, i: int) -> str:
        return f"{self.state_key}_{i}"

    @property
    def exists(self) -> bool:
        return self.catalog.has(self.side_key(0) if self.stored == SIDES else self.key)

    # -- plans ---------------------------------------------------------------
    def _parts(self):
        """(catalyst, plan, aggregate with stored state or None)."""
        c = Catalyst(self.spark)
        at = self._plan
        while c.kind(at) in _ABOVE:
            at = c.children(at)[0]
        merge = Mergeable.of(c, at) if self.strategy == INCREMENTAL else None
        return c, self._plan, merge

    def _side_names(self, c: Catalyst, side) -> list[str]:
        return [self.naming.aux_column(f"c{k}") for k in range(len(c.output(side)))]

    def _joined(self, c: Catalyst) -> DataFrame:
        """The rows of the plan over the stored sides of its joins."""
        place = iter(range(len(_sides(c, self._plan))))

        def put(node):
            if not _joins(c, node):
                return c.bound(self.catalog.table(self.side_key(next(place))).as_of(), c.output(node))
            made = c.with_children(node, [put(x) for x in c.children(node)])
            lone = c.kind(node) == "Join" and not any(_joins(c, x) for x in c.children(node))
            return _dealt(c, made) if lone else made

        return c.frame(put(self._plan)).toDF(*self.names)

    def _leaf(self, c: Catalyst, leaf) -> tuple[VersionedTable, list[str]]:
        catalog, key = self._leaves[_folder(c.root_path(leaf))]
        return self.catalogs[catalog].table(key), [a.name() for a in c.output(leaf)]

    def _at(self, c: Catalyst, versions: dict[str, int]):
        def leaf(x) -> DataFrame:
            table, names = self._leaf(c, x)
            return table.as_of(versions[table.catalog.name]).select(*[f"`{n}`" for n in names])

        return leaf

    def _state_names(self, merge: Mergeable) -> list[str]:
        """The names under which the columns of the hidden state are stored."""
        return [self.naming.aux_column(c) for c in merge.columns]

    def recompute(self, versions: dict[str, int] | None = None) -> DataFrame:
        """The view's SQL over its base tables at some versions (by default now)."""
        versions = versions or self._now()
        frames = {name: self.catalogs[cat].table(key).as_of(versions[cat]) for name, (cat, key) in self._bindings.items() if key in self.base_tables}
        return _analysed(self.spark, self.view_sql, frames, set(self.catalogs)).toDF(*self.names)

    def _now(self) -> dict[str, int]:
        return {c: self.catalogs[c].latest_version() for c in set(self.base_tables.values())}

    # -- life ------------------------------------------------------------------
    def create(self, at: dict[str, int] | None = None) -> None:
        """Computes the view (at some versions of its sources, by default now) and stores it, its hidden state and its cursors as one version."""
        now = at or self._now()
        c, plan, merge = self._parts()
        leaf, scratch, made = self._at(c, now), [], {}
        factors = Factors.of(merge, Deltas(c, leaf, leaf, lambda x: None)) if merge else None
        try:
            if self.stored == SIDES:
                rules = Deltas(c, leaf, leaf, lambda x: None)
                made = {self.side_key(i): rules.state(x, leaf).toDF(*self._side_names(c, x)) for i, x in enumerate(_sides(c, plan))}
            elif factors:
                # a row a group; it is written, as the state and the view both come from it
                state = self.catalog.scratch(factors.sums(NEW).select(*merge.columns), scratch)
                made[self.key] = c.frame(self._above(c, plan, merge, merge.rows(state))).toDF(*self.names)
            else:
                made[self.key] = self.recompute(now)
            if merge:
                child = c.children(merge.plan)[0]
                if not factors:
                    state = merge.initial(c.frame(c.rewritten(child, lambda x: c.bound(leaf(x), c.output(x)))), child).select(*merge.columns)
                made[self.state_key] = state.toDF(*self._state_names(merge))
            self.catalog.commit({}, made, {self._cursor(k): v for k, v in now.items()})
        finally:
            for path in scratch:
                self.catalog.files.remove(path)

    def _above(self, c: Catalyst, plan, merge: Mergeable, rows: DataFrame):
        """The plan with the rows of its aggregate in place of it."""
        if plan == merge.plan:
            return c.bound(rows, c.output(plan))
        return c.with_children(plan, [self._above(c, c.children(plan)[0], merge, rows)])

    def pending_by_source(self) -> dict[str, int]:
        """For each source catalog, its versions since the cursor that changed a base table."""
        out = {}
        for cat, cursor in self.cursors().items():
            end = self.catalogs[cat].latest_version()
            out[cat] = len({v for key, at in self.base_tables.items() if at == cat for v in self.catalogs[cat].table(key).changed_in(cursor + 1, end)})
        return out

    def pending(self) -> int:
        return sum(self.pending_by_source().values())

    def pending_rows(self) -> int:
        """Rows in the change feeds of the base tables since the cursor."""
        held = self.cursors()
        return sum(self.catalogs[cat].table(key).changes(held[cat] + 1, self.catalogs[cat].latest_version()).count() for key, cat in self.base_tables.items())

    def maintain(self, to: dict[str, int] | None = None) -> int | None:
        """Brings the view up to some versions of its sources (by default those found at the start).

        Returns the version made, or None if the view's rows did not change.
        """
        old, new = self.cursors(), self._now() | (to or {})
        moved = {self._cursor(k): v for k, v in new.items()}
        touched = [(cat, key) for key, cat in self.base_tables.items() if self.catalogs[cat].table(key).changed_in(old[cat] + 1, new[cat])]
        if not touched:
            if old != new:
                self.catalog.move_cursors(moved)
            return None
        before, scratch = self.catalog.latest_version(), []
        try:
            changes = self._incremental(old, new, touched, scratch) if self.strategy == INCREMENTAL else {self.key: minus(self.recompute(new), self.table.as_of(before))}
            after = self.catalog.commit(changes, cursors=moved)
        finally:
            for path in scratch:
                self.catalog.files.remove(path)
        return after if after != before else None

    def _incremental(self, old: dict[str, int], new: dict[str, int], touched: list[tuple[str, str]], scratch: list[str]) -> dict[str, DataFrame]:
        c, plan, merge = self._parts()
        deltas: dict[str, DataFrame | None] = {}

        def changed(leaf) -> DataFrame | None:
            table, names = self._leaf(c, leaf)
            if (table.catalog.name, table.key) not in touched:
                return None
            if table.fqn not in deltas:
                deltas[table.fqn] = table.delta(old[table.catalog.name] + 1, new[table.catalog.name], raw=True)
            return deltas[table.fqn].select(*[f"`{n}`" for n in names], W)

        if self.stored == SIDES:
            rules = Deltas(c, self._at(c, old), self._at(c, new), changed)
            moved = [(i, x, rules.of(x)) for i, x in enumerate(_sides(c, plan))]
            return {self.side_key(i): netted(delta, self._side_names(c, x)) for i, x, delta in moved if delta is not None}
        rules = Deltas(c, self._at(c, old), self._at(c, new), changed, stored=self.table.as_of(), root=plan)
        out: dict[str, DataFrame] = {}
        if merge:
            child = c.children(merge.plan)[0]
            factors = Factors.of(merge, rules)
            delta = None if factors else rules.of(child)
            step = factors.sums(CHANGED) if factors else merge.step(delta, child) if delta is not None else None
            if step is not None:
                # a row a group; it is written, as the state and the view both come from it
                step = self.catalog.scratch(step, scratch)

                def again(groups: DataFrame) -> DataFrame | None:
                    groups = self.catalog.scratch(groups, scratch)
                    if groups.isEmpty():
                        return None
                    keys = c.items(merge.plan.groupingExpressions())
                    if not keys:
                        return rules.state(child, rules.new)
                    touched = groups.toDF(*[f"k{i}" for i in range(len(keys))])
                    return self.catalog.scratch(c.frame(rules._only(rules.state(child, rules.new), child, keys, touched)), scratch)

                state = self.catalog.table(self.state_key).as_of().toDF(*merge.columns)
                moved = net(merge.advance(state, step, child, again))
                out[self.state_key] = moved.toDF(*self._state_names(merge), W)
                rules.known.append((merge.plan, merge.rows(moved)))
        delta = rules.of(plan)
        if delta is None:
            return {}
        return {self.key: netted(delta, self.names)} | out

    def query_mv(self) -> DataFrame:
        """The view's rows."""
        return self._joined(Catalyst(self.spark)) if self.stored == SIDES else self.table.as_of()


#: String literals of Spark's SQL, which no name is looked for in.
_LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def tables_named(spark: SparkSession, sql: str) -> set[tuple[str, ...]] | None:
    """The names of the tables that a query reads, as parsed; names of its own WITH are left out. None if it cannot be parsed."""
    c = Catalyst(spark)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return None
    found: set[tuple[str, ...]] = set()

    def walk(node, own: frozenset) -> None:
        kind = c.kind(node)
        if kind == "UnresolvedWith":
            for pair in c.items(node.cteRelations()):
                walk(pair._2(), own)
                own = own | {(pair._1().lower(),)}
        if kind == "UnresolvedRelation":
            name = tuple(x.lower() for x in c.items(node.multipartIdentifier()))
            if name not in own:
                found.add(name)
        for x in [*c.children(node), *c.items(node.subqueries().toIndexedSeq())]:
            walk(x, own)

    walk(plan, frozenset())
    return found


def _joins(c: Catalyst, node) -> bool:
    """Whether a join stands at or below a node."""
    return any(c.kind(x) == "Join" for x in c.nodes(node))


def _sides(c: Catalyst, plan) -> list:
    """The largest parts of a plan that hold no join, from left to right."""
    return [x for child in c.children(plan) for x in _sides(c, child)] if _joins(c, plan) else [plan]


def _dealt(c: Catalyst, join):
    """A join of two large tables, dealt out by its keys and a share of the left rows to SHARES times as many tasks as a shuffle has.

    What such a join makes can outgrow by far what it reads, so tasks are not put
    together by the size of their input, and the rows of a key are not one task's.
    """
    keys, sides, conf = c.equi_keys(join), c.children(join), c.spark._jsparkSession.sessionState().conf()
    frames = [c.frame(x) for x in sides]
    if not keys or not keys[0] or join.joinType().toString() not in {"Inner", "LeftOuter", "LeftSemi", "LeftAnti"}:
        return join
    if min(int(c.optimized(df).stats().sizeInBytes()) for df in frames) <= conf.autoBroadcastJoinThreshold():
        return join
    tasks = SHARES * conf.numShufflePartitions()
    if join.joinType().toString() == "Inner":
        return _in_blocks(c, join, keys, tasks)
    left = frames[0].withColumn(W, F.pmod(F.xxhash64(*frames[0].columns), F.lit(SHARES)).cast("int"))
    right = frames[1].withColumn(W, F.explode(F.array(*[F.lit(i) for i in range(SHARES)])))
    bound = [c.bound(df, c.output(x)) for df, x in zip((left, right), sides, strict=True)]
    share, some = [c.output(x)[-1] for x in bound], c.jvm.scala.Option
    dealt = [c._logical.RepartitionByExpression(c.seq([*k, w]), x, some.apply(tasks), some.empty()) for k, w, x in zip(keys, share, bound, strict=True)]
    on = c._expressions.And(join.condition().get(), c._expressions.EqualTo(*share))
    return c.project(c.output(join), c._logical.Join(*dealt, join.joinType(), some.apply(on), join.hint()))


def _in_blocks(c: Catalyst, join, keys: tuple[list, list], tasks: int):
    """An inner join, dealt out, that gives for BLOCK left rows and each right row in turn all their pairs.

    So the right columns stay the same over a block, and the left ones come again
    after it: Parquet keeps such rows in a fraction of what it needs where a left
    row meets all right ones first. Blocks of other than a multiple of eight rows
    would not come again at a whole byte; what is over is a block of its own.
    """
    sides, n = c.children(join), len(keys[0])
    wide = [c.frame(c.project([*c.output(x), *[c.alias(k, "k") for k in ks]], x)) for x, ks in zip(sides, keys, strict=True)]
    left, right = (df.toDF(*[f"{side}{i}" for i in range(len(df.columns) - n)], *[f"{side}k{i}" for i in range(n)]) for side, df in zip("ab", wide, strict=True))
    own, others, on = left.columns[:-n], right.columns[:-n], [left.columns[-n:], right.columns[-n:]]
    left = left.withColumn("aw", F.pmod(F.xxhash64(*own), F.lit(SHARES)).cast("int")).repartition(tasks, *on[0], "aw")
    right = right.withColumn("bw", F.explode(F.array(*[F.lit(i) for i in range(SHARES)]))).repartition(tasks, *on[1], "bw")
    by = [*on[0], "aw"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*own)))
    rows = left.withColumn("block", F.floor((place - 1) / BLOCK)).groupBy(*by, "block").agg(F.collect_list(F.struct(*own)).alias("rows"))
    whole = F.size("rows") - F.size("rows") % 8
    blocks = rows.select(*by, F.explode(F.array(F.slice("rows", F.lit(1), whole), F.slice("rows", whole + 1, F.size("rows") % 8))).alias("rows"))
    met = blocks.join(right, [blocks[a] == right[b] for a, b in zip(by, [*on[1], "bw"], strict=True)])
    pairs = c.bound(met.select(F.inline("rows").alias(*own), *others), c.output(join))
    rest = c.other_condition(join)
    return pairs if rest is None else c._logical.Filter(rest, pairs)


def _folder(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for temporary names, under the same settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    return own


def _analysed(spark: SparkSession, sql: str, frames: dict[str, DataFrame], catalogs: set[str]) -> DataFrame:
    """A query over frames under names; qualified names (catalog.schema.table, schema.table) are bound as well."""
    own = _session(spark)
    for name, df in frames.items():
        flat = name.replace(".", "__")
        if "." in name:
            pattern = r"\.".join(rf"`?{re.escape(p)}`?" for p in name.split("."))
            sql = re.sub(rf"({_LITERAL})|(?<![\w.`]){pattern}(?![\w`])", lambda m, flat=flat: m.group(1) or f"`{flat}`", sql)
        jdf = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
        DataFrame(jdf, own).createOrReplaceTempView(flat)
    made = own.sql(sql)
    jdf = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, made._jdf.queryExecution().analyzed())
    return DataFrame(jdf, spark)


def _bindings(catalogs: dict[str, Catalog], mv_catalog: str, mv_schema: str, sources: dict[str, dict] | None) -> dict[str, tuple[str, str]]:
    """What each name in a view's SQL may mean: name -> (catalog, schema.table)."""
    out: dict[str, tuple[str, str]] = {}
    for cat, catalog in catalogs.items():
        for key in catalog.tables():
            schema, table = key.split(".", 1)
            if table.startswith("_state_"):
                continue
            out[f"{cat}.{key}"] = (cat, key)
            if cat == mv_catalog:
                out[key] = (cat, key)
                if schema == "main" or (schema == mv_schema and table not in out):
                    out[table] = (cat, key)
    for table, at in (sources or {}).items():
        out[table] = (at["catalog"], f"{at.get('schema', 'main')}.{table}")
    return out


def _stub(catalog: Catalog, key: str) -> str:
    """A Parquet file without rows that stands for a table while a view is compiled."""
    schema = json.dumps(catalog.table(key)._meta.schema, sort_keys=True)
    path = f"{catalog.root}/_stubs/{key}-{hashlib.md5(schema.encode()).hexdigest()[:12]}"
    if not catalog.files.exists(f"{path}/_SUCCESS"):
        catalog.spark.createDataFrame([], catalog.table(key).schema).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def _expressions(c: Catalyst, plan) -> list:
    out = []

    def walk(e) -> None:
        out.append(e)
        for x in c.children(e):
            walk(x)

    for node in c.nodes(plan):
        for e in c.items(node.expressions().toIndexedSeq()):
            walk(e)
        for sub in c.items(node.subqueries().toIndexedSeq()):
            out.extend(_expressions(c, sub))
    return out


def _all_leaves(c: Catalyst, plan) -> list:
    out = c.leaves(plan)
    for node in c.nodes(plan):
        for sub in c.items(node.subqueries().toIndexedSeq()):
            out += _all_leaves(c, sub)
    return out


def _features(c: Catalyst, analysed, expressions: list, sql: str) -> set[str]:
    out = {"select"}
    for node in c.nodes(analysed):
        kind = c.kind(node)
        if kind == "Filter":
            out.add("having" if c.kind(c.children(node)[0]) == "Aggregate" else "where")
        elif kind == "Distinct":
            out.add("union_distinct" if c.kind(c.children(node)[0]) == "Union" else "distinct")
        elif kind == "Union":
            out.add("union_all")
        elif kind in {"Except", "Intersect"}:
            out.add(f"{kind.lower()}_{'all' if node.isAll() else 'distinct'}")
        elif kind == "Aggregate" and node.groupingExpressions().size():
            out.add("group_by")
        elif kind == "Join" and (tag := _JOINS.get(node.joinType().toString())):
            out.add(tag)
    if "union_distinct" in out and not re.search(r"\bunion\s+all\b", sql, re.I):
        out.discard("union_all")
    for e in expressions:
        if c.kind(e) == "AggregateExpression" and (tag := _AGGREGATES.get(c.kind(e.aggregateFunction()))):
            out.add(tag)
    return out


def compile_ivm(
    view_sql: str,
    *,
    spark: SparkSession,
    catalogs: dict[str, Catalog],
    name: str = "mv",
    naming: Naming | None = None,
    mv_catalog: str = "dl",
    mv_schema: str = "main",
    sources: dict[str, dict] | None = None,
    strategy: str | None = None,
    stored: str = ROWS,
) -> MaterializedView:
    """Compiles a view over tables of `catalogs`.

    sources: for tables that are not in the view's own catalog,
    {table: {"catalog": ..., "schema": ...}}. strategy="full_refresh" forces that path.
    stored="sides" is for joins whose rows outnumber by far those that they join: the
    sides are kept up, and joined when the view is read.
    """
    c = Catalyst(spark)
    bindings = _bindings(catalogs, mv_catalog, mv_schema, sources)
    mentioned = {n: at for n, at in bindings.items() if re.search(rf"(?<![\w])`?{re.escape(n.split('.')[-1])}`?(?![\w])", view_sql, re.I)}
    paths = {n: _stub(catalogs[cat], key) for n, (cat, key) in mentioned.items()}
    frames = {n: spark.read.schema(catalogs[at[0]].table(at[1]).schema).parquet(paths[n]) for n, at in mentioned.items()}
    try:
        df = _analysed(spark, view_sql, frames, set(catalogs))
    except ParseException as e:
        raise UnsupportedSQLError("syntax", str(e)) from e
    except AnalysisException as e:
        if re.search(r"\bhaving\b", view_sql, re.I) and not re.search(r"\bgroup\s+by\b", view_sql, re.I):
            raise UnsupportedSQLError("having_no_agg", "HAVING without an aggregate") from e
        raise
    analysed, plan = df._jdf.queryExecution().analyzed(), c.optimized(df)
    expressions = _expressions(c, analysed)
    if any(not e.deterministic() for e in expressions if c.kind(e) not in {"AttributeReference"}) or any(c.kind(e) in _UNSTABLE for e in expressions):
        raise UnsupportedSQLError("non_deterministic", "the view's rows would depend on when it is computed")
    folders = {_folder(paths[n]): at for n, at in mentioned.items()}
    used = {folders[f] for x in _all_leaves(c, analysed) if (p := c.root_path(x)) and (f := _folder(p)) in folders}
    if not used:
        raise UnsupportedSQLError("no_table", "a view needs a table")
    names = df.columns
    if len(set(map(str.lower, names))) < len(names):
        raise UnsupportedSQLError("duplicate_column", "columns of a view need different names")
    reason = None
    kinds = {c.kind(n) for n in c.nodes(plan)}
    if strategy == FULL:
        reason = "forced"
    elif any(n.subqueries().size() for n in c.nodes(plan)):
        reason = "scalar_subquery"
    elif kinds & {"GlobalLimit", "LocalLimit", "Limit", "Offset", "Tail", "Sample"}:
        reason = "limit"
    elif any(c.root_path(x) is None for x in c.leaves(plan)):
        reason = "folded_relation"
    elif "map" in " ".join(t for _, t in df.dtypes).split("<")[0:1]:
        reason = "map_column"
    above = {c.kind(n) for n in c.nodes(plan) if _joins(c, n)}
    if stored == SIDES and (reason or not above or not above <= {"Join", "Project", "Filter"}):
        raise UnsupportedSQLError("stored_sides", "only joins under projections and filters are stored as their sides")
    features = _features(c, analysed, expressions, view_sql)
    if reason:
        features.add("full_refresh")
    return MaterializedView(
        spark, catalogs, view_sql, name, mv_catalog, mv_schema, naming or Naming(name), {key: cat for cat, key in sorted(used)}, features, FULL if reason else INCREMENTAL, reason, names, plan, folders, {n: at for n, at in mentioned.items() if at in used}, stored=stored
    )
