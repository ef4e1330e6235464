"""Rules that turn changes of base tables into changes of a view.

Every node of an optimised plan has an old state (leaves as of the cursor), a
new state (leaves as of the end of the cycle) and a signed change. Nodes that
are linear pass changes on; an inner join multiplies them with the other side;
an outer, semi or anti join, an aggregate or a window works on the keys that the
changes touch, once on the old state and once on the new; anything else is
compared whole. A side without changes adds no term.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bag import W, columns, matching, minus, name, net, plus, signed
from .catalyst import Catalyst

LINEAR = {"Project", "Filter", "Generate", "Sort", "SubqueryAlias", "RepartitionByExpression", "Repartition", "RebalancePartitions"}
KEYED_JOINS = {"LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "ExistenceJoin"}


@dataclass
class Deltas:
    """Changes of the nodes of one plan in one cycle.

    old, new: the state of a leaf before and after; changed: its signed change,
    or None if it has none (known from the log, without a job).
    """

    catalyst: Catalyst
    old: Callable[[object], DataFrame]
    new: Callable[[object], DataFrame]
    changed: Callable[[object], DataFrame | None]
    #: The stored result of the root, which spares computing its old state.
    stored: DataFrame | None = None
    root: object = None
    #: Changes of nodes that are known from elsewhere, as (node, signed change).
    known: list[tuple[object, DataFrame]] = field(default_factory=list)
    compared_whole: list[str] = field(default_factory=list)

    # -- states ----------------------------------------------------------
    def state(self, plan, leaf: Callable[[object], DataFrame]) -> DataFrame:
        c = self.catalyst
        return c.frame(c.rewritten(plan, lambda x: c.bound(leaf(x), c.output(x))))

    def both(self, plan) -> tuple[DataFrame, DataFrame]:
        return self.state(plan, self.old), self.state(plan, self.new)

    # -- rules -----------------------------------------------------------
    def of(self, plan) -> DataFrame | None:
        """The signed change of a node, columns by position, or None if nothing below it changed."""
        c = self.catalyst
        kind, children = c.kind(plan), c.children(plan)
        if not children:
            return self.changed(plan)
        for node, delta in self.known:
            if plan == node:
                return delta
        if all(self.changed(x) is None for x in c.leaves(plan)):
            return None
        if kind in LINEAR:
            return self._linear(plan, children[0])
        if kind == "Union":
            return plus([d for d in map(self.of, children) if d is not None])
        if kind == "Expand":
            return self._expand(plan, children[0])
        if kind == "Join":
            how = plan.joinType().toString()
            how = how.split("(")[0]
            if how in {"Inner", "Cross"}:
                return self._inner(plan, *children)
            keys = c.equi_keys(plan) if how in KEYED_JOINS else None
            if keys and keys[0]:
                return self._keyed_join(plan, children, keys)
            return self._whole(plan)
        if kind == "Aggregate" and plan.groupingExpressions().size():
            return self._by_keys(plan, children[0], c.items(plan.groupingExpressions()))
        if kind == "Window" and plan.partitionSpec().size():
            return self._by_keys(plan, children[0], c.items(plan.partitionSpec()))
        return self._whole(plan)

    def _whole(self, plan) -> DataFrame:
        self.compared_whole.append(self.catalyst.kind(plan))
        old, new = self.both(plan)
        return minus(new, old)

    def _weighted(self, plan, child: DataFrame, at):
        """A node over a signed child, its own columns first and _w last."""
        c = self.catalyst
        below = c.bound(child, c.output(at))
        w = c.output(below)[-1]
        if c.kind(plan) == "Project":
            return c.project([*c.items(plan.projectList()), w], below)
        made = c.with_children(plan, [below])
        return c.project([*c.output(plan), w], made)

    def _linear(self, plan, child) -> DataFrame:
        delta = self.of(child)
        if self.catalyst.kind(plan) in {"Sort", "RepartitionByExpression", "Repartition", "RebalancePartitions"}:
            return delta
        return self.catalyst.frame(self._weighted(plan, delta, child))

    def _expand(self, plan, child) -> DataFrame:
        c = self.catalyst
        below = c.bound(self.of(child), c.output(child))
        w = c.output(below)[-1]
        rows = c.seq(c.seq([*c.items(p), w]) for p in c.items(plan.projections()))
        made = c._logical.Expand(rows, c.seq([*c.output(plan), w]), below)
        return c.frame(made)

    def _inner(self, plan, left, right) -> DataFrame:
        c = self.catalyst
        terms = []
        for at, leaf in ((0, self.new), (1, self.old)):
            delta = self.of((left, right)[at])
            if delta is None:
                continue
            mine = c.bound(delta, c.output((left, right)[at]))
            w = c.output(mine)[-1]
            other = (right, left)[at]
            rest = c.rewritten(other, lambda x, leaf=leaf: c.bound(leaf(x), c.output(x)))
            sides = [mine, rest] if at == 0 else [rest, mine]
            terms.append(c.frame(c.project([*c.output(plan), w], c.with_children(plan, sides))))
        return plus(terms)

    def _with_keys(self, df: DataFrame, at, keys: list) -> DataFrame:
        """A frame with the values of key expressions beside its columns, as k0, k1, ..."""
        c = self.catalyst
        weighted = W in df.columns
        below = c.bound(df, c.output(at))
        own = c.output(below)
        exprs = own[:-1] if weighted else own
        named = [c.alias(k, f"k{i}") for i, k in enumerate(keys)]
        out = c.frame(c.project([*exprs, *named, *(own[-1:] if weighted else [])], below))
        n = len(exprs)
        return out.toDF(*[f"c{i}" for i in range(n)], *[f"k{i}" for i in range(len(keys))], *[W] * weighted)

    def _touched(self, delta: DataFrame, at, keys: list) -> DataFrame:
        return self._with_keys(delta, at, keys).select(*[f"k{i}" for i in range(len(keys))])

    def _only(self, state: DataFrame, at, keys: list, touched: DataFrame):
        """The rows of a node's state that have one of the keys, as a plan with the node's attributes."""
        c = self.catalyst
        rows = matching(self._with_keys(state, at, keys), touched)
        return c.bound(rows.select(*[f"c{i}" for i in range(len(c.output(at)))]), c.output(at))

    def _keyed_join(self, plan, children: list, keys: tuple[list, list]) -> DataFrame:
        c = self.catalyst
        touched = [self._touched(d, at, k) for at, k in zip(children, keys, strict=True) if (d := self.of(at)) is not None]
        touched = plus(touched).distinct()
        made = []
        for leaf in (self.old, self.new):
            sides = [self._only(self.state(at, leaf), at, k, touched) for at, k in zip(children, keys, strict=True)]
            made.append(c.frame(c.with_children(plan, sides)))
        return plus([signed(made[1]), signed(made[0], -1)])

    def _by_keys(self, plan, child, keys: list) -> DataFrame:
        """An aggregate or a window, over the groups that changed."""
        c = self.catalyst
        touched = self._touched(self.of(child), child, keys).distinct()
        new = c.frame(c.with_children(plan, [self._only(self.state(child, self.new), child, keys, touched)]))
        old = self._stored_groups(plan, keys, touched) if self.stored is not None and plan == self.root else None
        if old is None:
            old = c.frame(c.with_children(plan, [self._only(self.state(child, self.old), child, keys, touched)]))
        return plus([signed(new), signed(old, -1)])

    def _stored_groups(self, plan, keys: list, touched: DataFrame) -> DataFrame | None:
        """The old rows of an aggregate at the root, from what is stored, if all keys are among its columns."""
        c = self.catalyst
        if c.kind(plan) != "Aggregate":
            return None
        at = []
        for k in keys:
            found = next((i for i, e in enumerate(c.items(plan.aggregateExpressions())) if k.semanticEquals(e.child() if c.kind(e) == "Alias" else e)), None)
            if found is None:
                return None
            at.append(found)
        stored = self.stored.toDF(*[f"c{i}" for i in range(len(self.stored.columns))])
        named = stored.select("*", *[F.col(f"c{i}").alias(f"k{j}") for j, i in enumerate(at)])
        return matching(named, touched).select(*stored.columns)


def netted(delta: DataFrame, names: list[str]) -> DataFrame:
    """A root's change under the view's column names, copies summed and cancelled."""
    return net(delta.toDF(*names, W))


__all__ = ["Deltas", "columns", "name", "netted"]
