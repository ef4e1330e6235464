"""Aggregates at the root of a view that are kept up from stored partial sums.

SUM, COUNT and AVG of exact types need neither the old nor the new base rows: a
hidden state holds for each group the number of rows and, for each aggregate,
the sum and the number of values that are not null. A cycle aggregates the
signed change once, adds it to the state of the groups it touches, and drops
groups without rows. MIN and MAX are kept as well: only groups that lose a row
which holds their extreme are computed from base rows again. An aggregate
without GROUP BY is one group that stays without rows. Floating-point sums are left to the group rule: adding and taking away would
drift from what a fresh computation gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bag import W, matching, net, plus, same, signed
from .catalyst import Catalyst

EXACT = ("ByteType", "ShortType", "IntegerType", "LongType", "DecimalType")


def _fits(decimal) -> bool:
    """Whether sums of 10**10 values of a decimal type fit the state's type."""
    return decimal.scale() <= 10 and decimal.precision() - decimal.scale() <= 18


@dataclass
class Part:
    """One aggregate function: its kind and the positions of its inputs in the state's input."""

    kind: str
    inputs: list[int]


class Mergeable:
    """The hidden state of an Aggregate node, or None from ``of`` if it needs the group rule."""

    def __init__(self, catalyst: Catalyst, plan, keys: list, parts: list[Part], inputs: list, functions: list):
        self.catalyst, self.plan, self.keys, self.parts, self.inputs, self.functions = catalyst, plan, keys, parts, inputs, functions

    @classmethod
    def of(cls, catalyst: Catalyst, plan) -> Mergeable | None:
        c = catalyst
        if c.kind(plan) != "Aggregate":
            return None
        keys = c.items(plan.groupingExpressions())
        parts, inputs, functions = [], [], []

        def walk(e) -> bool:
            if c.kind(e) == "AggregateExpression":
                f = e.aggregateFunction()
                kind, args = c.kind(f), c.items(f.children())
                if e.isDistinct() or e.filter().isDefined() or kind not in {"Sum", "Count", "Average", "Min", "Max"}:
                    return False
                if kind in {"Sum", "Average"} and not c.kind(args[0].dataType()).rstrip("$").startswith(EXACT if kind == "Sum" else EXACT[:-1]):
                    return False
                if kind == "Sum" and c.kind(args[0].dataType()) == "DecimalType" and not _fits(args[0].dataType()):
                    return False
                at = []
                for a in args:
                    at.append(len(inputs))
                    inputs.append(a)
                parts.append(Part(kind, at))
                functions.append(e)
                return True
            return all(walk(x) for x in c.children(e))

        if not all(walk(e) for e in c.items(plan.aggregateExpressions())):
            return None
        return cls(c, plan, keys, parts, inputs, functions)

    @property
    def extremes(self) -> list[tuple[int, str]]:
        return [(i, p.kind) for i, p in enumerate(self.parts) if p.kind in {"Min", "Max"}]

    @property
    def group(self) -> list[str]:
        return [f"g{i}" for i in range(max(1, len(self.keys)))]

    @property
    def columns(self) -> list[str]:
        """The columns of the state."""
        kept = {"Sum": "s", "Average": "s", "Min": "m", "Max": "m"}
        return [*self.group, "n", *(f"{x}{i}" for i, p in enumerate(self.parts) for x in (kept.get(p.kind), "k") if x)]

    def _prepared(self, rows: DataFrame, child) -> DataFrame:
        """Group values, inputs and weight of signed rows of the node's child."""
        c = self.catalyst
        below = c.bound(rows, c.output(child))
        exprs = [c.alias(e, f"g{i}") for i, e in enumerate(self.keys)] + [c.alias(e, f"x{i}") for i, e in enumerate(self.inputs)]
        out = c.frame(c.project([*exprs, c.output(below)[-1]], below))
        inputs = [f"x{i}" for i in range(len(self.inputs))]
        if self.keys:
            return out.toDF(*self.group, *inputs, W)
        return out.toDF(*inputs, W).select(F.lit(1).alias("g0"), *inputs, W)

    def _sums(self) -> list[Column]:
        out = [F.coalesce(F.sum(W), F.lit(0)).alias("n")]
        for i, p in enumerate(self.parts):
            x = [F.col(f"x{k}") for k in p.inputs]
            known = F.lit(True)
            for v in x:
                known = known & v.isNotNull()
            if p.kind in {"Sum", "Average"}:
                out.append(F.coalesce(F.sum(x[0] * F.col(W)), F.lit(0)).cast("decimal(38,10)").alias(f"s{i}"))
            if p.kind in {"Min", "Max"}:
                out.append((F.min if p.kind == "Min" else F.max)(F.when(F.col(W) > 0, x[0])).alias(f"m{i}"))
            out.append(F.coalesce(F.sum(F.when(known, F.col(W)).otherwise(0)), F.lit(0)).alias(f"k{i}"))
        return out

    def initial(self, rows: DataFrame, child) -> DataFrame:
        prepared = self._prepared(signed(rows), child)
        if self.keys:
            return prepared.groupBy(*self.group).agg(*self._sums())
        return prepared.agg(*self._sums()).select(F.lit(1).alias("g0"), "*")

    def step(self, delta: DataFrame, child) -> DataFrame:
        """The signed rows of the node's child by group: what `initial` holds, and the extremes l0, l1, ... of rows taken away."""
        prepared = self._prepared(delta, child)
        if self.extremes:
            prepared = net(prepared)  # a row that comes and goes is no candidate for an extreme
        lost = [(F.min if kind == "Min" else F.max)(F.when(F.col(W) < 0, F.col(f"x{self.parts[i].inputs[0]}"))).alias(f"l{i}") for i, kind in self.extremes]
        return prepared.groupBy(*self.group).agg(*self._sums(), *lost)

    def broken(self, state: DataFrame, step: DataFrame) -> DataFrame:
        """The groups that lose a row which holds one of their extremes."""
        lost = step.select(*self.group, *[f"l{i}" for i, _ in self.extremes])
        gone = F.lit(False)
        for i, kind in self.extremes:
            gone = gone | F.coalesce((F.col(f"l{i}") <= F.col(f"m{i}")) if kind == "Min" else (F.col(f"l{i}") >= F.col(f"m{i}")), F.lit(False))
        return state.join(lost, same(state, lost, self.group)).where(gone).select(*[state[g] for g in self.group])

    def advance(self, state: DataFrame, step: DataFrame, child, again: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
        """The signed change of the state.

        step: as made by `step`; again: the new rows of the child in some groups,
        or None if there are none of these groups.
        """
        old = matching(state, step.select(*self.group))
        plain = step.select(*old.columns)
        merged, fresh = old, None
        if self.extremes:
            groups = self.broken(state, step)
            rows = again(groups)
            if rows is not None:
                fresh = self.initial(rows, child).select(*old.columns)
                merged, plain = matching(old, groups, "left_anti"), matching(plain, groups, "left_anti")
        add = [F.sum("n").alias("n")]
        for i, p in enumerate(self.parts):
            if p.kind in {"Sum", "Average"}:
                add.append(F.sum(f"s{i}").cast("decimal(38,10)").alias(f"s{i}"))
            if p.kind in {"Min", "Max"}:
                add.append((F.min if p.kind == "Min" else F.max)(f"m{i}").alias(f"m{i}"))
            add.append(F.sum(f"k{i}").alias(f"k{i}"))
        new = merged.union(plain).groupBy(*self.group).agg(*add).select(*old.columns)
        if self.keys:
            new = new.where("n > 0")
        return plus([*(signed(x) for x in (new, fresh) if x is not None), signed(old, -1)])

    def rows(self, state: DataFrame) -> DataFrame:
        """What the node returns, from signed or plain state rows; _w stays last."""
        c = self.catalyst
        weighted = W in state.columns
        values = []
        for i, (p, f) in enumerate(zip(self.parts, self.functions, strict=True)):
            kind = self.plan_type(f)
            if p.kind == "Count":
                v = F.col(f"k{i}")
            elif p.kind == "Sum":
                v = F.when(F.col(f"k{i}") > 0, F.col(f"s{i}"))
            elif p.kind == "Average":
                s = F.col(f"s{i}").cast("double") if kind == "double" else F.col(f"s{i}")
                v = F.when(F.col(f"k{i}") > 0, F.try_divide(s, F.col(f"k{i}")))
            else:
                v = F.when(F.col(f"k{i}") > 0, F.col(f"m{i}"))
            values.append(v.cast(kind).alias(f"v{i}"))
        df = state.select(*self.group, *values, *[W] * weighted)
        plan = df._jdf.queryExecution().analyzed()
        own = c.output(plan)
        groups, results = own[: len(self.keys)], own[len(self.group) : len(self.group) + len(self.parts)]

        def put(e):
            if c.kind(e) == "AggregateExpression":
                at = next(i for i, f in enumerate(self.functions) if f.semanticEquals(e))
                return results[at]
            for k, g in zip(self.keys, groups, strict=True):
                if e.semanticEquals(k):
                    return g
            below = c.children(e)
            return e.withNewChildren(c.seq([put(x) for x in below])) if below else e

        exprs = []
        for e in c.items(self.plan.aggregateExpressions()):
            inner = e.child() if c.kind(e) == "Alias" else e
            exprs.append(c.alias(put(inner), e.name(), e.exprId()))
        return c.frame(c.project([*exprs, *(own[-1:] if weighted else [])], plan))

    @staticmethod
    def plan_type(function) -> str:
        return function.dataType().sql().lower()
