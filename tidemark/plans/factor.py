"""Sums over inner joins from sums of the joined sides, so that the join's rows are never made.

A side of an equi-join is summed up by the join's keys and those group keys that
come from it: its number of rows and, for each aggregate over its columns, the
sum and the number of values that are not null. Two such rows that meet stand
for as many joined rows as the product of their numbers, and the sums of each
are multiplied by the number of the other. Sides that are joins themselves are
taken apart in the same way; anything else is computed as it is and summed up.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bag import W, plus, signed
from .delta import Deltas
from .merge import Mergeable

OLD, NEW, CHANGED = "old", "new", "changed"
#: Sums are kept as whole numbers of units of their type's scale, as products of decimals with a scale are rounded; this is the largest one that can be taken back.
MOST_SCALE = 6
_WHOLE = "decimal(38,0)"


class Factors:
    """The sums of a Mergeable whose child is an inner join, or None from ``of`` if the join cannot be taken apart."""

    def __init__(self, merge: Mergeable, rules: Deltas):
        self.merge, self.rules, self.catalyst = merge, rules, merge.catalyst
        self.child = self.catalyst.children(merge.plan)[0]
        self.scales = {i: _scale(merge.inputs[p.inputs[0]]) for i, p in enumerate(merge.parts) if p.kind in {"Sum", "Average"}}
        self.keys = list(zip(merge.group, merge.keys, strict=False))
        self.names = 0

    @classmethod
    def of(cls, merge: Mergeable, rules: Deltas) -> Factors | None:
        made = cls(merge, rules)
        if merge.extremes or any(s > MOST_SCALE for s in made.scales.values()):
            return None
        return made if made._sides(made.child, made.keys, list(range(len(merge.parts)))) else None

    def sums(self, when: str) -> DataFrame | None:
        """A row a group with the columns of the state: of the rows before or after a cycle, or of its signed change (None if nothing changed)."""
        parts = list(range(len(self.merge.parts)))
        rows = self._partial(self.child, when, self.keys, parts)
        if rows is None:
            return None
        back = {i: (F.col(f"s{i}") * F.lit(Decimal(1).scaleb(-s)) if s else F.col(f"s{i}")).cast("decimal(38,10)").alias(f"s{i}") for i, s in self.scales.items()}
        out = [back.get(int(c[1:]), F.col(c)) if c[0] == "s" else F.col(c) for c in self.merge.columns if c not in self.merge.group]
        return rows.select(*(self.merge.group if self.keys else [F.lit(1).alias("g0")]), *out)

    # -- one node ----------------------------------------------------------
    def _join(self, node):
        """The join that a node is, apart from columns left out above it."""
        c = self.catalyst
        while c.kind(node) == "Project" and all(c.kind(e) == "AttributeReference" for e in c.items(node.projectList())):
            node = c.children(node)[0]
        return node if c.kind(node) == "Join" and node.joinType().toString() in {"Inner", "Cross"} else None

    def _sides(self, node, keys: list, parts: list[int]) -> list[tuple] | None:
        """(side, join keys, group keys, aggregates) of both sides, if each group key and aggregate reads one side only."""
        c, join = self.catalyst, self._join(node)
        if join is None:
            return None
        both = ([], [])
        if join.condition().isDefined():
            found = c.jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(join)
            if found.isEmpty() or found.get()._4().isDefined():
                return None
            both = (c.items(found.get()._2()), c.items(found.get()._3()))
        out, left_keys, left_parts = [], len(keys), len(parts)
        for side, on in zip(c.children(join), both, strict=True):
            own = side.outputSet()
            reads = lambda e, own=own: e.references().subsetOf(own)
            mine = [k for k in keys if reads(k[1])]
            held = [i for i in parts if all(reads(self.merge.inputs[x]) for x in self.merge.parts[i].inputs)]
            keys, parts = [k for k in keys if k not in mine], [i for i in parts if i not in held]
            out.append((side, on, mine, held))
        if keys or parts or sum(len(x[2]) for x in out) != left_keys or sum(len(x[3]) for x in out) != left_parts:
            return None
        return out

    def _partial(self, node, when: str, keys: list, parts: list[int]) -> DataFrame | None:
        """Rows (key names, n, s and k of each aggregate), a row for each value of the keys."""
        sides = self._sides(node, keys, parts)
        if sides is None:
            return self._summed(node, when, keys, parts)
        (left, lon, lkeys, lparts), (right, ron, rkeys, rparts) = sides
        on = [f"j{self.names + i}" for i in range(len(lon))]
        self.names += len(on)
        terms = []
        for a, b in [(CHANGED, NEW), (OLD, CHANGED)] if when == CHANGED else [(when, when)]:
            x = self._partial(left, a, [*lkeys, *zip(on, lon, strict=True)], lparts)
            y = self._partial(right, b, [*rkeys, *zip(on, ron, strict=True)], rparts)
            if x is None or y is None:
                continue
            x, y = x.withColumnRenamed("n", "n_x"), y.withColumnRenamed("n", "n_y")
            met = x.join(y, on) if on else x.crossJoin(y)
            times = {i: F.col(other) for own, other in ((lparts, "n_y"), (rparts, "n_x")) for i in own}
            terms.append(met.select(*[g for g, _ in keys], (F.col("n_x") * F.col("n_y")).alias("n"), *[(F.col(v) * times[i]).cast(_WHOLE if v[0] == "s" else "long").alias(v) for i in parts for v in self._values(i)]))
        if not terms:
            return None
        values = ["n", *(v for i in parts for v in self._values(i))]
        return plus(terms).groupBy(*[g for g, _ in keys]).agg(*[_total(F.col(v), v) for v in values])

    def _summed(self, node, when: str, keys: list, parts: list[int]) -> DataFrame | None:
        c = self.catalyst
        if when == CHANGED:
            rows = self.rules.of(node)
            if rows is None:
                return None
        else:
            rows = signed(self.rules.state(node, self.rules.old if when == OLD else self.rules.new))
        below = c.bound(rows, c.output(node))
        inputs = [x for i in parts for x in self.merge.parts[i].inputs]
        exprs = [c.alias(e, g) for g, e in keys] + [c.alias(self.merge.inputs[x], f"x{x}") for x in inputs]
        names = [*(g for g, _ in keys), *(f"x{x}" for x in inputs)]
        out = c.frame(c.project([*exprs, c.output(below)[-1]], below)).toDF(*names, W)
        made = [_total(F.col(W), "n")]
        for i in parts:
            x = [F.col(f"x{k}") for k in self.merge.parts[i].inputs]
            known = reduce(lambda a, b: a & b, [v.isNotNull() for v in x], F.lit(True))
            if i in self.scales:
                units = (x[0] * F.lit(Decimal(10) ** self.scales[i]) if self.scales[i] else x[0]).cast(_WHOLE)
                made.append(_total((units * F.col(W)).cast(_WHOLE), f"s{i}"))
            made.append(_total(F.when(known, F.col(W)).otherwise(0), f"k{i}"))
        return out.groupBy(*[g for g, _ in keys]).agg(*made)

    def _values(self, i: int) -> list[str]:
        return [*([f"s{i}"] if i in self.scales else []), f"k{i}"]


def _scale(expression) -> int:
    kind = expression.dataType()
    return kind.scale() if kind.typeName().startswith("decimal") else 0


def _total(value: Column, name: str) -> Column:
    kind = _WHOLE if name[0] == "s" else "long"
    return F.coalesce(F.sum(value), F.lit(0)).cast(kind).alias(name)
