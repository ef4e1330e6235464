"""Catalyst's logical plans, reached from Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.bag import W


class Catalyst:
    """Building blocks of logical plans for one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self._logical = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self._expressions = self.jvm.org.apache.spark.sql.catalyst.expressions

    # -- Scala collections -------------------------------------------------
    def seq(self, items: Iterable[Any]):
        out = self.jvm.java.util.ArrayList()
        for x in items:
            out.add(x)
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(out).toIndexedSeq()

    @staticmethod
    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    @staticmethod
    def kind(node) -> str:
        return node.getClass().getSimpleName()

    def children(self, node) -> list:
        return self.items(node.children())

    def output(self, plan) -> list:
        return self.items(plan.output())

    # -- plans and frames ----------------------------------------------------
    def optimized(self, df: DataFrame):
        return df._jdf.queryExecution().optimizedPlan()

    def frame(self, plan) -> DataFrame:
        """A frame over a plan, with columns named by position, c0, c1, ..., and a last one _w if the plan has it."""
        jdf = self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        df = DataFrame(jdf, self.spark)
        names = [a.name() for a in self.output(plan)]
        weighted = names[-1:] == [W]
        return df.toDF(*[f"c{i}" for i in range(len(names) - weighted)], *[W] * weighted)

    def alias(self, child, name: str, expr_id=None):
        ids = self._expressions.NamedExpression
        none = self.jvm.scala.Option.empty()
        return self._expressions.Alias(child, name, expr_id if expr_id is not None else ids.newExprId(), self.seq([]), none, self.seq([]))

    def project(self, exprs: Iterable[Any], child):
        return self._logical.Project(self.seq(exprs), child)

    def bound(self, df: DataFrame, attributes: list):
        """A plan of `df` whose columns, by position, are the given attributes; a further column _w stays at the end."""
        plan = df._jdf.queryExecution().analyzed()
        own = self.output(plan)
        exprs = [self.alias(o, a.name(), a.exprId()) for o, a in zip(own, attributes, strict=False)]
        if len(own) > len(attributes):
            exprs.append(self.alias(own[-1], W))
        return self.project(exprs, plan)

    def with_children(self, node, children: list):
        return node.withNewChildren(self.seq(children))

    def rewritten(self, plan, leaf: Callable[[Any], Any]):
        """The plan with each leaf put in place by `leaf`."""
        children = self.children(plan)
        return leaf(plan) if not children else self.with_children(plan, [self.rewritten(c, leaf) for c in children])

    def leaves(self, plan) -> list:
        children = self.children(plan)
        return [x for c in children for x in self.leaves(c)] if children else [plan]

    def nodes(self, plan) -> list:
        return [plan, *(x for c in self.children(plan) for x in self.nodes(c))]

    def root_path(self, leaf) -> str | None:
        """The folder that a file relation reads, if the leaf is one."""
        if self.kind(leaf) != "LogicalRelation" or not leaf.relation().getClass().getSimpleName().startswith("HadoopFsRelation"):
            return None
        return leaf.relation().location().rootPaths().apply(0).toString()

    def has_subquery(self, plan) -> bool:
        return any(n.subqueries().size() > 0 for n in self.nodes(plan))

    def equi_keys(self, join) -> tuple[list, list] | None:
        """Expressions of the left and the right side that a join sets equal."""
        found = self.jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(join)
        return None if found.isEmpty() else (self.items(found.get()._2()), self.items(found.get()._3()))

    def other_condition(self, join):
        """What a join with `equi_keys` asks of its rows besides them; None if nothing."""
        rest = self.jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(join).get()._4()
        return None if rest.isEmpty() else rest.get()
