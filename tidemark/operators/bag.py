"""Bags as DataFrames: a column ``_w`` holds how often a row is added (positive) or taken away (negative)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "_w"
#: Copies of a row that are made at once.
REPEAT_BLOCK = 4096


def columns(df: DataFrame) -> list[str]:
    """The columns of a row, without its multiplicity."""
    return [c for c in df.columns if c != W]


def name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def signed(df: DataFrame, weight: int = 1) -> DataFrame:
    """A plain bag as a signed one, each row `weight` times."""
    return df.withColumn(W, F.lit(weight).cast("long"))


def net(delta: DataFrame) -> DataFrame:
    """One row for each distinct row whose multiplicities do not cancel; nulls are equal to each other."""
    return delta.groupBy(*[name(c) for c in columns(delta)]).agg(F.sum(W).alias(W)).where(name(W) != 0)


def plus(parts: list[DataFrame]) -> DataFrame:
    """The sum of signed bags with the same columns by position."""
    return reduce(DataFrame.union, parts)


def minus(new: DataFrame, old: DataFrame) -> DataFrame:
    """The signed bag that turns the plain bag `old` into `new`."""
    return net(plus([signed(new), signed(old, -1)]))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says (1 at least), in blocks, so that no row is held in one huge array."""
    whole = df.withColumn("_times", times).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / REPEAT_BLOCK))))
    size = F.least(F.lit(REPEAT_BLOCK).cast("long"), F.col("_times") - F.col("_block") * REPEAT_BLOCK)
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("_times", "_block", "_copy")


def expand(bag: DataFrame) -> DataFrame:
    """A plain bag again: each row as often as it is held."""
    return repeated(bag.where(name(W) > 0), name(W)).select(*[name(c) for c in columns(bag)])


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the named columns of two frames."""
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys])


def matching(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose columns named in `keys` are (left_semi) or are not (left_anti) among its rows; null matches null."""
    if not keys.columns:
        return df if how == "left_semi" else df.limit(0)
    own = keys.select(*[name(k).alias(f"_m{i}") for i, k in enumerate(keys.columns)])  # new columns, whatever the keys were made from
    return df.join(own, reduce(lambda a, b: a & b, [df[f"`{k}`"].eqNullSafe(own[f"_m{i}"]) for i, k in enumerate(keys.columns)]), how)


def applied(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The plain bag `old` after a netted delta, or one of a single sign.

    Only rows that lose copies are regrouped; all others pass through, so a
    small delta is broadcast and the old rows are not shuffled.
    """
    named = columns(delta)
    lost = delta.where(name(W) < 0)
    gone = lost.select(*[name(c).alias(f"_k{i}") for i, c in enumerate(named)])
    on = reduce(lambda a, b: a & b, [old[f"`{c}`"].eqNullSafe(gone[f"_k{i}"]) for i, c in enumerate(named)])
    untouched = old.join(gone, on, "left_anti")
    touched = net(plus([signed(old.join(gone, on, "left_semi")), lost]))
    return untouched.union(expand(touched)).union(expand(delta.where(name(W) > 0)))
