"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens flows down a tree of domains, languages and sources. Each
node deals its budget to its children by weight; a child that cannot use its
share (its texts times the most epochs are fewer tokens) leaves the rest to its
siblings, by weight again. As a node never gets more than its children can use
together, a shortage is settled among siblings before it could reach an
ancestor. Each source (leaf) then takes whole epochs of its texts and, from the
next epoch's seeded order, the prefix that fills its budget to the token.

The tables of the tree have a row per leaf. Prefixes need no global sort: an
epoch's order is a hash, its ranges hold about RANGE_ROWS texts each, sums per
range find the one range where a budget ends, and only that one is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved
from .textbytes import whole_text

LEVELS = ("domain", "lang", "source")
#: Texts of a leaf in one range of its order, about.
RANGE_ROWS = 1024
#: Leaves up to which the table of budgets is broadcast to the texts; larger ones are joined.
BROADCAST_LEAVES = 50_000
#: Target weights by level and name; names that are not listed weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
#: Budget as a share of all tokens at hand, and how often a text may be used.
SHARE, MAX_EPOCHS, SEED = 0.8, 3, 7
_BITS = 52


def domain_of_source() -> Column:
    """A source's domain where a table has none: one of four, by digest of its name."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % 4).cast("string"))


def token_count() -> Column:
    """Words of a text, split at ASCII white space."""
    return F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    """A text's place in an epoch: 52 bits of a digest of seed, epoch and id."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to nodes (parent columns, name, weight, cap, given): shares of `given`, at most cap each.

    Children in order of cap per weight fill up first; with S the caps and V the
    weights of those before child i, (given - S) / (all weights - V) is largest
    at the first child that does not fill up, and that is what a weight of one
    gets from everyone who does not.
    """
    upward = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, after = upward.rowsBetween(W.unboundedPreceding, -1), upward.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    most = F.max("level").over(W.partitionBy(*parent))
    return nodes.withColumn("level", level).withColumn("budget", F.least(F.col("cap"), F.floor(F.col("weight") * most))).drop("level")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """Adds the budget of each leaf (domain, lang, source, tokens, docs); leaves of weight 0 or without tokens get none."""
    weigh = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights[c].items() for x in p]), F.col(c)), F.lit(1)) if weights.get(c) else F.lit(1)
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    live = leaves.where("cap > 0")
    for c in LEVELS:
        live = live.where(weigh(c) > 0)
    given = live.agg(F.least(F.floor(F.sum("tokens") * F.lit(float(share))), F.sum("cap")).cast("long").alias("given")).withColumn("root", F.lit(0))
    for depth, name in enumerate(LEVELS):
        path, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = live.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weigh(name).cast("long")).withColumn("root", F.lit(0))
        given = deal(nodes.join(given, above or ["root"]).drop("root") if above else nodes.join(F.broadcast(given), "root"), above or ["root"], name).select(*path, F.col("budget").alias("given"))
    return leaves.join(given, list(LEVELS), "left").select(*LEVELS, "tokens", "docs", F.coalesce("given", F.lit(0)).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens, kept columns): a row per use of a text.

    take_tokens is n_tokens but for the one text of a leaf where its budget
    ends. Texts without tokens are never used. Null lang, source and text count
    as empty; a null id takes part under an empty one; repeated rows are used
    each; equal keys are ordered by size, so any order of rows gives the same
    rows. An empty table gives none. `keep` names further columns to return
    (not one of the above); `domain` is used where the table has that column.
    """
    weights = WEIGHTS if weights is None else weights
    keep = [c for c in keep or [] if c not in {"doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens"}]
    domain = F.coalesce("domain", F.lit("")) if "domain" in docs.columns else domain_of_source()
    sized = docs.select("doc_id", domain.alias("domain"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], token_count().alias("n_tokens"), *([F.struct(*keep).alias("kept")] if keep else [])).where("n_tokens > 0")
    path = list(LEVELS)
    slim = saved(sized.select("doc_id", *path, "n_tokens"), "sizes")
    leaves = saved(slim.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    few = leaves.count() <= BROADCAST_LEAVES
    plan = budgets(leaves, weights, share, max_epochs).where("budget > 0")
    plan = plan.select(*path, F.floor(F.col("budget") / F.col("tokens")).alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / RANGE_ROWS))).cast("int").alias("bits"))
    plan = saved(plan, "budgets")

    def placed(rows: DataFrame, by: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(by) if few else by, path).withColumn("key", order_key(seed, F.col("whole")))
        return joined.withColumn("range", F.floor(F.col("key") / F.pow(F.lit(2.0), F.lit(_BITS) - F.col("bits"))))

    sums = placed(slim, plan).groupBy(*path, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    running = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(*path).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ends = running.where("before <= rest and rest < before + n").select(*path, F.col("range").alias("last"), "before")
    plan = saved(plan.join(ends, path), "ends")
    rows = placed(sized, plan)
    times = F.col("whole") + (F.col("range") < F.col("last")).cast("long")
    entire = rows.where(times > 0).withColumn("take", F.col("n_tokens")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    inside = W.partitionBy(*path).orderBy("key", "n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.where(F.col("range") == F.col("last")).withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    edge = edge.withColumn("take", F.least(F.col("n_tokens"), F.col("rest") - F.col("start"))).where("take > 0").withColumn("epoch", F.col("whole"))
    out = [F.col(c) for c in ("doc_id", *path)] + [F.col("epoch").cast("int").alias("epoch"), F.col("n_tokens"), F.col("take").alias("take_tokens"), *[F.col(f"kept.`{c}`").alias(c) for c in keep]]
    return entire.select(*out).unionByName(edge.select(*out))


def mix_sql(weights: dict[str, dict[str, int]] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same over `documents` in DuckDB SQL."""

    def weigh(c: str) -> str:
        cases = " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in weights[c].items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    steps, given = [], "SELECT least(CAST(floor(sum(tokens) * CAST({s} AS DOUBLE)) AS BIGINT), CAST(sum(cap) AS BIGINT)) AS given FROM leaves".format(s=share)
    steps.append(f"given0 AS ({given})")
    for depth, name in enumerate(LEVELS):
        path, above = ", ".join(LEVELS[: depth + 1]), list(LEVELS[:depth])
        part = f"PARTITION BY {', '.join(above)} " if above else ""
        using = f"JOIN given{depth} USING ({', '.join(above)})" if above else f"CROSS JOIN given{depth}"
        steps.append(f"""nodes{depth} AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weigh(name)} AS BIGINT) AS weight FROM leaves GROUP BY {path}),
        levels{depth} AS (SELECT *, CAST(given - coalesce(sum(cap) OVER ({part}ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER ({part}ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM nodes{depth} {using}),
        given{depth + 1} AS (SELECT {path}, CAST(least(cap, floor(weight * max(level) OVER ({part}))) AS BIGINT) AS given FROM levels{depth})""")
    path = ", ".join(LEVELS)
    return f"""
    WITH sized AS (SELECT doc_id, 'd' || (('0x' || substr(md5(source), 1, 4))::INTEGER % 4) AS domain, lang, source, n_tokens FROM (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents) WHERE n_tokens > 0),
    leaves AS (SELECT {path}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM sized GROUP BY {path}),
    {", ".join(steps)},
    plan AS (SELECT {path}, given // tokens AS whole, given % tokens AS rest FROM given3 JOIN leaves USING ({path})),
    keyed AS (SELECT s.*, whole, rest, ('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {_BITS // 4}))::BIGINT AS key FROM sized s JOIN plan USING ({path})),
    placed AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY {path} ORDER BY key, n_tokens, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_tokens AS start FROM keyed)
    SELECT doc_id, {path}, CAST(e.epoch AS INTEGER) AS epoch, n_tokens, CASE WHEN e.epoch < whole THEN n_tokens ELSE least(n_tokens, rest - start) END AS take_tokens
    FROM placed, LATERAL (SELECT unnest(range(whole + 1)) AS epoch) e WHERE e.epoch < whole OR start < rest
    """
