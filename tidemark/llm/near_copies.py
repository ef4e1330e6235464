"""Near copies by the exact Jaccard measure of their shingle sets.

A link joins two texts whose sets of shingles share at least SHARE of their
union; each link is verified on the sets, and none is missed. SimHash groups
come first: inside each, all pairs are compared, which joins the large groups of
copies. What is still apart is completed by a prefix filter: under one order of
all shingles, two sets that are similar enough share a shingle among the first
few of both. Shingles found often in a fixed share of the texts come last there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import saved
from .simhash import distance, majority, meetings, similar
from .textbytes import LOWER, NOT_SPACE, blocks, mix, prefix_hash, small_batches, span_hash, whole_text, word_spans

#: Sets are near copies if they share this part of their union: numerator, denominator.
SHARE = (4, 5)
#: Shingles of one comparison of a group; a larger group is cut into parts, and each two parts are compared together.
GROUP_SHINGLES = 4_000_000
#: What chains the hashes of the words of a shingle.
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Bits of the sketches that candidate pairs are compared by before their texts are.
SKETCH_BITS = 4096
#: 64-bit parts of the sketches that stand beside each node; half of their bits differ where sets differ in as many members.
PARTS = 16
#: Nodes up to which their list is broadcast to the texts; beyond, texts are shuffled to it.
BROADCAST_NODES = 500_000
#: One text in so many tells which shingles are common, whatever the number of texts, as a sample of fixed size lets
#: lists of shingles that pass for rare grow with the corpus; how often one must stand in it, and how many are kept at most.
#: The order only saves work; any order gives the same links.
SAMPLE_STEP, COMMON, COMMON_KEPT = 4, 3, 1_000_000


def shingle_lists(texts: pa.Array | pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """Of each text, a 64-bit hash of every run of `words` words, repeats included; a shorter text is one run.

    Words are what white space leaves, in lower case; all texts of a block are hashed at once.
    """
    out: list[np.ndarray] = []
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for _, _, data, offsets in blocks(part):
            low = LOWER[data]
            starts, ends, firsts = word_spans(low, offsets, NOT_SPACE)
            word = span_hash(prefix_hash(low), starts, ends)
            runs = max(0, len(word) - words + 1)
            whole = word[:runs]
            for k in range(1, words):
                whole = mix(whole * _STEP + word[k : k + runs])
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if b - a >= words:
                    out.append(whole[a : b - words + 1])
                else:
                    short = word[a : min(a + 1, b)]
                    for k in range(a + 1, b):
                        short = mix(short * _STEP + word[k])
                    out.append(short)
    return out


def shingle_sets(texts: pa.Array | pa.ChunkedArray, words: int) -> list[np.ndarray]:
    return [np.unique(x) for x in shingle_lists(texts, words)]


def alike(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of sizes a and b that have `both` members in common are near copies."""
    return both * (SHARE[0] + SHARE[1]) >= SHARE[0] * (a + b)


def prefix_size(n: int) -> int:
    """So many of the first members of a set of n stand for it: without them too few are left to be similar."""
    return n - -(-n * SHARE[0] // SHARE[1]) + 1 if n else 0


def parity(members: np.ndarray, bits: int = 64 * PARTS) -> np.ndarray:
    """So many bits, each set if an odd number of members fall on it; two sets differ in as many members as bits, or more."""
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def row_digest() -> Column:
    """A digest of a row's id and text; a null id differs from an empty one, a null text counts as empty."""
    name = F.col("doc_id").cast("string")
    return F.md5(F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("null:")), whole_text()).cast("binary"))


def _prints(docs: DataFrame, words: int, lanes: int, carry: list[str]) -> DataFrame:
    """(doc_id, node, n, p0, ..., f0, ..., text, row, carried): hash, size and parity of the shingle set, and fingerprint lanes."""
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"), row_digest().alias("row"), carried)
    names = ["node", "n", *(f"p{k}" for k in range(PARTS)), *(f"f{k}" for k in range(lanes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.int64)
            for row, h in zip(out, shingle_lists(batch.column(1), words), strict=True):
                own = np.unique(h)
                row[0] = np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)
                row[1], row[2 : 2 + PARTS] = len(own), parity(own)
                row[2 + PARTS :] = np.array([majority(mix(h + np.uint64(k)) if k else h) for k in range(lanes)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out.T), *batch.columns[1:]], ["doc_id", *names, "text", "row", "carried"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, " + ", ".join(f"{n} long" for n in names) + f", text binary, row string, carried {kinds['carried']}")


def _texts(prints: DataFrame, of: DataFrame) -> DataFrame:
    """One text of each node in the stored table `of`, with the columns of `of`."""
    of = F.broadcast(of) if of.count() <= BROADCAST_NODES else of
    return prints.select("node", "text").join(of, "node").dropDuplicates(["node"])


def sketched(prints: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The stored pairs (a, b) that may be near copies by the parity of SKETCH_BITS classes of their shingles; none that is one is lost."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x, SKETCH_BITS).tobytes() for x in sets], pa.binary())], ["node", "n", "sketch"])

    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair_ends")
    made = saved(_texts(prints, ends).select("node", "text").mapInArrow(sketch, "node long, n long, sketch binary"), "sketches")
    sides = pairs.join(made.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s")), "a").join(made.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("t")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (4, 5))
            differ = np.bitwise_count(s ^ t).sum(1, dtype=np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(differ * sum(SHARE) <= total * (SHARE[1] - SHARE[0])))

    return sides.select("a", "b", "n_a", "n_b", "s", "t").mapInArrow(close, "a long, b long")


def linked_in_groups(prints: DataFrame, sizes: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """Stars (a, b) that join all near copies inside each group (node, component)."""
    total = groups.join(sizes, "node").groupBy("component").agg(F.sum("n").alias("total"))
    parts = F.when(F.col("total") > GROUP_SHINGLES, F.ceil(F.col("total") / (GROUP_SHINGLES // 2))).otherwise(1).cast("long")
    rows = _texts(prints, groups).join(total, "component").select("component", F.explode(meetings("node", parts)).alias("cell"), "node", "text")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        sets = shingle_sets(table.column("text"), words)
        size = np.array([len(x) for x in sets])
        members, flat = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(ids)), size)
        todo = np.ones(len(ids), bool)

        def index() -> tuple[int, np.ndarray, np.ndarray]:
            """How many sets are left, and which of them hold each member."""
            open_ = np.flatnonzero(todo[owner])
            order = open_[np.argsort(flat[open_], kind="stable")]
            return int(todo.sum()), owner[order], np.searchsorted(flat[order], np.arange(len(members) + 1))

        held, holders, first = index()
        left, least, others = held, [ids[:0]], [ids[:0]]
        for seed in range(len(ids)):
            if not todo[seed]:
                continue
            todo[seed] = False
            left -= 1
            queue, group = [seed], [seed]
            while queue and left:
                if 2 * left < held:
                    held, holders, first = index()
                own = flat[edge[queue[-1]] : edge[queue[-1] + 1]]
                at, lo = queue.pop(), first[own]
                n = first[own + 1] - lo
                both = np.bincount(holders[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=len(ids))
                hit = np.flatnonzero(todo & (both > 0) & alike(both, size, size[at])).tolist()
                todo[hit] = False
                left -= len(hit)
                group += hit
                queue += hit
            if len(group) > 1:
                found = np.sort(ids[group])
                least.append(np.repeat(found[:1], len(found) - 1))
                others.append(found[1:])
        return pa.table({"a": np.concatenate(least), "b": np.concatenate(others)})

    return rows.groupBy("component", "cell").applyInArrow(run, "a long, b long")


def common_shingles(prints: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that stand in many texts of a sample, sorted; their number is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["token"])

    sample = prints.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE_STEP)) == 0).dropDuplicates(["node"]).select("text")
    often = saved(sample.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= COMMON), "common")
    least, total = 0, 0
    for k, n in sorted(((x["k"], x["n"]) for x in often.groupBy("k").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > COMMON_KEPT:
            break
        least = k
    found = often.where(F.col("k") >= least).select("token").toArrow() if least else pa.table({"token": pa.array([], pa.int64())})
    return np.sort(found.column("token").to_numpy().view(np.uint64))


def first_members(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The members of a sorted set that stand for it: in ascending order, common ones last."""
    at = np.searchsorted(common, own)
    last = at < len(common)
    last[last] = common[at[last]] == own[last]
    return np.concatenate([own[~last], own[last]])[: prefix_size(len(own))]


def one_of_each_list(shared: DataFrame) -> DataFrame:
    """Of the shingles that stand for the same nodes, the rows (token, node, ...) of the least; rows are distinct.

    A passage that two texts have in common gives as many shingles as it has words, and
    each would make the same pairs; one of them makes them all. What a pair is held to
    holds at each shingle that both share, so it does not matter which one stays.
    """
    held = shared.groupBy("token").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)])
    return shared.join(held.groupBy("n", "x0", "x1").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


def linked_between(prints: DataFrame, nodes: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """Links (a, b) of all near copies that `groups` (node, component) does not join."""
    common = prints.sparkSession.sparkContext.broadcast(common_shingles(prints, words))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [first_members(x, common.value) for x in shingle_sets(batch.column(1), words)]
            size = [len(x) for x in sets]
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in size)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(place)], ["token", "node", "at"])

    tokens = prints.select("node", "text").mapInArrow(firsts, "token long, node long, at long")
    tokens = tokens.join(groups, "node", "left").select("token", "node", "at", F.coalesce("component", "node").alias("component"))
    same = Window.partitionBy("token")
    shared = tokens.withColumn("lo", F.min("component").over(same)).withColumn("hi", F.max("component").over(same)).where("lo <> hi").drop("lo", "hi").distinct()
    shared = one_of_each_list(saved(shared, "shared_shingles"))
    shared = saved(shared.join(nodes.select("node", "n", *[f"p{k}" for k in range(PARTS)]), "node"), "first_shingles")
    a = shared.select(*[F.col(c).alias(f"a_{c}") for c in shared.columns])
    b = shared.select(*[F.col(c).alias(f"b_{c}") for c in shared.columns])
    c = F.col
    most = F.least("a_at", "b_at") + 1 + F.least(c("a_n") - c("a_at") - 1, c("b_n") - c("b_at") - 1)
    total = c("a_n") + c("b_n")
    # near copies differ in so few members at most, and so in so few bits
    close = distance(PARTS, "a_p", "b_p") * sum(SHARE) <= total * (SHARE[1] - SHARE[0])
    pair = (c("a_token") == c("b_token")) & (c("a_node") < c("b_node")) & (c("a_component") != c("b_component")) & (most * sum(SHARE) >= total * SHARE[0]) & close & (F.least("a_n", "b_n") * SHARE[1] >= F.greatest("a_n", "b_n") * SHARE[0])
    pairs = saved(a.join(b.hint("merge"), pair).select(c("a_node").alias("a"), c("b_node").alias("b")).distinct(), "pairs")
    pairs = saved(sketched(prints, pairs, words), "close_pairs")
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "close_ends")
    ends = saved(_texts(prints, ends), "pair_texts")
    sides = pairs.join(ends.select(c("node").alias("a"), c("text").alias("s")), "a").join(ends.select(c("node").alias("b"), c("text").alias("t")), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True)
            keep = [bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in sides]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "s", "t").mapInArrow(verified, "a long, b long")


def _components(docs: DataFrame, words: int, lanes: int, segments: int, max_distance: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(prints, (node, component_id, best) of each node): best is the row digest of the component's first row."""
    small_batches(docs.sparkSession)
    f, p = [f"f{k}" for k in range(lanes)], [f"p{k}" for k in range(PARTS)]
    prints = saved(_prints(docs, words, lanes, carry), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    each = prints.groupBy("node").agg(F.min(first).alias("first"), F.min(F.struct("n", *p, *f)).alias("x"))
    nodes = saved(each.select("node", "first", "x.*"), "nodes")
    groups = saved(connected_components(similar(nodes.select("node", *f), lanes, max_distance, segments)), "groups")
    stars = saved(linked_in_groups(prints, nodes.select("node", "n"), groups, words), "stars")
    joined = saved(connected_components(stars), "joined")
    links = linked_between(prints, nodes, joined, words)
    found = connected_components(stars.unionByName(links))
    named = saved(nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    return prints, named.select("node", "component").join(least, "component").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("best"))


def near_copies(docs: DataFrame, words: int, lanes: int, segments: int, max_distance: int) -> DataFrame:
    """(doc_id, node, component_id) for each row; component_id is the smallest doc_id reachable over near copies.

    node is a hash of the row's shingle set. Texts without words have the empty
    set and are one node; null texts count as empty. Null ids are never a
    component's least; a component of nothing else has a null one. Repeated rows
    are returned each; an empty table gives none.
    """
    prints, named = _components(docs, words, lanes, segments, max_distance, ["doc_id"])
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id")


def first_of_each(docs: DataFrame, words: int, lanes: int, segments: int, max_distance: int, carry: list[str]) -> DataFrame:
    """The columns in `carry` of one row of each component of near copies.

    The row with the smallest id stays, null ids last; of several texts under
    that id (or under none) the one with the least digest; of rows that have
    both in common the least by the columns carried. So rows of different
    components all stay, whatever ids they have.
    """
    prints, named = _components(docs, words, lanes, segments, max_distance, carry)
    # rows with one id and text are one before they are shuffled, so that no repeated row is hot
    rows = prints.groupBy("row").agg(F.min("carried").alias("carried"))
    return rows.join(named.select(F.col("best").alias("row")).distinct(), "row", "left_semi").select("carried.*")
