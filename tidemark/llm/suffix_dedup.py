"""Removal of repeated passages with a sparse, distributed suffix array.

A byte string of `min_bytes` that stands in two places is found by sorting
suffixes. Sorting all of them would write many times the input, so suffixes are
sampled where their own content says so: each string of `min_bytes` is filed
under the leftmost least (by hash) of the eight-byte grams that begin in its
first half. Two equal strings are filed under the same place, so suffixes that
begin elsewhere are never needed; about one in a hundred is kept.

The tokens of a sampled suffix are 64-bit hashes of long stretches: the first
covers what every string filed here has in common (its second half at least),
the second all that strings filed here can reach. Suffixes are range-partitioned
by these tokens with sampled splitters; each bucket is sorted by multikey
quicksort (one token at a time, and only inside runs equal so far) and each run
is compared with its neighbours, also across bucket borders, over a table of two
rows a bucket. A suffix that is
- equal to another in both tokens: all strings filed here repeat;
- alone in its first token: none does;
- equal in the first only: the strings filed here are compared one by one, by
  hash. Texts send these in packed, sorted runs, and get back which occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backoff_lm import pack, unpack
from .shared import saved
from .textbytes import blocks, mix, prefix_hash, small_batches, span_hash, total_bytes, whole_text

#: Bytes of a repeated string.
MIN_BYTES = 400
#: Suffixes in one bucket, about.
BUCKET_ROWS = 400_000
#: Texts to compare (8 bytes each) up to which their list is broadcast; beyond, texts are shuffled to it.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are compared or cut together, about.
CHUNK = 8 << 20

_GRAM = 8
_PLACE_BITS = np.uint64(30)
_PLACE = np.uint64((1 << 30) - 1)
DUP, MANY, LEAD, FIRST, LAST, FIRST_RUN, LAST_RUN, HEAD, TAIL = (1 << k for k in range(9))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by minima from both ends of fixed stretches."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


class Places:
    """Of a block of texts: where strings of min_bytes begin, and the suffixes that they are filed under."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_bytes: int):
        self.data, self.offsets, self.size = data, offsets, min_bytes
        self.width = min_bytes // 2
        lengths = np.diff(offsets)
        room = np.maximum(lengths - min_bytes + 1, 0)  # strings of each text
        total = int(room.sum())
        self.sums = prefix_hash(data)
        none = np.zeros(0, np.int64)
        if not total:
            self.starts = self.filed = self.at = self.text = none
            self.run = np.zeros(1, np.int64)
            return
        grams = np.zeros(len(data), np.uint64)
        for k in range(_GRAM):
            whole = np.frombuffer(data[k:], "<u8", count=(len(data) - k) // 8)
            grams[k : k + 8 * len(whole) : 8] = whole
        ranked = (mix(grams) & ~_PLACE) | np.arange(len(data), dtype=np.uint64)
        if len(data) >= 1 << 30:
            raise ValueError("a text of over 1 GiB")
        self.starts = np.repeat(offsets[:-1] - (np.cumsum(room) - room), room) + np.arange(total)
        self.filed = (sliding_min(ranked, self.width)[self.starts] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], self.filed[1:] != self.filed[:-1]]))
        self.at, self.run = self.filed[new], np.append(new, total)
        self.text = np.searchsorted(offsets, self.at, "right") - 1

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The stretch that strings filed under each suffix can reach."""
        return np.maximum(self.at - self.width + 1, self.offsets[self.text]), np.minimum(self.at + self.size, self.offsets[self.text + 1])

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Both tokens of each suffix."""
        lo, hi = self.reach()
        lead = span_hash(self.sums, self.at, self.at + self.size - self.width)
        # how far the stretch reaches to the left is part of what is compared
        return lead.view(np.int64), mix(span_hash(self.sums, lo, hi) + (self.at - lo).astype(np.uint64)).view(np.int64)

    def strings(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the strings filed under some suffixes."""
        n = self.run[suffixes + 1] - self.run[suffixes]
        which = np.repeat(self.run[suffixes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        starts = self.starts[which]
        return starts, span_hash(self.sums, starts, starts + self.size)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns: each column sorts only inside the runs left equal by those before."""
    order = np.argsort(columns[0], kind="stable")
    equal = columns[0][order]
    border = np.concatenate([[True], equal[1:] != equal[:-1]]) if len(order) else np.zeros(0, bool)
    for column in columns[1:]:
        run = np.cumsum(border) - 1
        inside = np.flatnonzero(np.bincount(run, minlength=1)[run] > 1)
        if not len(inside):
            break
        rows = order[inside]
        rows = rows[np.lexsort((column[rows], run[inside]))]
        order[inside] = rows
        value = column[order]
        border[1:] |= value[1:] != value[:-1]
    return order


def sampled_suffixes(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(lead, reach, row, n): the tokens of the sampled suffixes, equal ones of a text counted in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(1)):
                p = Places(data, offsets, min_bytes)
                if not len(p.at):
                    continue
                lead, reach = p.tokens()
                order = np.lexsort((reach, lead, p.text))
                a, b, t = lead[order], reach[order], p.text[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])]))
                n = np.minimum(np.diff(np.append(new, len(a))), 2)
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(names[lo + t[new]]), pa.array(n.astype(np.int32))], ["lead", "reach", "row", "n"])

    return rows.select("row", "text").mapInArrow(run, "lead long, reach long, row long, n int")


def sort_bucket(lead: np.ndarray, reach: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a bucket that matter, their code): runs compared inside the bucket, those at its ends marked."""
    order = multikey_order([lead, reach, row])
    a, b, n = lead[order], reach[order], n[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_b = new_a | np.concatenate([[True], b[1:] != b[:-1]])
    run_a, run_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    dup = np.bincount(run_b, n)[run_b] > 1
    many = np.bincount(run_a[new_b])[run_a] > 1
    code = dup * DUP + many * MANY + new_b * LEAD + (run_a == 0) * FIRST + (run_a == run_a[-1]) * LAST + (run_b == 0) * FIRST_RUN + (run_b == run_b[-1]) * LAST_RUN
    code[0] += HEAD
    code[-1] += TAIL
    keep = dup | many | ((code & (FIRST | LAST)) > 0)
    return order[keep], code[keep]


def across_borders(marked: DataFrame) -> DataFrame:
    """Marked rows (bucket, code, lead, reach, row) with the code that they have if buckets had no borders.

    A run that goes over borders is known by its first or last row in each bucket.
    """
    bit = lambda b: F.col("code").bitwiseAND(b) != 0
    ends = saved(marked.where(bit(HEAD | TAIL)), "bucket_ends")
    leads = saved(ends.groupBy("lead").agg((F.max(bit(MANY)) | (F.min("reach") < F.max("reach"))).alias("over")), "border_leads").where("over")
    runs = saved(ends.groupBy("lead", "reach").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo < hi"), "border_runs")
    outer = marked.where(bit(FIRST | LAST)).join(leads, "lead", "left").join(runs, ["lead", "reach"], "left")
    code = F.col("code").bitwiseOR(F.when(F.col("over"), MANY).otherwise(0)).bitwiseOR(F.when(F.col("lo").isNotNull() & bit(FIRST_RUN | LAST_RUN), DUP).otherwise(0))
    return marked.where(~bit(FIRST | LAST)).unionByName(outer.select("bucket", code.alias("code"), "lead", "reach", "row"))


def compare_suffixes(suffixes: DataFrame) -> DataFrame:
    """(row, reach, repeats, differs): suffixes all of whose strings repeat, and those to compare string by string."""
    buckets = max(1, -(-suffixes.count() // BUCKET_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("lead", pa.int64()), ("reach", pa.int64()), ("row", pa.int64()), ("n", pa.int32())]))
        if len(table):
            lead, reach, row, n = (table.column(c).to_numpy() for c in ("lead", "reach", "row", "n"))
            at, code = sort_bucket(lead, reach, row, n)
            name = np.full(len(at), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(code.astype(np.int32)), pa.array(lead[at]), pa.array(reach[at]), pa.array(row[at])], ["bucket", "code", "lead", "reach", "row"])

    dealt = suffixes.repartitionByRange(buckets, "lead", "reach", "row") if buckets > 1 else suffixes.coalesce(1)
    marked = saved(dealt.mapInArrow(run, "bucket int, code int, lead long, reach long, row long"), "suffix_runs")
    has = lambda bit: F.col("code").bitwiseAND(bit) != 0
    told = across_borders(marked) if buckets > 1 else marked
    return told.select("row", "reach", has(DUP).alias("repeats"), (has(MANY) & (~has(DUP) | has(LEAD))).alias("differs")).where("repeats or differs")


def _marks(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each row: sorted tokens of suffixes that repeat, and of those to compare."""
    row, reach = table.column("row").to_numpy(), table.column("reach").to_numpy()
    repeats, differs = (table.column(c).to_numpy(zero_copy_only=False) for c in ("repeats", "differs"))
    order = np.lexsort((reach, row))
    cuts = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]])) if len(order) else []
    return {int(row[part[0]]): (reach[part[repeats[part]]], reach[part[differs[part]]]) for part in np.split(order, cuts[1:]) if len(part)}


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _chosen(p: Places, names: np.ndarray, marks: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of a block's suffixes that repeat, and of those to compare."""
    if not len(p.at) or not marks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, reach = p.tokens()
    cuts = np.searchsorted(p.text, np.arange(len(p.offsets)))
    same, other = np.zeros(len(p.at), bool), np.zeros(len(p.at), bool)
    for t, name in enumerate(names.tolist()):
        if name in marks and cuts[t] < cuts[t + 1]:
            part = slice(cuts[t], cuts[t + 1])
            same[part], other[part] = (_is_in(reach[part], m) for m in marks[name])
    return np.flatnonzero(same), np.flatnonzero(other)


def _blocks_of(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    row = 0
    for part in table.column("text").chunks:
        for lo, hi, data, offsets in blocks(part):
            yield row + lo, row + hi, data, offsets
        row += len(part)


def _asked(docs: pa.Table, marks: dict, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the strings to compare in a chunk, and how often each occurs (2: or more)."""
    names, found = docs.column("row").to_numpy(), [np.zeros(0, np.uint64)]
    for lo, hi, data, offsets in _blocks_of(docs):
        p = Places(data, offsets, min_bytes)
        found.append(p.strings(_chosen(p, names[lo:hi], marks)[1])[1])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return keys, np.minimum(counts, 2)


def cover(p: Places, same: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes of a block are to go: what the suffixes that repeat reach, and the strings at `starts`."""
    lo, hi = p.reach() if len(p.at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    step = np.zeros(len(p.data) + 1, np.int64)
    long = same[hi[same] - lo[same] >= p.size] if len(same) else same
    np.add.at(step, lo[long], 1)
    np.add.at(step, hi[long], -1)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + p.size, -1)
    return np.cumsum(step[:-1]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The mask without characters of which a byte stays."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(heads):
        return gone
    return np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(data))))


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, characters: bool = False, carry: list[str] | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept, kept_sha256, carried) for each row.

    Every byte goes that is covered by a string of min_bytes (32 at least) that
    also begins anywhere else, in the same text or another; strings are judged
    on the input and never span two texts. kept: the bytes that stay. With
    characters, a character stays whole if any byte of it stays. n_shared:
    distinct sampled suffixes of the text of which half of min_bytes stand
    elsewhere too; it tells of shared passages that are too short to be removed,
    though not of all of them. Null texts
    count as empty; equal rows are repeats of each other; shorter texts lose
    nothing; an empty table gives none. carried: a struct of the columns named
    in `carry`.
    """
    if min_bytes < 32:
        raise ValueError("min_bytes under 32")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"), F.xxhash64("doc_id", whole_text()).alias("row"), F.struct(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).alias("carried"))
    chunks = max(1, -(-total_bytes(docs) // chunk_bytes))
    shards = max(1, min(4096, chunks))
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")
    marks = saved(compare_suffixes(saved(sampled_suffixes(rows, min_bytes), "suffixes")), "marks").select("*", chunk)
    dealt = rows.select("*", chunk)

    def ask(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs) or not len(told):
            return pa.table({"shard": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        keys, counts = _asked(docs, _marks(told), min_bytes)
        cuts = [0, *np.searchsorted(keys, np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)).tolist(), len(keys)]
        out = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        name = key[0].as_py()
        return pa.table({"shard": pa.array([k for k, _, _ in out], pa.int32()), "chunk": pa.array([name] * len(out), pa.int32()), "keys": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in out], pa.binary()), "counts": pa.array([pack(counts[a:b]) for _, a, b in out], pa.binary())})

    def answer(asked: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x).astype(np.int64) for x in asked.column("counts").to_pylist()])
        flat = np.concatenate(keys)
        each, back = np.unique(flat, return_inverse=True)
        twice = (np.bincount(back, counts) > 1)[back]
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        # a chunk gets the hashes that occur twice, of those it sent
        return pa.table({"chunk": asked.column("chunk"), "keys": pa.array([pack(np.diff(k[t], prepend=np.uint64(0))) for k, t in zip(keys, np.split(twice, sizes), strict=True)], pa.binary())})

    compared = saved(marks.where("differs").select("row").distinct(), "compared")
    few = compared.count() <= BROADCAST_ROWS
    asking = dealt.join(F.broadcast(compared) if few else compared.hint("merge"), "row", "left_semi").select("row", "text", "chunk")
    asked = asking.groupBy("chunk").cogroup(marks.where("differs").groupBy("chunk")).applyInArrow(ask, "shard int, chunk int, keys binary, counts binary")
    answers = saved(asked.groupBy("shard").applyInArrow(answer, "chunk int, keys binary"), "strings")
    # one table holds what a chunk is told: marks of its suffixes, and hashes of strings that repeat
    told = marks.select("chunk", "row", "reach", "repeats", "differs", F.lit(None).cast("binary").alias("keys")).unionByName(answers.select("chunk", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("reach"), F.lit(False).alias("repeats"), F.lit(False).alias("differs"), "keys"))

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(x), dtype=np.uint64) for x in told.column("keys").to_pylist() if x is not None]
        twice = np.sort(np.concatenate([np.zeros(0, np.uint64), *sent]))
        marks = _marks(told.filter(pa.compute.is_null(told.column("keys"))))
        names = docs.column("row").to_numpy()
        size, removed, spans, kept, digest = [], [], [], [], []
        shared = [len(marks[n][0]) + int((~_is_in(marks[n][1], marks[n][0])).sum()) if n in marks else 0 for n in names.tolist()]
        for lo, hi, data, offsets in _blocks_of(docs):
            p = Places(data, offsets, min_bytes)
            same, other = _chosen(p, names[lo:hi], marks)
            starts, hashes = p.strings(other)
            gone = cover(p, same, starts[_is_in(hashes, twice)])
            if characters and len(data):
                gone = whole_characters(data, gone)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begins[inner] = gone[inner]
            counts = np.concatenate([[0], np.cumsum(gone)])
            heads = np.concatenate([[0], np.cumsum(begins)])
            size += np.diff(offsets).tolist()
            removed += np.diff(counts[offsets]).tolist()
            spans += np.diff(heads[offsets]).tolist()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                left = data[a:b][~gone[a:b]].tobytes()
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
        return pa.table(
            {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "n_shared": pa.array(shared, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(digest, pa.string()), "carried": docs.column("carried")}
        )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, f"doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary, kept_sha256 string, carried {kinds['carried']}")
