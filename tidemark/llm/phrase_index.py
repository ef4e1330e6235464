"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: each row is one block of documents with the
postings of all its terms (sorted term hashes, and for each term the positions
where it stands, counted through the block). It is written once and searched by
any number of test sets. A phrase is found by taking the block's shortest
posting list among the phrase's terms, shifting it to where the phrase would
begin, and intersecting it with the other lists, next shortest first, each
shifted by its own offset; most phrases end at the first, empty list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .textbytes import ALNUM, LOWER, blocks, prefix_hash, small_batches, span_hash, whole_text, word_spans

#: Words of a window; an item with fewer is one window.
WINDOW = 10
#: Bytes of text in one block of the index.
INDEX_BLOCK = 8 << 20
#: Test items that are searched together; a larger test set is searched in so many rounds.
ITEMS_AT_ONCE = 20_000
#: Bytes of test text in one round; its windows take about fifteen times as much.
TEXT_AT_ONCE = 4 << 20
#: Positions between the words of two documents, so that no phrase or neighbourhood spans them.
GAP = 1 << 10


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of a block, index of the first word of each text)."""
    low = LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, ALNUM)
    return span_hash(prefix_hash(low), starts, ends), firsts


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per block of documents: (block, ids, words, terms, lists, places), little-endian arrays as binary.

    ids: Arrow-encoded ids of the block's documents, with the columns in `carry` as struct `carried`; words: words of each;
    terms: sorted distinct term hashes; lists: where each term's postings begin;
    places: positions, ascending within a term. Null texts have no words; a
    text of any length stays in one block; repeated rows are kept.
    """
    small_batches(docs.sparkSession)
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"), *more)

    def pack(ids: list[pa.RecordBatch], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(counts)
        place = np.arange(n.sum()) + np.repeat(GAP * np.arange(len(n)), n)
        all_hashes = np.concatenate(hashes)
        order = np.argsort(all_hashes, kind="stable")
        ordered = all_hashes[order]
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(ids)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        values = [sink.getvalue().to_pybytes(), n.astype("<i8").tobytes(), ordered[new].astype("<u8").tobytes(), np.append(new, len(ordered)).astype("<i4").tobytes(), place[order].astype("<i8").tobytes() if place.size and place[-1] >= 2**31 else place[order].astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), *(pa.array([v], pa.binary()) for v in values)], ["block", "ids", "words", "terms", "lists", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, size = [], [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                h, firsts = words_of(data, offsets)
                ids.append(batch.select([0, *range(2, batch.num_columns)]).slice(lo, hi - lo))
                hashes.append(h)
                counts.append(np.diff(firsts))
                size += len(data)
                if size >= INDEX_BLOCK:
                    yield pack(ids, hashes, counts)
                    ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield pack(ids, hashes, counts)

    return rows.mapInArrow(run, "block binary, ids binary, words binary, terms binary, lists binary, places binary")


@dataclass
class Postings:
    """One block of the index, opened."""

    ids: pa.Table
    words: np.ndarray
    terms: np.ndarray
    lists: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Postings:
        with pa.ipc.open_stream(row["ids"]) as stream:
            ids = stream.read_all().combine_chunks()
        words, lists = np.frombuffer(row["words"], "<i8"), np.frombuffer(row["lists"], "<i4").astype(np.int64)
        kind = "<i4" if len(row["places"]) == 4 * lists[-1] else "<i8"
        return cls(ids, words, np.frombuffer(row["terms"], "<u8"), lists, np.frombuffer(row["places"], kind).astype(np.int64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each term or -1, length of its list)."""
        if not len(self.terms):
            return np.full(hashes.shape, -1), np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at = np.where(self.terms[at] == hashes, at, -1)
        return at, np.where(at >= 0, self.lists[at + 1] - self.lists[at], 0)

    def gather(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined lists of several terms: (which of them, position)."""
        sizes = self.lists[terms + 1] - self.lists[terms]
        which = np.repeat(np.arange(len(terms)), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.places[self.lists[terms][which] + inside]

    def contains(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term; by bisection of all lists at once."""
        lo, hi = self.lists[terms].copy(), self.lists[terms + 1].copy()
        end = hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.places[np.minimum(mid, len(self.places) - 1)] < places
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return (lo < end) & (self.places[np.minimum(lo, len(self.places) - 1)] == places)

    def nearest(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Distance from each position to the nearest one in the list of its term."""
        lo, hi = self.lists[terms].copy(), self.lists[terms + 1].copy()
        first, end = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.places[np.minimum(mid, len(self.places) - 1)] < places
            open_ = lo < hi
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        far = np.int64(1 << 62)
        after = np.where(lo < end, self.places[np.minimum(lo, len(self.places) - 1)] - places, far)
        before = np.where(lo > first, places - self.places[np.maximum(lo - 1, 0)], far)
        return np.minimum(after, before)

    def next(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first position at or after each one in the list of its term; a very large number where there is none."""
        lo, hi = self.lists[terms].copy(), self.lists[terms + 1].copy()
        end = hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.places[np.minimum(mid, len(self.places) - 1)] < places
            open_ = lo < hi
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return np.where(lo < end, self.places[np.minimum(lo, len(self.places) - 1)], np.int64(1 << 62))

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of each exact occurrence; windows: (n, width) term hashes, lengths: words of each."""
        none = np.zeros(0, np.int64)
        terms, counts = self.find(windows)
        used = np.arange(windows.shape[1])[None] < lengths[:, None]
        alive = np.flatnonzero(((counts > 0) | ~used).all(1))
        if not len(alive):
            return none, none
        terms, counts, used = terms[alive], counts[alive], used[alive]
        order = np.argsort(np.where(used, counts, np.iinfo(np.int64).max), axis=1, kind="stable")
        rows = np.arange(len(alive))
        which, place = self.gather(terms[rows, order[:, 0]])
        start = place - order[which, 0]
        for k in range(1, windows.shape[1]):
            if not len(which):
                break
            at = order[which, k]
            more = used[which, at]
            ok = ~more
            ok[more] = self.contains(terms[which[more], at[more]], start[more] + at[more])
            which, start = which[ok], start[ok]
        return alive[which], start

    def documents(self) -> np.ndarray:
        """The first position of each document."""
        return np.cumsum(self.words) - self.words + GAP * np.arange(len(self.words))


@dataclass
class TestSet:
    """Windows of test items, as arrays that are broadcast to the search."""

    items: list
    of: np.ndarray  # item of each window
    windows: np.ndarray
    lengths: np.ndarray
    terms: list[np.ndarray]  # the distinct terms of each item
    sizes: list[int]  # words of each item

    def all_in(self, block: Postings, most: int | None) -> list[int]:
        """The items all of whose terms (the first `most`) stand somewhere in a block."""
        used = [(i, x[:most]) for i, x in enumerate(self.terms) if len(x)]
        if not used:
            return []
        found, _ = block.find(np.concatenate([x for _, x in used]))
        heads = np.cumsum([0, *(len(x) for _, x in used[:-1])])
        return [used[k][0] for k in np.flatnonzero(np.logical_and.reduceat(found >= 0, heads))]


def test_set(items: list, texts: list[str], window: int = WINDOW) -> TestSet:
    from numpy.lib.stride_tricks import sliding_window_view

    of, windows, lengths, distinct, sizes = [], [], [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = words_of(data, np.array([0, len(data)]))
        distinct.append(np.unique(hashes))
        sizes.append(len(hashes))
        if not len(hashes):
            continue
        if len(hashes) < window:
            row = np.zeros((1, window), np.uint64)
            row[0, : len(hashes)] = hashes
        else:
            row = np.unique(sliding_window_view(hashes, window), axis=0)
        of.append(np.full(len(row), i))
        windows.append(row)
        lengths.append(np.full(len(row), min(window, len(hashes))))
    if not of:
        return TestSet(items, np.zeros(0, np.int64), np.zeros((0, window), np.uint64), np.zeros(0, np.int64), distinct, sizes)
    return TestSet(items, np.concatenate(of), np.concatenate(windows), np.concatenate(lengths), distinct, sizes)


def covered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distinct positions inside any of the spans, ascending."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lo, hi = starts, starts + lengths
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    begin = np.concatenate([[lo[0]], np.maximum(lo[1:], hi[:-1])])
    size = np.maximum(hi - begin, 0)
    return np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def stretches(block: Postings, terms: np.ndarray, size: int) -> np.ndarray:
    """The documents of a block in which all `terms` stand within `size` words, ascending."""
    none = np.zeros(0, np.int64)
    at, counts = block.find(terms)
    if not len(terms) or (counts == 0).any():
        return none
    at = at[np.argsort(counts, kind="stable")]
    # a stretch holds the rarest term, with each other one less than `size` words away; this only narrows what is tested
    _, place = block.gather(at[:1])
    for other in at[1:]:
        place = place[block.nearest(np.full(len(place), other), place) < size]
    if not len(place):
        return none
    _, begin = block.gather(at)
    begin = np.sort(begin)
    begin = begin[place[np.minimum(np.searchsorted(place, begin), len(place) - 1)] - begin < size]
    begin = begin[begin <= place[-1]]
    firsts = block.documents()
    doc = np.searchsorted(firsts, begin, "right") - 1
    end = np.minimum(begin + size, firsts[doc] + block.words[doc])
    for term in at:
        keep = block.next(np.full(len(begin), term), begin) < end
        begin, end, doc = begin[keep], end[keep], doc[keep]
    return np.unique(doc)


def search(index: DataFrame, tests: TestSet, near: int = 0, near_terms: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Matches of one round of test items: (block, place, doc_id, n_words, spans, items, near_items), a row for each document.

    spans: (start, length) of hit words, merged, in words of the document;
    items: texts of the ids of items with an exact window, sorted as strings;
    near_items: with near > 0, items whose distinct terms all stand, in any order,
    in one stretch of 2 * near + 1 words of the document (or of as many words as
    the item has, if more); with `near_terms`, so many of them, the first by hash.
    types: SQL types of the ids and of what is carried; without them they are read off the index, which then must not be empty.
    """
    if 2 * near + 1 > GAP:
        raise ValueError(f"near may be {(GAP - 1) // 2} at most, so that no stretch spans two documents")
    shared = index.sparkSession.sparkContext.broadcast(tests)
    kinds = types or index_types(index)
    names = [str(x) for x in tests.items]

    def one(name: bytes, block: Postings, t: TestSet) -> pa.RecordBatch:
        n = len(block.words)
        firsts = block.documents()
        which, start = block.phrases(t.windows, t.lengths)
        doc = np.searchsorted(firsts, start, "right") - 1
        pairs = np.unique(doc * max(1, len(t.items)) + t.of[which])
        hit = covered(start, t.lengths[which])
        cut = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1])) if len(hit) else np.zeros(0, np.int64)
        head, size = hit[cut], np.diff(np.append(cut, len(hit)))
        spans: list[list] = [[] for _ in range(n)]
        for d, s, k in zip((np.searchsorted(firsts, head, "right") - 1).tolist(), head.tolist(), size.tolist(), strict=True):
            spans[d].append({"start": s - int(firsts[d]), "length": k})
        items: list[list] = [[] for _ in range(n)]
        for p in pairs.tolist():
            items[p // len(t.items)].append(names[p % len(t.items)])
        nearby: list[list] = [[] for _ in range(n)]
        for i in t.all_in(block, near_terms) if near else ():
            for d in stretches(block, t.terms[i][:near_terms], max(2 * near + 1, t.sizes[i])).tolist():
                nearby[d].append(names[i])
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.binary()), pa.array(range(n), pa.int64()), block.ids.column(0).combine_chunks(), pa.array(block.words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x) for x in nearby], pa.list_(pa.string())), *(c.combine_chunks() for c in block.ids.columns[1:])],
            ["block", "place", "doc_id", "n_words", "spans", "items", "near_items", *block.ids.column_names[1:]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield one(row["block"], Postings.of(row), shared.value)

    small_batches(index.sparkSession)
    return index.mapInArrow(run, f"block binary, place long, doc_id {kinds[0]}, n_words long, spans array<struct<start:long,length:long>>, items array<string>, near_items array<string>" + "".join(f", carried {k}" for k in kinds[1:]))


def index_types(index: DataFrame) -> list[str]:
    """The SQL types of the ids in an index and of what is carried with them."""
    row = index.select("ids").first()
    if row is None:
        raise ValueError("an empty index does not tell its types")
    from pyspark.sql.pandas.types import from_arrow_type

    with pa.ipc.open_stream(bytes(row["ids"])) as stream:
        return [from_arrow_type(f.type).simpleString() for f in stream.schema]


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, near: int = 0, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, spans, items, near_items) for each document row, and the columns in `carry` as struct `carried`.

    Test items with null text have no words and match nothing; an item id that
    repeats counts once per text. Test sets beyond ITEMS_AT_ONCE items or
    TEXT_AT_ONCE bytes are read and searched in rounds over the stored index, each
    written before the next, so what is held and broadcast at once stays bounded
    (an item longer than that is a round of its own). Null texts have no words; an empty table of
    documents gives none, an empty test set no hits.
    """
    index = saved(build_index(docs, carry=carry), "phrase_index")
    carried = docs.select(F.col("doc_id"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    types = [f.dataType.simpleString() for f in carried.schema]
    rounds: list[DataFrame] = []
    items: list = []
    texts: list[str] = []
    size = 0
    for row in tests.select("item_id", whole_text().alias("text")).orderBy("item_id", "text").toLocalIterator():
        if items and (len(items) >= ITEMS_AT_ONCE or size + len(row["text"].encode()) > TEXT_AT_ONCE):
            rounds.append(saved(search(index, test_set(items, texts, window), near, types=types), "phrase_round"))
            items, texts, size = [], [], 0
        items.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"].encode())
    last = search(index, test_set(items, texts, window), near, types=types)
    if not rounds:
        return last.drop("block", "place")
    for more in rounds:
        last = last.unionByName(more)
    return (
        last.groupBy("block", "place")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *([F.first("carried").alias("carried")] if carry else []), merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"), *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")))
        .drop("block", "place")
    )


def merged_spans(spans: Column) -> Column:
    """Spans joined where they overlap or touch, ascending."""

    def put(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["start"] + last["length"], x["start"] + x["length"])
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), (end - last["start"]).alias("length")))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"] >= x["start"]), joined).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(spans), F.lit([]).cast("array<struct<start:long,length:long>>"), put)
