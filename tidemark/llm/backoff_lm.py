"""Language-model scores from a weighted backoff automaton over words.

Counts of n-grams over all training texts make a smoothed model of a given
order. Each n-gram seen is an arc into itself: from the state of its words but
the last, under that last word, with its smoothed probability. Each n-gram
shorter than the order is a state as well, with a failure arc that carries its
backoff weight to the n-gram without the first word, and in the end to the root,
which has an arc for each word and one for all unknown words:

    P(w | root) = (1 - e) c(w) / N        P(unknown | root) = e
    P(w | h)    = (c(h w) + m P(w | h without its first word)) / (c(h) + m)

e is the share of words seen once (Good and Turing's estimate of what has not
been seen), m the strength of the backoff. A text is one left-to-right pass that
carries the state and adds up the logs of the arcs taken.

The model is never gathered in one place. Texts are packed into chunks where they
are read; a chunk sends its distinct n-grams, sorted by hash and packed by hash
range (a shard), with its training counts; each shard adds up the counts of all
chunks and sends every chunk the totals of just what it asked for, in the order it
asked; the chunk finds its n-grams again, builds its part of the automaton and
traverses its texts. A frequent n-gram is one entry a chunk, so no key is hot.
The n-grams travel once and the texts once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .textbytes import LOWER, NOT_SPACE, blocks, flat, id_crc, mix, prefix_hash, small_batches, span_hash, total_bytes, whole_text, word_spans

#: Bytes of text in one chunk, about.
CHUNK = 16 << 20
#: Bytes of one row group of stored chunks, which are some MB each; the writer looks at its size after every chunk.
STORE = {"parquet.block.size": CHUNK, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Words of the longest n-grams, and backoff strength m.
ORDER, STRENGTH = 2, 300.0
#: States that are no n-gram.
ROOT = -1
#: n-grams are told apart by this many bits of their hash.
KEY_BITS = 56
#: Hash of the end of a text, and of the state before its first word.
END, START = np.uint64(0x51ED270B), np.uint64(0x2545F491)

_SHIFT = np.uint64(64 - KEY_BITS)


def pack(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes, compressed; ascending keys go in as differences."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, next((k for k in range(8, 0, -1) if planes[k - 1].any()), 1)) if values.size else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(blob: bytes) -> np.ndarray:
    used = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_table(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()


def chunks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows of whole texts of about `size` bytes together, 16 more counted for each; a longer text is a chunk of its own."""
    held, room = [], size
    for batch in batches:
        ends, lo = flat(batch.column("text"))[1] + 16 * np.arange(len(batch) + 1), 0
        while lo < len(batch):
            hi = int(np.searchsorted(ends, ends[lo] + room, "right")) - 1
            if hi == lo and not held:
                hi += 1
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
            room -= int(ends[hi] - ends[lo])
            lo = hi
            if lo < len(batch) or room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], size
    if held:
        yield pa.Table.from_batches(held)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of a block, first token of each text and the end): words, then one END a text."""
    low = LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, NOT_SPACE)
    n = len(offsets) - 1
    counts = np.diff(firsts)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), counts)] = span_hash(prefix_hash(low), starts, ends)
    return out, at


def ngrams(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length, the key of the n-gram that ends in each token (0 where a text is too short for it).

    Texts begin with START, which counts as a word of longer n-grams only. The
    lowest two bits of a key tell the length.
    """
    whole, out = tokens, [(mix(tokens) >> _SHIFT) << np.uint64(2)]
    reach = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at)) + 2
    for length in range(2, order + 1):
        before = np.empty_like(whole)
        before[1:] = whole[:-1]
        if length == 2:
            before[at[:-1]] = START
        whole = mix(mix(before) * np.uint64(0x9FB21C651E98DF25) + tokens)
        out.append(np.where(reach >= length, (whole >> _SHIFT) << np.uint64(2) | np.uint64(length - 1), np.uint64(0)))
    return out


def texts_of(chunk: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(training flags, tokens, firsts) of a chunk, block by block in its order of rows."""
    train = chunk.column("train").to_numpy(zero_copy_only=False)
    row = 0
    for part in chunk.column("text").chunks:
        for lo, hi, data, offsets in blocks(part):
            tokens, at = tokens_of(data, offsets)
            yield train[row + lo : row + hi], tokens, at
        row += len(part)


def _requests(chunk: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the n-grams of a chunk, and their counts in training texts."""
    keys = []
    for train, tokens, at in texts_of(chunk):
        in_train = np.repeat(train, np.diff(at))
        for k in ngrams(tokens, at, order):
            # the lowest bit carries the training flag through one sort
            keys.append((k << np.uint64(1) | in_train)[k > 0])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a chunk's n-grams are several times its texts: no more copies than needed are alive at once
    both, end = np.empty(sum(map(len, keys)), np.uint64), 0
    while keys:
        part = keys.pop()
        both[end : end + len(part)] = part
        end += len(part)
    both.sort()
    new = np.flatnonzero(np.concatenate([[True], both[1:] ^ both[:-1] > np.uint64(1)]))
    found = both[new] >> np.uint64(1)
    both &= np.uint64(1)
    return found, np.add.reduceat(both, new).astype(np.int64)


@dataclass(frozen=True)
class Totals:
    """Counts over all training texts: tokens, distinct tokens, those seen once, texts."""

    tokens: int
    distinct: int
    once: int
    texts: int

    @property
    def unknown(self) -> float:
        return min(0.5, max(self.once, 1) / (self.tokens + 2)) if self.tokens else 1.0


class Automaton:
    """The part of the model that some texts need, as tables with an entry for each n-gram.

    keys: sorted; counts: in training texts; weight: log10 of the arc into the
    n-gram; failure: the state that its failure arc leads to. The state START
    comes after all entries. Arcs and failure arcs are put in for a block of
    texts before it is traversed.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: Totals, strength: float, order: int):
        self.keys, self.totals, self.strength, self.order = keys, totals, strength, order
        self.counts = np.append(counts, totals.texts)
        self.start = len(keys)
        self.weight = np.zeros(len(keys))
        self.failure = np.full(len(keys) + 1, ROOT, np.int32)

    def entries(self, tokens: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length: the entry of the n-gram that ends in each token, and of the one before it; ROOT for unseen ones."""
        here, before = [], []
        for length, keys in enumerate(ngrams(tokens, at, self.order)):
            found = np.full(len(keys), ROOT, np.int64)
            real = np.flatnonzero(keys)
            real = real[np.argsort(keys[real])]  # ascending needles keep the search in the processor's caches
            found[real] = np.searchsorted(self.keys, keys[real])
            found[real[self.counts[found[real]] == 0]] = ROOT
            moved = np.empty_like(found)
            moved[1:] = found[:-1]
            moved[at[:-1]] = ROOT if length else self.start
            here.append(found)
            before.append(moved)
        return here, before

    def connect(self, here: list[np.ndarray], before: list[np.ndarray]) -> None:
        """Puts in the arcs and failure arcs of the n-grams of a block."""
        t, seen = self.totals, here[0][here[0] >= 0]
        self.weight[seen] = np.log10((1 - t.unknown) * self.counts[seen] / max(1, t.tokens))
        for length in range(1, self.order):
            seen = np.flatnonzero(here[length] >= 0)
            arc, lower, state = here[length][seen], here[length - 1][seen], before[length - 1][seen]
            self.weight[arc] = np.log10((self.counts[arc] + self.strength * 10 ** self.weight[lower]) / (self.counts[state] + self.strength))
            self.failure[arc] = lower

    def traverse(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight of the arcs taken at each token, training count of the token).

        The state before a token is the longest seen n-gram, shorter than the
        order, that ends there; without an arc for the token its failure arcs
        are taken until there is one.
        """
        here, before = self.entries(tokens, at)
        self.connect(here, before)
        state, depth = np.full(len(tokens), ROOT, np.int64), np.zeros(len(tokens), np.int64)
        for length, known in enumerate(before[: self.order - 1], 1):
            state = np.where(known >= 0, known, state)
            depth[known >= 0] = length
        total, waiting = np.zeros(len(tokens)), np.arange(len(tokens))
        for length in range(self.order - 1, -1, -1):
            at_length = depth[waiting] == length
            now, arc = waiting[at_length], here[length][waiting[at_length]]
            total[now[arc >= 0]] += self.weight[arc[arc >= 0]]
            failed = now[arc < 0]
            if length:
                total[failed] += np.log10(self.strength / (self.counts[state[failed]] + self.strength))
                state[failed] = self.failure[state[failed]]
                depth[failed] -= 1
                waiting = np.concatenate([waiting[~at_length], failed])
            else:
                total[failed] += np.log10(self.totals.unknown)
        return total, np.where(here[0] >= 0, self.counts[here[0]], 0)


def score_texts(docs: DataFrame, train: Column | None = None, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    train: a boolean column of `docs`, by default crc32(doc_id as text) mod 7
    other than 2; the model counts all texts where it holds. base_score is the
    add-one unigram score under the same counts. order: 4 at most. Null and empty texts have one
    token (the end); repeated rows count and are scored each; without training
    texts every token is unknown; an empty table gives none.
    """
    if not 1 <= order <= 4:
        raise ValueError("order from 1 to 4")
    small_batches(docs.sparkSession)
    train = (id_crc() % 7 != 2) if train is None else train
    rows = docs.select("doc_id", train.alias("train"), whole_text().alias("text"))
    chunks = max(1, -(-total_bytes(docs) // chunk_bytes))
    shards = max(1, min(4096, 2 * chunks))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, chunk in enumerate(chunks_of(batches, chunk_bytes)):
            yield pa.record_batch({"chunk": pa.array([first + k], pa.int64()), "texts": pa.array([pack_table(chunk)], pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << (KEY_BITS + 2)) // shards for k in range(1, shards)], np.uint64)
        for batch in batches:
            for name, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                keys, counts = _requests(unpack_table(texts.as_buffer()), order)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                out = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                packed = [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in out]
                yield pa.record_batch({"shard": pa.array([k for k, _, _ in out], pa.int32()), "chunk": pa.array([name] * len(out), pa.int64()), "keys": pa.array(packed, pa.binary()), "counts": pa.array([pack(counts[a:b]) for _, a, b in out], pa.binary())})

    def answer(asked: pa.Table) -> pa.Table:
        names = asked.column("chunk").to_pylist()
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x).astype(np.int64) for x in asked.column("counts").to_pylist()])
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(counts[order], new)
        total = np.empty(len(flat), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(new, len(flat))))
        words = sums[(ordered[new] & np.uint64(3)) == 0]
        n = len(names)
        facts = {"tokens": int(words.sum()), "distinct": int((words > 0).sum()), "once": int((words == 1).sum())}
        return pa.table(
            {"chunk": pa.array(names, pa.int64()), "shard": pa.array([asked.column("shard")[0].as_py()] * n, pa.int32()), "totals": pa.array([pack(x) for x in np.split(total, sizes)], pa.binary())}
            | {k: pa.array([v] + [0] * (n - 1), pa.int64()) for k, v in facts.items()}
        )

    # a chunk is written before it asks, so that the answers meet the same chunk; small partitions are read together to make whole ones
    dealt = saved(rows.coalesce(chunks).mapInArrow(deal, "chunk long, texts binary"), "ngram_texts", **STORE)
    asked = dealt.mapInArrow(ask, "shard int, chunk long, keys binary, counts binary")
    answers = saved(asked.groupBy("shard").applyInArrow(answer, "chunk long, shard int, totals binary, tokens long, distinct long, once long"), "ngram_counts")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "once")]).first()
    texts = docs.select(F.count_if(train).alias("n")).first()["n"]
    totals = Totals(sums["tokens"], sums["distinct"], sums["once"], texts)
    base_low = np.log10(totals.tokens + totals.distinct + 1)

    def score(dealt: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = unpack_table(dealt.column("texts")[0].as_buffer())
        keys, counts = _requests(chunk, order)
        by_shard, found = np.argsort(replies.column("shard").to_numpy()), replies.column("totals").to_pylist()
        model = Automaton(keys, np.concatenate([counts[:0], *(unpack(found[i]).astype(np.int64) for i in by_shard)]), totals, strength, order)
        if len(model.counts) != len(keys) + 1:
            raise RuntimeError("a chunk's answers are not those to its n-grams")
        n_tokens, known, base, full = [], [], [], []
        for _, tokens, at in texts_of(chunk):
            weight, c = model.traverse(tokens, at)
            n_tokens.append(np.diff(at))
            known.append(np.add.reduceat((c > 0).astype(np.int64), at[:-1]))
            base.append(np.add.reduceat(np.log10(c + 1) - base_low, at[:-1]))
            full.append(np.add.reduceat(weight, at[:-1]))
        held = pa.array(~chunk.column("train").to_numpy(zero_copy_only=False))
        join = lambda x, k: pa.array(np.concatenate(x) if x else np.zeros(0), k)
        return pa.table({"doc_id": chunk.column("doc_id"), "held_out": held, "n_tokens": join(n_tokens, pa.int64()), "n_known": join(known, pa.int64()), "train_tokens": pa.array([totals.tokens] * len(held), pa.int64()), "base_score": join(base, pa.float64()), "score": join(full, pa.float64())})

    slim = answers.select("chunk", "shard", "totals")
    return dealt.groupBy("chunk").cogroup(slim.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
