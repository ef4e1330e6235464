"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from numpy over blocks of texts; the trees are grown on the
driver from a bounded sample of labelled rows and laid out as flat arrays
(feature, threshold, value per node of a complete tree), so that scoring walks
all rows of a block through all trees level by level without a Python loop over
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, NOT_SPACE, blocks, id_crc, mix, prefix_hash, small_batches, span_hash, whole_text, word_spans

#: Labelled rows that the trees are fitted on, at most; scoring covers every row.
SAMPLE_ROWS = 20_000

_CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)  # other ASCII: symbols and controls
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 13]] = 3
_CLASS[10] = 4
_CLASS[list(b".,;:'\"-?()")] = 5
_CLASS[128:] = 7
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False

FEATURES = ["log_bytes", "lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "beyond_ascii", "log_words", "word_mean", "word_sd", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "log_lines", "distinct_lines", "line_bytes", "capital_words", "symbol_ends", "one_byte_words", "long_words", "byte_entropy"]


def _per_text(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights, minlength=n)[:n].astype(np.float64)


def _distinct(keys: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its commonest."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(keys ^ mix(index.astype(np.uint64) + np.uint64(1)), kind="stable")
    k, d = keys[order], index[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, d[new], np.diff(np.append(new, len(k))))
    return _per_text(d[new], n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of a block; an empty text has zeros but for fixed ratios of one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    parts = np.bincount(of * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    low = LOWER[data]
    sums = prefix_hash(low)
    starts, ends, firsts = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(firsts)
    w_of = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    hashes = span_hash(sums, starts, ends)
    count = np.maximum(words, 1)
    mean = _per_text(w_of, n, length) / count
    sd = np.sqrt(np.maximum(_per_text(w_of, n, length**2) / count - mean**2, 0))
    distinct, top = _distinct(hashes, w_of, n)
    pair = (w_of[1:] == w_of[:-1]) if len(w_of) else np.zeros(0, bool)
    p_of = w_of[1:][pair]
    same = _per_text(p_of, n, (hashes[1:] == hashes[:-1])[pair].astype(float))
    pairs, _ = _distinct(mix(hashes[:-1] * np.uint64(3) + hashes[1:])[pair], p_of, n) if len(p_of) else (np.zeros(n), None)
    l_starts, l_ends, l_firsts = word_spans(data, offsets, _NOT_NEWLINE)
    lines = np.diff(l_firsts)
    l_of = np.repeat(np.arange(n), lines)
    d_lines, _ = _distinct(span_hash(sums, l_starts, l_ends), l_of, n)
    upper = np.concatenate([[0], np.cumsum(kinds == 1)])
    capital = _per_text(w_of, n, ((upper[ends] - upper[starts]) >= np.maximum(2, 0.6 * length)).astype(float))
    symbol_end = _per_text(w_of, n, (kinds[ends - 1] == 6).astype(float)) if len(ends) else np.zeros(n)
    share = np.where(parts > 0, parts, 1)
    return np.column_stack(
        [np.log1p(size), *parts[:, [0, 1, 2, 3, 4, 5, 6, 7]].T, np.log1p(words), mean, sd, (distinct + 1) / (words + 1), top / count, same / count, (pairs + 1) / np.maximum(words, 1), np.log1p(lines), (d_lines + 1) / (lines + 1), size / np.maximum(lines, 1)]
        + [capital / count, symbol_end / count, _per_text(w_of, n, (length == 1).astype(float)) / count, _per_text(w_of, n, (length > 20).astype(float)) / count, -(share * np.log(share)).sum(1)]
    )


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as arrays: nodes (trees, 2**depth - 1), leaves (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(self.leaf.shape[1].bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.leaf[trees, at - self.feature.shape[1]].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Boosted trees under logistic loss; splits are searched over per-node histograms of binned features.

    No rows, or rows of one label only, give a constant score.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    slots = binned + np.arange(width) * bins
    raw = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = ((at - first)[:, None] * (width * bins) + slots).ravel()
            size = nodes * width * bins
            G, H = (np.bincount(key, np.repeat(v, width), size).reshape(nodes, width, bins).cumsum(2) for v in (g, h))
            total_g, total_h = G[:, :1, -1:], H[:, :1, -1:]
            gain = G**2 / (H + ridge) + (total_g - G) ** 2 / (total_h - H + ridge) - total_g**2 / (total_h + ridge)
            gain[(H < least) | (total_h - H < least)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // bins, best % bins
            good = gain.reshape(nodes, -1).max(1) > 1e-9
            for k in np.flatnonzero(good):
                if b[k] < len(edges[f[k]]):
                    feature[t, first + k], threshold[t, first + k] = f[k], edges[f[k]][b[k]]
            here = at
            at = 2 * at + 1 + (x[np.arange(n), feature[t, here]] > threshold[t, here])
        at -= inner
        leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold: int = 5) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, picked by hash of the id.

    The picked ids have a fixed bound, so they are broadcast against the documents.
    Null ids and null labels are left out; of several labels for an id the largest holds,
    of several texts the least.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null and label in (0, 1)")
    known = known.where(id_crc() % fold != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees that give the chance of label 1, from a sample of at most `sample_rows` labelled rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(data, offsets) for _, _, data, offsets in blocks(batch.column(0))]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(np.vstack(x).astype("<f8").view(f"V{8 * len(FEATURES)}").ravel().tolist(), pa.binary()), batch.column(1)], ["x", "y"])

    got = labelled_sample(docs, labels, label, sample_rows).mapInArrow(run, "x binary, y int").toArrow()
    got = got.sort_by([("x", "ascending"), ("y", "ascending")])  # the order of rows must not change the sums
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f8").reshape(-1, len(FEATURES))
    return fit_trees(x, got.column("y").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Null and empty texts get the score of their (zero) statistics; repeated
    rows are scored each; other columns are not read; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [trees.score(statistics(data, offsets)) for _, _, data, offsets in blocks(batch.column(2))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
