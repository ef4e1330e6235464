"""Toxicity scores behind a noisy channel: obfuscated words are decoded, then judged.

Writers hide words behind look-alike characters, spacing and repetition. Every
suspicious run of characters becomes a lattice: each position may stand for
itself, for a letter it resembles, for nothing (separators), or a run may
collapse. A Viterbi search picks the path that is likeliest under a character
language model (four-grams counted over all documents, with the learned lexicon
mixed in) and the channel's costs. The restored words and the plain words are
then scored with a lexicon of words and word beginnings learned from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_trees import labelled_sample
from .textbytes import ALNUM, LOWER, NOT_SPACE, blocks, id_crc, mix, prefix_hash, put_bytes, small_batches, span_hash, whole_text, word_spans

#: Labelled rows that the lexicon is fitted on, at most; scoring covers every row.
SAMPLE_ROWS = 8_000
#: Letters that a character is commonly written for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou"}
#: Characters put between the letters of a word.
SEPARATORS = " .-_*~/\\"
#: Channel costs in natural logs.
LOOKALIKE_COST, KEEP_COST, DROP_COST, COLLAPSE_COST, MASK_COST = 1.5, 2.5, 0.7, 1.0, 3.0
#: Decoded segments that a worker remembers before it forgets all.
MEMO_LIMIT = 200_000
#: How often each lexicon word is added to the corpus counts, as a share of all characters.
LEXICON_SHARE = 0.02

#: Bytes of the word beginnings that the lexicon may hold beside whole words.
STEMS = (4, 5, 6, 7)
#: A lexicon entry must explain this share of the toxic texts.
NOISE_SHARE = 0.025

SYMBOLS = 28
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LOOKALIKES]] = True
_ENDING = np.zeros(256, bool)
_ENDING[[ord(c) for c in LOOKALIKES]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS if c != " "]] = True


def _readings() -> list[np.ndarray]:
    """Tables from a byte to the letter read for it, 1 for what is skipped and 0 for what stands between words.

    They differ in what may be more than one letter or nothing.
    """
    out = []
    for one, loose in (("i", True), ("l", True), ("i", False), ("l", False)):
        table = np.zeros(256, np.uint8)
        table[97:123], table[128:] = np.arange(97, 123), np.arange(128, 256)
        for c, letters in LOOKALIKES.items():
            table[ord(c)] = ord(one if letters == "il" else letters[0])
        table[[ord(c) for c in SEPARATORS + ("" if loose else "!|+(<")]] = 1
        out.append(table)
    return out


_READINGS = _readings()


def four_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of the four-grams of symbols in a block; each text starts after three boundaries."""
    n = len(offsets) - 1
    padded = np.zeros(len(data) + 4 * n, np.int64)
    padded[np.arange(len(data)) + 3 + 4 * np.repeat(np.arange(n), np.diff(offsets))] = _SYMBOL[data]
    return ((padded[:-3] * SYMBOLS + padded[1:-2]) * SYMBOLS + padded[2:-1]) * SYMBOLS + padded[3:]


def count_characters(docs: DataFrame) -> np.ndarray:
    """Counts of all SYMBOLS**4 four-grams over every whole text (a table of fixed size)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(four_grams(data, offsets), minlength=SYMBOLS**4)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["code", "n"])

    sums = docs.select(whole_text().alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**4)
    out[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    return out


def character_model(counts: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(symbol | last three), flattened; lower orders fill what higher ones have not seen."""
    counts = counts.copy()
    weight = max(100.0, LEXICON_SHARE * counts.sum() / max(1, sum(map(len, words))))
    for word in words:
        data = np.frombuffer(word.encode(), np.uint8)
        np.add.at(counts, four_grams(data, np.array([0, len(data)])), weight)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        c = counts.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) // max(1, p.size // SYMBOLS), 1))
        p = (c + 5 * lower) / (c.sum(1, keepdims=True) + 5)
    return np.log(p).ravel()


def positions(segment: str) -> list[tuple[str, int]]:
    """Runs of equal characters: (character, length)."""
    out: list[tuple[str, int]] = []
    for c in segment:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def arcs(c: str, run: int) -> list[tuple[str, float]]:
    """What a run may stand for: (output, cost)."""
    found: list[tuple[str, float]] = []
    if c.isascii() and c.isalpha():
        if run <= 2:
            found.append((c * run, 0.0))
        if run > 1:
            found += [(c, COLLAPSE_COST)] + [(c * 2, COLLAPSE_COST)] * (run > 2)
        return found
    if not c.isascii():
        return [(c * min(run, 2), 0.0)]
    for letter in LOOKALIKES.get(c, ""):
        cost = MASK_COST if c == "*" else LOOKALIKE_COST
        found.append((letter, cost + COLLAPSE_COST * (run > 1)))
        if run > 1:
            found.append((letter * 2, cost + COLLAPSE_COST * (run > 2)))
    if c in SEPARATORS or c in "!|+(<":
        found.append(("", DROP_COST))
    found.append((" ", KEEP_COST))
    return found


def decode(segment: str, model: np.ndarray) -> str:
    """The likeliest plain form of a segment, in lower case; words are split by spaces."""
    paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for c, run in [*positions(segment), ("\n", 1)]:
        step: dict[int, tuple[float, tuple]] = {}
        options = arcs(c, run) if c != "\n" else [(" ", 0.0)]
        for history, (score, back) in paths.items():
            for out, cost in options:
                s, h = score - cost, history
                for x in out:
                    symbol = 27 if x >= "\x80" else ord(x) - 96 if "a" <= x <= "z" else 0
                    if symbol or h % SYMBOLS:
                        s += model[h * SYMBOLS + symbol]
                        h = (h * SYMBOLS + symbol) % SYMBOLS**3
                if h not in step or s > step[h][0]:
                    step[h] = (s, (back, out) if out else back)
        paths = step
    back, out = max(paths.values(), key=lambda x: x[0])[1], []
    while back:
        back, piece = back
        out.append(piece)
    return " ".join("".join(reversed(out)).split())


def suspicious(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of segments that may hide words; `data` in lower case.

    A token is suspicious if a look-alike stands before its last letter or
    ends it, if a letter is repeated three times, or if its
    letters stand apart; so is a run of three or more one-letter tokens.
    """
    starts, ends, firsts = word_spans(data, offsets, NOT_SPACE)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    letter, leet, sep = _LETTER[data], _LEET[data], _SEPARATOR[data]
    run = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    letters, leets, seps = run(letter), run(leet), run(sep)
    count = letters[ends] - letters[starts]
    last = np.maximum.accumulate(np.where(letter, np.arange(len(data)), -1))[ends - 1]
    inner = (last >= starts) & (leets[np.maximum(last, 0)] - leets[np.minimum(starts, np.maximum(last, 0))] > 0)
    before = np.concatenate([[False], letter[:-1]])
    ending = run(_ENDING[data] & before)
    ended = (ending[ends] - ending[starts] > 0) & (count >= 2)
    triple = np.zeros(len(data), bool)
    triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    triples = run(triple)
    repeated = triples[ends] - triples[np.minimum(starts + 2, ends)] > 0
    between = seps[ends] - seps[starts]
    apart = (count + (leets[ends] - leets[starts]) >= 3) & (between >= 2) & (count <= between + 1)
    alone = (ends - starts == 1) & (letter | leet)[starts]
    marked = ((inner & (count >= 2)) | ended | (repeated & (count >= 3)) | apart) & ~alone
    edge = np.concatenate([[True], (of[1:] != of[:-1]) | ~alone[:-1] | ~alone[1:]])
    group = np.cumsum(edge)
    heads = np.flatnonzero(edge)
    sizes = np.diff(np.append(heads, len(edge)))
    heads, sizes = heads[alone[heads] & (sizes >= 3)], sizes[alone[heads] & (sizes >= 3)]
    del group
    whole = np.flatnonzero(marked)
    tails = heads + sizes - 1
    return np.concatenate([of[whole], of[heads]]), np.concatenate([starts[whole], starts[heads]]), np.concatenate([ends[whole], ends[tails]])


def skeletons(word: bytes) -> set[bytes]:
    """A word with each run of a letter as one or as several: separators may stand in a run or not."""
    out = {b""}
    for c, run in positions(word.decode("latin-1")):
        out = {x + c.encode("latin-1") * k for x in out for k in range(1, run + 1)}
    return out


def spread(data: np.ndarray, offsets: np.ndarray, words: set[bytes]) -> list[tuple[int, int, int]]:
    """(text index, start, end) of whole tokens over which a lexicon word is spaced out, doubled or misspelt; `data` in lower case.

    Separators, within a token and between tokens, are skipped and runs collapsed;
    where a word then begins, its tokens are taken, unless it is written plainly.
    """
    forms = sorted({x for w in words for x in skeletons(w) if len(x) > 1})
    sought = {n: np.sort(put_bytes([x for x in forms if len(x) == n])) for n in sorted({len(x) for x in forms})}
    pairs = np.zeros(1 << 16, bool)
    pairs[[x[0] << 8 | x[1] for x in forms]] = True
    known = set(forms)
    raw = data.tobytes()
    loose = np.zeros(len(data) + 1, bool)
    loose[offsets] = True
    found: set[tuple[int, int, int]] = set()
    for table in _READINGS:
        read = table[data]
        at = np.flatnonzero(read != 1)
        letters = read[at]
        head = np.ones(len(at), bool)
        head[1:] = (letters[1:] != letters[:-1]) | (np.diff(at) > 1) | loose[at[1:]]
        heads = np.flatnonzero(head)
        line = letters[heads]
        begin = np.flatnonzero(pairs[line[:-1].astype(np.int64) << 8 | line[1:]])
        first = at[heads[begin]]
        begin = begin[loose[first] | ~(_LETTER | (np.arange(256) >= 128))[data[first - 1]]]
        skeleton, sums = line.tobytes(), prefix_hash(line)
        for size, group in sought.items():
            some = begin[begin + size <= len(line)]
            h = span_hash(sums, some, some + size)
            for k in some[group[np.minimum(np.searchsorted(group, h), len(group) - 1)] == h].tolist():
                if skeleton[k : k + size] in known:
                    lo, hi = int(at[heads[k]]), int(at[heads[k + size] - 1 if k + size < len(heads) else -1]) + 1
                    i = int(np.searchsorted(offsets, lo, "right")) - 1
                    if hi <= offsets[i + 1] and raw[lo:hi] not in words:
                        found.add((i, lo, hi))
    out = []
    for i, lo, hi in found:
        while lo > offsets[i] and NOT_SPACE[raw[lo - 1]]:
            lo -= 1
        while hi < offsets[i + 1] and NOT_SPACE[raw[hi]]:
            hi += 1
        out.append((i, lo, hi))
    return out


def united(segments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments in order, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for i, lo, hi in sorted(segments):
        if out and out[-1][0] == i and lo < out[-1][2]:
            out[-1] = (i, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((i, lo, hi))
    return out


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index): each word whole, and its beginnings of STEMS bytes where more follows a whole character."""
    sums = prefix_hash(data)
    hashes, words = [span_hash(sums, starts, ends)], [np.arange(len(starts))]
    for k in STEMS:
        at = np.flatnonzero(ends - starts > k)
        at = at[(data[starts[at] + k] & 0xC0) != 0x80]
        hashes.append(mix(span_hash(sums, starts[at], starts[at] + k) + np.uint64(k)))
        words.append(at)
    return np.concatenate(hashes), np.concatenate(words)


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by the alphabet and the lexicon, not by the corpus."""

    words: list[str]
    hashes: np.ndarray  # of the words and word beginnings, sorted
    weights: np.ndarray  # (entries, 2): of the first occurrence, and of a second one
    rest: float  # log odds of a text without any of them
    characters: np.ndarray
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon index of each hash, or -1."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def hidden(self, segments: list[str]) -> list[np.ndarray]:
        """Lexicon entries in each segment, decoded; segments not seen before are decoded one by one and looked up together."""
        new = [x for x in dict.fromkeys(segments) if x not in self.memo]
        found: dict[str, np.ndarray] = {}
        if new:
            texts = [decode(x, self.characters).encode() for x in new]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            starts, ends, firsts = word_spans(data, offsets, NOT_SPACE)
            hashes, words = word_features(data, starts, ends)
            entry = self.find(hashes)
            hit = np.flatnonzero(entry >= 0)
            of = np.repeat(np.arange(len(new)), np.diff(firsts))[words[hit]]
            order = np.argsort(of, kind="stable")
            found = dict(zip(new, np.split(entry[hit][order], np.searchsorted(of[order], np.arange(1, len(new)))), strict=True))
        out = [found[x] if x in found else self.memo[x] for x in segments]
        if len(self.memo) + len(new) > MEMO_LIMIT:
            self.memo.clear()
        self.memo.update((x, found[x]) for x in new[:MEMO_LIMIT] if len(x) <= 64)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, lexicon entries found plainly, entries restored) for each text of a block."""
        n, k = len(offsets) - 1, max(1, len(self.hashes))
        low = LOWER[data]
        starts, ends, firsts = word_spans(low, offsets, ALNUM)
        of = np.repeat(np.arange(n), np.diff(firsts))
        hashes, words = word_features(low, starts, ends)
        hit = self.find(hashes)
        plain = of[words[hit >= 0]] * k + hit[hit >= 0]
        raw = low.tobytes()
        segments = list(zip(*(x.tolist() for x in suspicious(low, offsets)), strict=True))
        segments = united(segments + spread(low, offsets, {w.encode() for w in self.words}))
        entries = self.hidden([raw[start:end].decode("utf-8", "replace") for _, start, end in segments])
        restored = np.concatenate([np.zeros(0, np.int64), *(text * k + x for (text, _, _), x in zip(segments, entries, strict=True) if len(x))])
        keys, times = np.unique(np.concatenate([plain, restored]), return_counts=True)
        odds = np.full(n, self.rest)
        if len(keys):
            odds += np.bincount(keys // k, self.weights[keys % k, 0] + self.weights[keys % k, 1] * (times > 1), minlength=n)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30))), np.bincount(plain // k, minlength=n)[:n], np.bincount(restored // k, minlength=n)[:n]


def learn_lexicon(found: list[np.ndarray], toxic: np.ndarray, sizes: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """(signs picked, weights, log odds without any), from the signs found in each labelled text.

    A sign is an entry that occurs, or one that occurs twice. Signs are taken
    one by one by what they explain: toxic texts not explained yet, with a
    quarter of all toxic texts that have the sign, against three times the clean
    ones. The search ends where this could be label noise. A sign that explains
    nothing new is taken only if it is pure, common and not just another form of
    one taken before. Of signs that explain as much, the longest is taken.
    """
    n_toxic, n_clean, signs = int(toxic.sum()), int((~toxic).sum()), len(sizes)
    has = np.zeros((n_toxic, signs), bool)
    for row, at in zip(has, (x for x, t in zip(found, toxic, strict=True) if t), strict=True):
        row[at] = True
    clean = [x for x, t in zip(found, toxic, strict=True) if not t]
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *clean]), minlength=signs)[:signs]
    total, left, picked = has.sum(0), np.ones(n_toxic, bool), []
    least = max(3, round(NOISE_SHARE * n_toxic))
    rare = (seen / max(1, n_clean) <= 0.1 * total / max(1, n_toxic)) & (total > 0)
    pure = (seen <= 0.002 * n_clean) & (total >= max(3, 0.1 * n_toxic))
    while rare.any():
        fresh = has[left].sum(0)
        gain = np.where(rare & ((fresh > 1) | pure), fresh + total / 4 - 3 * seen + sizes / 1000, -1)
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        picked.append(best)
        left &= ~has[:, best]
        rare[best] = False
        pure &= (has & ~has[:, [best]]).sum(0) > 0.2 * total
    free_clean = sum(not np.isin(picked, x).any() for x in clean)
    weights = np.log((total[picked] + 0.5) / (n_toxic + 1)) - np.log((seen[picked] + 0.5) / (n_clean + 1))
    rest = math.log((left.sum() + 0.5) / (free_clean + 0.5))
    # one sign must be able to decide, however thin the sample
    return picked, np.maximum(weights, 1.0 - rest), rest


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from at most `sample_rows` labelled rows outside the held-out fold and the characters of all texts."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, sample_rows).persist()

    def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
        return data, starts, ends, *word_features(data, starts, ends)

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(features(t)[3]).tobytes() for t in batch.column(0).to_pylist()], pa.binary()), batch.column(0)], ["entries", "text"])

    # each toxic text of the bounded sample, with the hashes of its words and their beginnings
    toxic = sample.where("label = 1").select("text").mapInArrow(of_toxic, "entries binary, text string").toArrow().sort_by("text")
    flat_entries = np.frombuffer(b"".join(toxic.column("entries").to_pylist()), np.uint64)
    each, n = np.unique(flat_entries, return_counts=True)
    # a sign in fewer toxic texts cannot reach what learn_lexicon asks for
    frequent = each[n >= 0.8 * max(3, round(NOISE_SHARE * len(toxic)))]

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                own, times = np.unique(features(t)[3], return_counts=True)
                at = np.searchsorted(frequent, own)
                known = at < len(frequent)
                known[known] = frequent[at[known]] == own[known]
                out.append(np.concatenate([at[known], at[known & (times > 1)] + len(frequent)]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["found", "label"])

    names: dict[int, str] = {}
    for text in toxic.column("text").to_pylist():
        data, starts, ends, own, words = features(text)
        cuts = _stem_cuts(starts, ends, data)
        for i in np.flatnonzero(np.isin(own, frequent)).tolist():
            if int(own[i]) not in names:
                k = ends[words[i]] - starts[words[i]] if i < len(starts) else STEMS[int(np.searchsorted(cuts, i, "right")) - 1]
                names[int(own[i])] = data[starts[words[i]] : starts[words[i]] + k].tobytes().decode("utf-8", "replace")
    got = sample.mapInArrow(of_all, "found binary, label int").toArrow().sort_by([("label", "ascending"), ("found", "ascending")])
    sample.unpersist()
    found = [np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("found").to_pylist()]
    sizes = np.array([len(names[int(h)]) for h in frequent], np.int64)
    picked, gained, rest = learn_lexicon(found, got.column("label").to_numpy() == 1, np.concatenate([sizes, sizes]))
    used = np.unique(np.array(picked, np.int64) % max(1, len(frequent)))
    hashes, weights = frequent[used], np.zeros((len(used), 2))
    for sign, weight in zip(picked, gained, strict=True):
        weights[np.searchsorted(used, sign % len(frequent)), sign // len(frequent)] = weight
    words = [names[int(h)] for h in hashes]
    del found, got, toxic, flat_entries, names
    pa.default_memory_pool().release_unused()
    return ToxicityModel(words, hashes, weights, rest, character_model(count_characters(docs), words))


def _stem_cuts(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where the hashes of each stem length begin in what ``word_features`` returns."""
    sizes = [len(starts)]
    for k in STEMS[:-1]:
        at = np.flatnonzero(ends - starts > k)
        sizes.append(int(((data[starts[at] + k] & 0xC0) != 0x80).sum()))
    return np.cumsum(sizes)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, plain_hits, restored_hits) for each row, and the columns in `carry` as struct `carried`.

    Null and empty texts get the score of a text without lexicon words; rows
    that repeat are scored each; other columns are not read; an empty table
    gives none. Texts are decoded whole, whatever their length.
    """
    small_batches(docs.sparkSession)
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), whole_text().alias("text"), *more)
    names = ["doc_id", "held_out", "score", "predicted", "plain_hits", "restored_hits", *rows.columns[3:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [model.score(data, offsets) for _, _, data, offsets in blocks(batch.column(2))] or [(np.zeros(0), np.zeros(0, int), np.zeros(0, int))]
            s, plain, restored = (np.concatenate(x) for x in zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32()), pa.array(plain, pa.int32()), pa.array(restored, pa.int32()), *batch.columns[3:]],
                names,
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, held_out boolean, score double, predicted int, plain_hits int, restored_hits int" + (f", carried {kinds['carried']}" if more else ""))
