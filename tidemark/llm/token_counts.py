"""Exact token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding of a piece of text is valid when each two neighbouring
tokens are what the encoder makes of their joined bytes. So the encoding of the
first i bytes ends in the one token t that fits both the bytes and the last
token of the encoding of the first i - len(t) bytes, and

    count[i] = count[i - len(t)] + 1

fills a table of counts and last tokens for all prefixes in one left-to-right
pass. Truncation and budget questions are answered from the table: counts say
where a budget ends, last tokens lead back from any prefix to its cuts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import small_batches, whole_text

#: How byte-level encoders cut text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's tables hold before they are emptied.
TABLE_LIMIT = 1_000_000
#: Longest piece whose table is kept.
KEEP_BYTES = 64


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixTables:
    """Prefix counts under one tokenizer file; one per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        pre = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec["normalizer"] or pre.get("add_prefix_space") or model.get("ignore_merges") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only plain byte-level BPE files are handled")
        added = spec["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not handled")
        self.model = Tokenizer.from_file(path).model
        self.letters = _byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.piece_pattern = regex.compile(PIECES)
        self.pieces = self.piece_pattern.findall
        self.added = [x["content"] for x in sorted(added, key=lambda x: -len(x["content"])) if x["content"]]
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.fits: dict[int, bool] = {}
        self.totals: dict[str, int] = {}

    def _fit(self, before: int, token: int) -> bool:
        """Whether the encoder leaves the two tokens as they are when they meet (before = -1: the token alone)."""
        key = (before + 1) << 32 | token
        known = self.fits.get(key)
        if known is None:
            whole = (self.bytes_of[before] if before >= 0 else b"") + self.bytes_of[token]
            made = self.model.tokenize("".join(map(self.letters.__getitem__, whole)))
            known = [x.id for x in made] == ([before, token] if before >= 0 else [token])
            if len(self.fits) >= TABLE_LIMIT:
                self.fits.clear()
            self.fits[key] = known
        return known

    def table(self, piece: bytes) -> tuple[list[int], list[int]]:
        """(counts, last): the tokens of the first i bytes of a piece, and the last of them (-1 for none)."""
        n, ids, longest, fits = len(piece), self.ids, self.longest, self.fits
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(piece[start:end])
                if token is not None:
                    before = last[start]
                    fit = fits.get((before + 1) << 32 | token)
                    if fit if fit is not None else self._fit(before, token):
                        counts[end], last[end] = counts[start] + 1, token
                        break
            else:
                raise AssertionError(f"no encoding of {piece[:end]!r}")
        return counts, last

    def cuts(self, piece: bytes) -> list[int]:
        """Where the tokens of a piece end, from 0 to its length: last tokens are followed back from the end."""
        _, last = self.table(piece)
        back = [len(piece)]
        while back[-1]:
            back.append(back[-1] - len(self.bytes_of[last[back[-1]]]))
        return back[::-1]

    def count(self, piece: str) -> int:
        """Tokens of a piece; those of short pieces are remembered."""
        total = self.totals.get(piece)
        if total is None:
            total = self.table(piece.encode())[0][-1]
            if len(piece) <= KEEP_BYTES:
                if len(self.totals) >= TABLE_LIMIT:
                    self.totals.clear()
                self.totals[piece] = total
        return total

    def total(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens count as one token each."""
        parts = self.special.split(text) if any(x in text for x in self.added) else (text,)
        n, known = len(parts) - 1, self.totals.get
        for part in parts:
            for piece in self.pieces(part):
                count = known(piece)
                n += self.count(piece) if count is None else count
        return n

    def steps(self, text: str) -> Iterator[tuple[str, int]]:
        """(piece, its tokens) from left to right; special tokens are pieces of one token."""
        here = 0
        for found in self.special.finditer(text) if self.special else ():
            for x in self.scan(text, here, found.start()):
                yield x.group(), self.count(x.group())
            yield found.group(), 1
            here = found.end()
        for x in self.scan(text, here, len(text)):
            yield x.group(), self.count(x.group())

    def scan(self, text: str, start: int, end: int) -> Iterator:
        """The pieces of a stretch between special tokens, which is cut as if it stood alone."""
        return self.piece_pattern.finditer(text if (start, end) == (0, len(text)) else text[start:end])

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """(ends, counts): after each piece, its end in bytes and the tokens so far."""
        ends, counts = [0], [0]
        for piece, n in self.steps(text):
            ends.append(ends[-1] + len(piece.encode()))
            counts.append(counts[-1] + n)
        return ends, counts

    def within(self, text: str, budget: int) -> int:
        """The leading bytes that the text's own first `budget` tokens cover; no more of the text is looked at."""
        at = used = 0
        for piece, n in self.steps(text):
            if used + n > budget:
                return at + (self.cuts(piece.encode())[budget - used] if budget > used else 0)
            at, used = at + len(piece.encode()), used + n
        return at


_tables: dict[str, PrefixTables] = {}


def tables_for(path: str) -> PrefixTables:
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tables[path] = PrefixTables(path)
    return _tables[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token counts of whole texts: (id, n_bytes, n_tokens, over_limit, limit_bytes).

    tokenizer: a byte-level BPE file in the `tokenizers` format, at the same
    path on every executor. limit_bytes: how many leading bytes the first
    `limit` tokens cover when there are more, else n_bytes; it is looked up in
    the same prefix tables. One row for each input row, repeated rows included, in any
    order; a null text counts as empty (0 bytes, 0 tokens), a null id stays
    null, an empty table gives none; other columns are not read. No shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_for(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            totals = list(map(tables.total, texts))
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array([tables.within(x, limit) if n > limit else k for x, n, k in zip(texts, totals, sizes, strict=True)], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def truncate_texts(docs: DataFrame, tokenizer: str, budget: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, n_tokens): each text cut after its own first `budget` tokens, at a whole character.

    Null texts give empty ones; a budget of 0 gives empty texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_for(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cut = [x.encode()[: tables.within(x, budget)].decode("utf-8", "ignore") for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), pa.array([min(budget, tables.total(x)) for x in texts], pa.int64())], ["doc_id", "text", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_tokens long")
