"""Operators on single texts against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import png_columns as png
from tidemark.llm.backoff_lm import STRENGTH, pack, score_texts, unpack
from tidemark.llm.license_digests import KNOWN, scan
from tidemark.llm.quality_trees import fit_quality, fit_trees, score_quality
from tidemark.llm.toxicity import fit_toxicity, score_toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_token_counts_and_prefixes(docs, nothing, rows):
    from tidemark.llm.token_counts import PrefixTables, count_tokens, truncate_texts

    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    ends = lambda t, n: len(library.decode(library.encode(t, add_special_tokens=False).ids[:n], skip_special_tokens=False).encode())
    limit = 40
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > limit) for i, t, *_ in rows), key=repr)
    got = count_tokens(docs, path, limit=limit).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    by_id = {i: t or "" for i, t, *_ in rows if (t or "").isascii()}
    assert all(r["limit_bytes"] == (ends(by_id[r["doc_id"]], limit) if r["over_limit"] else r["n_bytes"]) for r in got if r["doc_id"] in by_id)
    assert count_tokens(nothing, path).count() == 0
    tables = PrefixTables(path)
    for t in ["", "it'll be  <|endoftext|> naïve\n\n\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "漢字 \x1c\x85 '", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <"]:
        assert tables.total(t) == count(t)
        at, counts = tables.prefixes(t)
        assert at[-1] == len(t.encode()) and counts[-1] == count(t)
    rng = random.Random(5)
    for _ in range(60):
        piece = " " * rng.randint(0, 1) + "".join(rng.choice("aeinorstlu") for _ in range(rng.randint(1, 24)))
        raw = piece.encode()
        made = [[x.id for x in tables.model.tokenize("".join(tables.letters[b] for b in raw[:k]))] for k in range(len(raw) + 1)]
        counts, last = tables.table(raw)
        assert counts == [len(x) for x in made] and last == [x[-1] if x else -1 for x in made]
        assert np.diff(tables.cuts(raw)).tolist() == [len(tables.bytes_of[x]) for x in made[-1]]
    text = "some longer text to be cut"
    ids = library.encode(text).ids
    for n in range(len(ids) + 2):
        assert text.encode()[: tables.within(text, n)].decode() == library.decode(ids[:n])
    assert {r["n_tokens"] for r in truncate_texts(docs, path, 3).collect()} <= {0, 1, 2, 3}


def test_images_round_trip_and_damage(spark, docs, rows):
    read = png.read_media(png.store_texts(docs)).select("doc_id", "n_bytes", "payload", "payload_sha256", "tail_crc32", "error").collect()
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        full = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want.append((i, len(b), full, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), None))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3], r[4], r[5]) for r in read), key=repr) == sorted(want, key=repr)
    good = png.write_png(png.text_image(b"x" * 500))
    bad = [good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-3], b"no image", good + b"x", None]
    seen = png.read_media(spark.createDataFrame([(k, b) for k, b in enumerate(bad)], "doc_id int, media binary")).collect()
    assert len(seen) == 5 and all(r["error"] and r["payload"] is None for r in seen)


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (9, 13)).astype(np.int64)
    rows = np.zeros((9, 14), np.uint8)
    rows[:, 0] = kind
    for y in range(9):
        for x in range(13):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x + 1] = (image[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (png.unfilter(rows) == image).all()


def test_cosine_hash_is_stable_under_small_changes():
    x = np.kron(np.random.default_rng(1).integers(20, 230, (8, 8)), np.ones((12, 8), int)).astype(np.uint8)
    noisy = (x + np.random.default_rng(0).integers(-2, 3, x.shape)).astype(np.uint8)
    far = bin(int(png.cosine_hash(x), 16) ^ int(png.cosine_hash(noisy), 16)).count("1")
    assert far <= 12 and len(png.cosine_hash(x[:1])) == 16


def test_cosine_hash_equals_plain_sums():
    """Means of rectangles and cosine sums written out, for images larger and smaller than the grid."""
    rng = np.random.default_rng(8)
    for shape in ((96, 64), (33, 64), (1, 64), (700, 64)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        grid = [[0.0] * png.GRID for _ in range(png.GRID)]
        for i in range(png.GRID):
            for j in range(png.GRID):
                r0, r1 = i * shape[0] // png.GRID, max((i + 1) * shape[0] // png.GRID, i * shape[0] // png.GRID + 1)
                c0, c1 = j * shape[1] // png.GRID, max((j + 1) * shape[1] // png.GRID, j * shape[1] // png.GRID + 1)
                grid[i][j] = x[r0:r1, c0:c1].astype(float).mean()
        wave = lambda k, n: math.cos(math.pi * k * (2 * n + 1) / (2 * png.GRID))
        low = [sum(grid[i][j] * wave(u, i) * wave(v, j) for i in range(png.GRID) for j in range(png.GRID)) for u in range(1, png.LOW + 1) for v in range(1, png.LOW + 1)]
        middle = float(np.median(np.round(low, 6)))
        bits = "".join("1" if round(v, 6) > middle else "0" for v in low)
        assert png.cosine_hash(x) == f"{int(bits, 2):016x}"


def test_filter_is_chosen_over_all_rows():
    """Rows of noise after many equal ones decide the filter."""
    image = np.vstack([np.tile(np.arange(64, dtype=np.uint8), (300, 1)), np.random.default_rng(2).integers(0, 60, (900, 64)).astype(np.uint8)])
    stored = png.write_png(image)
    assert (png.read_png(stored) == image).all()
    tried = [image, np.diff(image, axis=1, prepend=np.uint8(0)), np.diff(image, axis=0, prepend=np.zeros((1, 64), np.uint8))]
    costs = [sum(min(v, 256 - v) for v in x.ravel().tolist()) for x in tried]
    body = b"".join(b for k, b in png.chunks_of(stored) if k == b"IDAT")
    assert zlib.decompress(body)[0] == costs.index(min(costs))


def test_licences(spark, docs, nothing):
    mit = KNOWN[1][1]
    made = [(1, mit), (2, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;")), (3, mit + " more"), (4, None), (5, "© 2001 x\n" + mit.replace("sublicense", "sub-license").replace(" ", "\n", 40)), (6, "released under the MIT licence")]
    found = {r["doc_id"]: r["license_id"] for r in scan(spark.createDataFrame(made, "doc_id int, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "MIT", 6: "MIT"}
    # every known text is found again in other words' clothes, and so is a text that a caller brings
    worn = [(k, "Copyright 2019 The Authors\n" + t.upper().replace(" LICENSE", " LICENCE").replace("SUBLICENSE", "SUBLICENCE").replace(". ", ".\n\n  * ")) for k, (_, t) in enumerate(KNOWN)]
    found = {r["doc_id"]: r["license_id"] for r in scan(spark.createDataFrame(worn, "doc_id int, text string")).collect()}
    assert found == {k: i for k, (i, _) in enumerate(KNOWN)}
    own = scan(spark.createDataFrame([(1, "My own TERMS."), (2, mit)], "doc_id int, text string"), known=[("own", "my own terms"), ("zero", "")])
    assert {r["doc_id"]: r["license_id"] for r in own.collect()} == {1: "own", 2: None}
    assert scan(docs).count() == docs.count() and scan(nothing).count() == 0
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_brute_force(docs, nothing, rows, order):
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t, *_ in rows]
    seen = Counter()
    for _, t, held in texts:
        for k in range(len(t) if not held else 0):
            for length in range(1, order + 1):
                if length <= k + 2:
                    seen[tuple(([0] + t)[max(0, k + 2 - length) : k + 2])] += 1
    one = {g[0]: c for g, c in seen.items() if len(g) == 1}
    n, v, m = sum(one.values()), len(one), STRENGTH
    e, starts = sum(c == 1 for c in one.values()) / (n + 2), sum(not h for *_, h in texts)

    def p(context, w):
        if not context:
            return (1 - e) * one[w] / n if w in one else e
        total = starts if context == (0,) else seen[context]
        return (seen[*context, w] + m * p(context[1:], w)) / (total + m)

    want = []
    for i, t, held in texts:
        score = sum(math.log10(p(tuple(([0] + t)[max(0, k + 2 - order) : k + 1]), w)) for k, w in enumerate(t))
        want.append((i, held, len(t), sum(w in one for w in t), n, round(sum(math.log10((one.get(w, 0) + 1) / (n + v + 1)) for w in t), 6), round(score, 6)))
    for size in (1 << 30, 3000) if order < 4 else (3000,):  # in one chunk and in many
        got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in score_texts(docs, order=order, chunk_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    if order == 2:
        assert score_texts(nothing).count() == 0


def test_language_model_ships_texts_and_ngrams_once(spark, tmp_path):
    """All that is shuffled or stored, whether or not the cleaner gets to it, stays near the size of the texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    made = [(i, " ".join(words[int(3000 * rng.random() ** 2)] for _ in range(300))) for i in range(1200)]
    spark.createDataFrame(made, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    context, folder = spark.sparkContext, Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))

    def stages():
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    last, old = max(stages(), default=-1), set(folder.glob("*/*.parquet"))
    assert len(score_texts(spark.read.parquet(f"{tmp_path}/docs"), chunk_bytes=1 << 19).collect()) == len(made)
    shuffled = sum(n for k, n in stages().items() if k > last)
    stored = sum(f.stat().st_size for f in set(folder.glob("*/*.parquet")) - old)
    assert 0 < shuffled + stored < 2.5 * sum(len(t) for _, t in made)


def test_language_model_chunks():
    """Chunks hold every row once, in order, and are cut by size inside and across batches."""
    from tidemark.llm.backoff_lm import chunks_of, pack_table, unpack_table

    texts = ["", "a" * 50, None, "b" * 400, "c", "d" * 90, *["e" * 10] * 40, "", "f" * 99]
    table = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    for rows, size in itertools.product((1, 3, 100), (1, 150, 1 << 20)):
        chunks = [unpack_table(pack_table(c)) for c in chunks_of(iter(table.to_batches(max_chunksize=rows)), size)]
        assert pa.concat_tables(chunks).to_pydict() == table.to_pydict()
        assert all(len(c) == 1 or sum(len(t or "") + 16 for t in c.column("text").to_pylist()) <= size for c in chunks)
        assert size < 1 << 20 or len(chunks) == 1
    assert list(chunks_of(iter([]), 10)) == []


def test_packing():
    for x in ([], [0], [5, 2**63, 1], list(range(1000))):
        a = np.array(x, np.uint64)
        assert (unpack(pack(a)) == a).all()


def test_toxicity_restores_hidden_words(docs, nothing, labels, rows):
    model = fit_toxicity(docs, labels)
    assert {"stupid", "clown"} & set(model.words)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model, carry=["doc_id", "score"]).collect()}
    assert len(got) == len({i for i, *_ in rows}) and got[4]["carried"]["score"] == 1.0
    for i, t, *_ in rows:
        assert got[i]["predicted"] == int(bool(re.search("stupid|stup1d|STUUUPID", t or ""))), (i, t)
        assert 0 <= got[i]["score"] <= 1
    assert got[111]["restored_hits"] >= 1 and got[112]["restored_hits"] >= 1 and got[4]["restored_hits"] == 0
    assert score_toxicity(nothing, fit_toxicity(nothing, labels)).count() == 0


def test_toxicity_restores_partly_spaced_and_doubled_words(spark, docs, labels):
    model = fit_toxicity(docs, labels)
    hidden = ["stu-pid", "stu.pid", "s.tupid", "st.u.pid", "stu pid", "st up id", "stuupid", "stuppid", "stup\\id", "ss.ttupid", "stup!d", "s+upid", "st*pid", "5tu pid", "stu p1d"]
    clean = ["stoop", "the plain stipud", "stu", "pid", "st. upper", "stu\npid", "under-stand", "letter", "a mistu pid"]
    made = spark.createDataFrame([(k, f"he was {w} here") for k, w in enumerate(hidden + clean)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(made, model).collect()}
    assert [w for k, w in enumerate(hidden + clean) if got[k] != (k < len(hidden))] == []


def test_decoding_equals_all_paths():
    """The best path of a lattice, found by writing out every path."""
    from tidemark.llm.toxicity import SYMBOLS, arcs, character_model, decode, positions

    rng = random.Random(7)
    counts = np.zeros(SYMBOLS**4)
    for _ in range(400):
        counts[rng.randrange(SYMBOLS**4)] += rng.randint(1, 9)
    model = character_model(counts, ["stupid", "clown"])

    def cost_of(path):
        """Score of outputs and costs along a path, ended by a space."""
        score, history = 0.0, 0
        for out, cost in [*path, (" ", 0.0)]:
            score -= cost
            for x in out:
                symbol = 27 if x >= "\x80" else ord(x) - 96 if "a" <= x <= "z" else 0
                if symbol or history % SYMBOLS:
                    score += model[history * SYMBOLS + symbol]
                    history = (history * SYMBOLS + symbol) % SYMBOLS**3
        return score

    for _ in range(60):
        segment = "".join(rng.choice("stupidclown5@!|*- .1é") for _ in range(rng.randint(1, 6)))
        paths = [()]
        for c, run in positions(segment):
            paths = [(*p, a) for p in paths for a in arcs(c, run)]
        scores = {}
        for p in paths:
            text = " ".join("".join(out for out, _ in p).split())
            scores[text] = max(scores.get(text, -math.inf), cost_of(p))
        assert scores[decode(segment, model)] >= max(scores.values()) - 1e-9, segment


def test_statistics_and_traversal_equal_plain_python(rows):
    from tidemark.llm.quality_trees import FEATURES, statistics

    texts = [(t or "").encode() for _, t, *_ in rows[:70]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = statistics(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, x in zip(texts, got, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t)
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        n, lines = max(1, len(words)), [v for v in re.findall(rb"[^\n]+", t)]
        sizes = [len(w) for w in words]
        mean = sum(sizes) / n
        want = {
            "log_bytes": math.log1p(len(t)), "lower": sum(97 <= c < 123 for c in t) / max(1, len(t)), "upper": sum(65 <= c < 91 for c in t) / max(1, len(t)), "digit": sum(48 <= c < 58 for c in t) / max(1, len(t)),
            "space": sum(c in (32, 9, 13) for c in t) / max(1, len(t)), "newline": t.count(b"\n") / max(1, len(t)), "beyond_ascii": sum(c >= 128 for c in t) / max(1, len(t)), "log_words": math.log1p(len(words)), "word_mean": mean,
            "word_sd": math.sqrt(max(0, sum(k * k for k in sizes) / n - mean**2)), "distinct_words": (len(set(low)) + 1) / (len(words) + 1), "top_word": max(Counter(low).values(), default=0) / n,
            "same_as_last": sum(a == b for a, b in zip(low, low[1:])) / n, "distinct_pairs": (len(set(zip(low, low[1:]))) + 1) / n, "log_lines": math.log1p(len(lines)),
            "distinct_lines": (len({v.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for v in lines}) + 1) / (len(lines) + 1), "line_bytes": len(t) / max(1, len(lines)),
            "one_byte_words": sum(k == 1 for k in sizes) / n, "long_words": sum(k > 20 for k in sizes) / n,
        }
        for name, value in want.items():
            assert math.isclose(x[FEATURES.index(name)], value, abs_tol=1e-9), (name, t[:40])
    y = np.arange(len(got)) % 2
    trees = fit_trees(got, y.astype(float), rounds=7, least=1.0)
    for row, raw in zip(got, trees.raw(got), strict=True):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        assert math.isclose(total, raw, abs_tol=1e-9)


def test_quality_trees(docs, nothing, labels):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    trees = fit_trees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    scored = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert score_quality(nothing, fit_quality(nothing, labels)).count() == 0
