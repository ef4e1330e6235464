"""Operators that compare texts against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import phrase_index, simhash, suffix_dedup
from tidemark.llm.components import connected_components
from tidemark.llm.mixing import mix_sources
from tidemark.llm.phrase_index import build_index, decontaminate, search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (3, None)]
    real = [(a, b) for a, b in links if b is not None and a != b]
    for most in (0, 1000):  # in rounds, and by one task
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), most).collect()}
        assert got == groups({x for p in real for x in p}, real)
        assert connected_components(spark.createDataFrame([], "a long, b long"), most).count() == 0


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("dense", [512, 0])
def test_simhash_components(docs, nothing, rows, dense):
    prints = {i: fingerprint(t) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(prints, links)
    got = simhash.near_duplicates(docs, dense=dense).select("doc_id", simhash.hex16("f0").alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["f"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_duplicates(nothing).count() == 0


def test_dense_links_join_all_that_are_close(spark):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    values = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(k, s) for k, s in enumerate(signed)], "node long, f0 long")
    want = groups(range(len(values)), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4])
    assert [simhash.layout(n, d) for n, d in ((1000, 4), (1 << 30, 4), (9, 0))] == [(3, 1), (2, 2), (2, 1)]
    for dense, (segments, radius) in ((512, (3, 1)), (4, (3, 1)), (512, (2, 2)), (4, (2, 2))):
        links = [tuple(r) for r in simhash.similar(nodes, 1, 4, segments, radius, dense=dense).collect()]
        assert groups(range(len(values)), links) == want


def test_labelled_sample_is_bounded_by_ids(spark):
    from tidemark.llm.quality_trees import labelled_sample

    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(100)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5)] * 2, "doc_id long, quality int, toxic int")
    assert labelled_sample(docs, labels, "quality", 20).count() <= 5


def test_wide_lanes_search_dense_buckets(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(4)]
    made = [[b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base] for _ in range(40)]
    nodes = spark.createDataFrame([(k, *[v - (1 << 64) if v >> 63 else v for v in m]) for k, m in enumerate(made)], "node long, f0 long, f1 long, f2 long, f3 long")
    for dense in (512, 4):
        links = [tuple(r) for r in simhash.similar(nodes, 4, 44, 3, dense=dense).collect()]
        assert set(groups(range(40), links).values()) == {0}


def test_every_pair_of_a_large_dense_bucket_is_compared(spark, monkeypatch):
    """Pairs that share no segment but the dense one, in a bucket of many searches."""
    monkeypatch.setattr(simhash, "SEARCH_ROWS", 20)
    rng = random.Random(9)
    parts = simhash.cut(4, 3)
    _, low, width = parts[0]
    made = []
    for _ in range(60):
        one = [rng.getrandbits(64) for _ in range(4)]
        one[0] &= ~((1 << width) - 1 << low)
        other = list(one)
        for lane, at, size in parts[1:]:
            for b in rng.sample(range(size), 3):
                other[lane] ^= 1 << at + b
        made += [one, other]
    nodes = spark.createDataFrame([(k, *[v - (1 << 64) if v >> 63 else v for v in m]) for k, m in enumerate(made)], "node long, f0 long, f1 long, f2 long, f3 long")
    assert {tuple(r) for r in simhash.similar(nodes, 4, 44, 3).collect()} == {(k, k + 1) for k in range(0, 120, 2)}


def test_near_copies_equal_brute_force(spark, monkeypatch):
    """Texts at 0.7 to 0.95, some in large groups, some alone, and some that share a repeated run only."""
    from tidemark.llm import near_copies

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, texts = " ".join(word() for _ in range(12)), [None, "", "  ", "one two", "one  TWO", "a b c d e f"]
    for k in range(40):
        base = [word() for _ in range(rng.randint(60, 140))]
        for _ in range(30 if k == 0 else 3):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + (" " + line if k % 3 == 0 else ""))
    texts += ["sh " * 300 + " ".join(word() for _ in range(30)) for _ in range(4)]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = groups(range(len(texts)), linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lambda: {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, 5, 4, 3, 44).collect()}
    assert got() == want
    monkeypatch.setattr(near_copies, "GROUP_SHINGLES", 600)
    assert got() == want


def brute_windows(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t, *_ in rows:
        w, hit, found = WORDS.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, nothing, rows, monkeypatch):
    long = rows[8][1].split()
    items = [(1, " ".join(long[:25]).upper()), (2, "one two"), (3, None), (4, ""), (5, " ".join(rows[60][1].split()[10:21])), (6, "never seen words " * 5), (10, " ".join(long[3:14]).replace(" ", "--"))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(rows, items)

    def got(df):
        return sorted(((r["doc_id"], r["n_words"], sum(s["length"] for s in r["spans"]), sorted(set(r["items"]))) for r in df.collect()), key=repr)

    assert got(decontaminate(docs, tests)) == want
    monkeypatch.setattr("tidemark.llm.phrase_index.ITEMS_AT_ONCE", 2)
    assert got(decontaminate(docs, tests, carry=["doc_id", "score"])) == want
    assert decontaminate(nothing, tests).count() == 0
    assert all(not r["spans"] for r in decontaminate(docs, tests.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 90 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    found = search(build_index(docs), phrase_index.test_set([7], ["alpha beta gamma"]), near=10, near_terms=3).collect()
    assert {r["doc_id"]: r["near_items"] for r in found} == {1: ["7"], 2: [], 3: ["7"]}


def test_proximity_does_not_depend_on_the_block(spark):
    """All words of an item count, whatever other documents stand in the block."""
    rng = random.Random(3)
    names = [f"w{k}" for k in range(14)]
    items = [(k, " ".join(rng.choices(names, k=rng.choice([3, 6, 9, 30])))) for k in range(25)] + [(90, None), (91, "nowhere at all")]
    made = [(k, " ".join(rng.choices(names[rng.randint(0, 4) :], k=rng.randint(0, 60)))) for k in range(60)]
    made += [(100, "w0 " * 700 + " ".join(names) + " x" * 700), (101, None)]

    def near(words, item):
        want, size = set(item), max(11, len(item))
        return bool(want) and any(want <= set(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))

    want = {i: sorted(str(k) for k, item in items if near((t or "").split(), (item or "").split())) for i, t in made}
    assert any(want.values())
    docs = spark.createDataFrame(made, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for dealt in (docs.coalesce(1), docs.repartition(20)):
        assert {r["doc_id"]: r["near_items"] for r in decontaminate(dealt, tests, near=5).collect()} == want


def brute_repeats(rows, size):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "bucket"), [(400, 400_000), (60, 40)])
def test_repeats_equal_brute_force_also_over_bucket_borders(docs, nothing, rows, size, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket)
    got = suffix_dedup.remove_repeats(docs, min_bytes=size, chunk_bytes=1 << 14).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, size)
    if size == 400:
        assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_whole_characters_stay(docs):
    for r in suffix_dedup.remove_repeats(docs, min_bytes=33, characters=True, carry=["text"]).collect():
        bytes(r["kept"]).decode()


def test_multikey_order():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 4, 500) for _ in range(3))
    order = suffix_dedup.multikey_order([a, b, c])
    assert (order == np.lexsort((c, b, a))).all()


def test_mixing_fills_budgets_and_prefers_siblings(spark, docs, nothing):
    made = [(k, "w " * (1 + k % 7), "en" if k % 2 else "de", f"s{k % 5}", "a" if k < 300 else "b") for k in range(400)]
    table = spark.createDataFrame([*made, (900, None, None, None, None), (901, "  ", "en", "s1", "a")], "doc_id long, text string, lang string, source string, domain string")
    used = mix_sources(table, weights={"domain": {"a": 1, "b": 3}, "lang": {}, "source": {"s0": 10}}, share=0.5, max_epochs=2).toPandas()
    total = sum(1 + k % 7 for k in range(400))
    by = used.groupby("domain")["take_tokens"].sum()
    cap_b = 2 * sum(1 + k % 7 for k in range(300, 400))
    leaves = used.groupby(["domain", "lang", "source"]).ngroups
    assert abs(by.sum() - total // 2) <= leaves + 10
    assert abs(by["b"] - min(cap_b, total // 2 * 3 // 4)) <= leaves + 10
    assert ((used["take_tokens"] < used["n_tokens"]).groupby([used["domain"], used["lang"], used["source"]]).sum() <= 1).all()
    assert not used.duplicated(["doc_id", "epoch"]).any() and used["epoch"].max() <= 1
    again = mix_sources(table.repartition(7), weights={"domain": {"a": 1, "b": 3}, "lang": {}, "source": {"s0": 10}}, share=0.5, max_epochs=2).toPandas()
    key = ["doc_id", "epoch"]
    assert used.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert mix_sources(nothing).count() == 0
    assert mix_sources(docs, keep=["text", "score"]).columns[-2:] == ["text", "score"]


def test_pipeline_stages(spark, docs, labels, rows, tmp_path):
    import corpus_pipeline as p

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leak = rows[2][1]
    spark.createDataFrame([(1, " ".join(leak.split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    seen = {}
    for name, stage in p.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in at.collect()}
        if name != "source_mixing":
            assert at.columns == p.COLUMNS
    assert not any(re.search("stupid|STUUUPID|stup1d", t or "") for t in seen["toxicity"].values()) and 1 in seen["toxicity"] and 103 in seen["toxicity"]
    assert {100, 101, 102, 110} & set(seen["simhash_near_dedup"]) == {100}
    assert 2 in seen["suffix_array_dedup"] and 2 not in seen["benchmark_decontamination"] and 1 in seen["benchmark_decontamination"]
    assert set(seen["source_mixing"]) <= set(seen["benchmark_decontamination"])


def test_pipeline_on_empty_tables(spark, nothing, labels, tmp_path):
    import corpus_pipeline as p

    nothing.select(*p.COLUMNS).withColumn("doc_id", nothing["doc_id"].cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).withColumn("doc_id", labels["doc_id"].cast("string")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == p.COLUMNS and at.schema["doc_id"].dataType.simpleString() == "string", name
    made = p.run(spark, str(tmp_path))
    assert made.count() == 0 and made.columns[0] == "doc_id"


def test_texts_under_one_id_or_none_are_documents_of_their_own(spark):
    import corpus_pipeline as p

    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    made = [text() for _ in range(7)]
    near = made[0].split()
    near[3] = "changed"
    rows = [(None, made[1]), (None, made[2]), (None, made[3]), (5, made[4]), (5, made[5]), (6, made[0]), (9, " ".join(near)), (None, made[0]), (5, made[4]), (None, made[1]), (7, made[6]), (7, made[6])]
    docs = spark.createDataFrame([(i, t, None, "s", 1 + k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    want = [(None, made[1]), (None, made[2]), (None, made[3]), (5, made[4]), (5, made[5]), (6, made[0]), (7, made[6])]
    assert got == sorted(want, key=repr)


def test_shared_passages_shorter_than_the_limit_are_told(spark):
    rng = random.Random(22)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = text(56)  # 391 bytes, as long as it can be and not be removed
    docs = spark.createDataFrame([(k, text(80) + (" " + passage + " " if k < 8 else " ") + text(80)) for k in range(16)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert (r["n_removed"], r["n_shared"] > 0) == (0, r["doc_id"] < 8)


def test_long_test_items_are_searched_in_rounds(spark, docs, rows, monkeypatch):
    items = [(k, " ".join(rows[k][1].split()[:12])) for k in range(6)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(rows, items)
    monkeypatch.setattr("tidemark.llm.phrase_index.TEXT_AT_ONCE", 150)
    got = sorted(((r["doc_id"], r["n_words"], sum(s["length"] for s in r["spans"]), sorted(set(r["items"]))) for r in decontaminate(docs, tests).collect()), key=repr)
    assert got == want
    with pytest.raises(ValueError, match="near"):
        decontaminate(docs, tests, near=600)
