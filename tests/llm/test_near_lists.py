"""The prefix filter of near copies keeps one shingle of those that the same texts share."""

import random

import tidemark.llm.near_copies as near


def test_a_shared_passage_is_one_row_a_text_and_no_pair(spark, monkeypatch):
    rng = random.Random(2)
    words = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    passage, twin = words(400), words(300)
    texts = [f"{words(400)} {passage} {words(400)}" for _ in range(6)] + [f"{twin} one more", f"{twin} another"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, real = {}, near.saved
    monkeypatch.setattr(near, "saved", lambda df, name: made.setdefault(name, real(df, name)))
    # no groups before the prefix filter, so that it has to find the twins
    monkeypatch.setattr(near, "linked_in_groups", lambda prints, *_: prints.selectExpr("node AS a", "node AS b").limit(0))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(docs, words=5, lanes=4, segments=3, max_distance=44).collect()}
    assert got == {**{k: k for k in range(7)}, 7: 6}
    lists = made["first_shingles"].groupBy("token").agg({"node": "collect_set"}).collect()
    seen = [tuple(sorted(x[1])) for x in lists]
    assert len(seen) == len(set(seen))
    assert made["pairs"].count() == 1
