from pyspark.sql import functions as F

from tidemark.llm.near_copies import SAMPLE_STEP, common_shingles, shingle_sets


def test_shingles_are_common_by_a_fixed_share_of_the_texts(spark):
    """A passage of five texts in the share is common among few texts and among many: a sample of fixed size (one in ten here) held none of them."""
    import pyarrow as pa

    passage = "one two three four five"
    h = F.xxhash64("node")
    for n in (2_000, 200_000):
        nodes = spark.range(n).select(F.col("id").alias("node"))
        held = [r.node for r in nodes.where((F.pmod(h, F.lit(SAMPLE_STEP)) == 0) & (F.pmod(h, F.lit(10)) != 0)).orderBy("node").limit(5).collect()]
        own = F.concat_ws(" ", *[F.concat(F.lit(c), F.col("node")) for c in "abcde"])
        prints = nodes.select("node", F.when(F.col("node").isin(held), F.lit(passage)).otherwise(own).cast("binary").alias("text"))
        assert common_shingles(prints, 5).tolist() == shingle_sets(pa.array([passage.encode()]), 5)[0].tolist()


def test_no_text_has_no_common_shingle(spark):
    prints = spark.createDataFrame([], "node long, text binary")
    assert len(common_shingles(prints, 5)) == 0
