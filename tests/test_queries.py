"""The registered queries prepare the base tables that they read, and no others."""

from tidemark import queries


def test_a_query_prepares_only_the_tables_that_it_names(spark, tmp_path):
    spark.createDataFrame([(k, k % 4, f"n{k}") for k in range(30)], "n_nationkey long, n_regionkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, f"r{k}") for k in range(30)], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = queries.maintained(spark, str(tmp_path), queries.VIEWS["join_cross"])  # fails if it looks for orders
    left = [k for k in range(30) if k % 10 == 0 or k % 7 != 1]
    assert sorted(map(tuple, got.collect())) == sorted((f"n{a}", f"r{b}") for a in left for b in left)


def test_a_cycle_for_each_version_of_each_table(spark, tmp_path):
    spark.createDataFrame([(k, k % 3, "O", k / 4, "p") for k in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 0, "S") for k in (0, 2)], "c_custkey long, c_nationkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.multi_round(spark, str(tmp_path)).collect()
    held = [k for k in range(40) if (k % 10 == 0 or k % 7 != 1) and k % 3 in (0, 2)]
    assert [tuple(x) for x in got] == [("S", sum(k / 4 for k in held), len(held))]
