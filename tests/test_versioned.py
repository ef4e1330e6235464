import pytest
from pyspark.sql import functions as F

from tidemark.sources.versioned import Catalog, CommitConflict, VersionError


@pytest.fixture
def table(spark, tmp_path):
    catalog = Catalog(spark, "dl", str(tmp_path))
    return catalog.create("t", spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, s string"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delete_takes_one_copy_and_never_more_than_there_are(spark, table):
    table.delete(spark.createDataFrame([(1, "a"), (2, None), (2, None), (9, "z")], "k int, s string"))
    assert rows(table.as_of()) == [(1, "a")]


def test_feed_range_is_inclusive_inverted_is_empty_future_is_an_error(spark, table):
    v = table.insert(spark.createDataFrame([(3, "c"), (3, "c")], "k int, s string"))
    assert rows(table.changes(v, v)) == [(v, None, "insert", 3, "c")] * 2
    assert rows(table.changes(v + 1, v)) == []
    with pytest.raises(VersionError):
        table.changes(v, v + 1)


def test_update_pairs_both_images(spark, table):
    v = table.update("k = 1", {"s": F.lit("b")})
    feed = table.changes(v, v).collect()
    assert sorted(r.change_type for r in feed) == ["update_postimage"] * 2 + ["update_preimage"] * 2
    assert len({r.change_id for r in feed}) == 2
    assert rows(table.as_of()) == [(1, "b"), (1, "b"), (2, None)]


def test_time_travel_copies_and_expiry(spark, table):
    first = table.catalog.latest_version()
    for k in range(12):
        table.insert(spark.createDataFrame([(k, "x")], "k int, s string"))
    assert len(table._meta.bases) == 1 and table.copy_due()
    assert table.catalog.compact() == ["main.t"] and not table.copy_due() and table.catalog.compact() == []
    assert len(table._meta.bases) == 2
    assert rows(table.as_of(first)) == [(1, "a"), (1, "a"), (2, None)]
    assert table.as_of(first + 12).count() == 15
    table.expire(table._meta.bases[-1])
    assert table.as_of().count() == 15
    with pytest.raises(VersionError):
        table.as_of(first)


def test_log_is_read_by_another_process_and_conflicts_are_seen(spark, table):
    other = Catalog(spark, "dl", table.catalog.root.rsplit("/", 1)[0])
    assert other.tables() == ["main.t"]
    other.table("t").insert(spark.createDataFrame([(5, "e")], "k int, s string"))
    assert table.as_of().where("k = 5").count() == 1
    table.copy()
    other.refresh()
    assert other.table("t")._meta.bases == table._meta.bases


def test_a_writer_that_loses_leaves_no_files(spark, table, monkeypatch):
    other = Catalog(spark, "dl", table.catalog.root.rsplit("/", 1)[0])
    other.refresh()
    table.insert(spark.createDataFrame([(7, "g")], "k int, s string"))
    monkeypatch.setattr(other, "refresh", lambda: None)
    with pytest.raises(CommitConflict):
        other.table("t").insert(spark.createDataFrame([(8, "h")], "k int, s string"))
    assert len(other.files.names(f"{table.catalog.root}/main/t/changes")) == 1
    assert sorted(r.k for r in table.as_of().collect()) == [1, 1, 2, 7]


def test_rows_held_very_often(spark, table):
    v = table.apply(spark.createDataFrame([(6, "f", 9001)], "k int, s string, _w long"))
    assert table.as_of().where("k = 6").count() == table.changes(v, v).count() == 9001


def test_rows_of_the_table_itself_can_be_deleted(spark, table):
    table.delete(table.as_of().where("k = 1").limit(1))
    assert rows(table.as_of()) == [(1, "a"), (2, None)]


def test_changes_without_rows_make_no_version(spark, table):
    before = table.catalog.latest_version()
    assert table.delete_where("k = 77") == before == table.catalog.latest_version()
