import pytest
from pyspark.sql import functions as F

from ledgerwatch.sources.keyed import KeyedTable, newest

SCHEMA = "id string, v long"


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(table):
    return {r.id: r.v for r in table.read().collect()}


def test_the_last_write_of_a_key_stays(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("id",), buckets=4)
    assert table.read() is None and table.commit() is None
    want = {}
    for i in range(12):
        new = {f"k{j}": 100 * i + j for j in range(i % 3, 40, 3)} | {None: i}
        table.upsert(rows(spark, new.items()))
        want |= new
        assert content(table) == want and table.read().count() == len(want)
    table.upsert(rows(spark, []))
    assert content(table) == want


def test_a_read_costs_the_same_after_many_writes(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("id",), buckets=2, most=3)
    folders, files = [], []
    for i in range(14):
        table.upsert(rows(spark, [(f"k{j}", i) for j in range(50)]))
        folders.append(sum(map(len, table.commit()["of"].values())))
        files.append(len(table.read().inputFiles()))
    assert max(folders) <= 2 * 3 and max(files[7:]) <= max(files[:7])
    table.vacuum(keep=1)
    assert content(table) == {f"k{j}": 13 for j in range(50)}
    kept = spark.read.parquet(f"{folder}/t/data").select("_version").distinct().count()
    assert kept <= 3


def test_a_write_touches_the_buckets_of_its_keys_only(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("id",), buckets=16)
    table.upsert(rows(spark, [(f"k{j}", 0) for j in range(200)]))
    before = table.commit()["of"]
    table.upsert(rows(spark, [("k7", 1)]))
    after = table.commit()["of"]
    assert sum(before[b] != after[b] for b in before) == 1 and content(table)["k7"] == 1
    # Reading the table folds that one bucket; the others are scanned as they are.
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_a_crash_before_the_switch_shows_nothing(spark, folder, monkeypatch):
    table = KeyedTable(spark, f"{folder}/t", ("id",), buckets=2)
    table.upsert(rows(spark, [("a", 1), ("b", 1)]), batch=0)

    def crash(self, commit):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(OSError):
            table.upsert(rows(spark, [("a", 2), ("c", 2)]), batch=1)
    assert content(table) == {"a": 1, "b": 1}
    table.upsert(rows(spark, [("b", 3)]), batch=1)  # the repeated batch replaces what was left behind
    assert content(table) == {"a": 1, "b": 3}
    table.upsert(rows(spark, [("a", 9)]), batch=1)  # already there
    assert content(table) == {"a": 1, "b": 3}


def test_two_writers_cannot_both_win(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("id",))
    table.upsert(rows(spark, [("a", 1)]))
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(table.commit())


def test_rows_that_add_up(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("id",), buckets=2, most=2, fold=lambda r: r.groupBy("id").agg(F.sum("v").alias("v")))
    for i in range(7):
        table.upsert(rows(spark, [("a", i), (f"b{i}", 1)]), batch=i)
    assert content(table) == {"a": 21} | {f"b{i}": 1 for i in range(7)}


def test_newest_keeps_whole_rows(spark):
    table = spark.createDataFrame([("a", None, 2), ("a", 5, 1)], "id string, v long, _version long")
    assert newest(["id"])(table).collect() == [("a", None)]
