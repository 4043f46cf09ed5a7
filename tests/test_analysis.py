import math
import os
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from builders import frame, random_rows, txn
from pyspark.sql import functions as F

from ledgerwatch.operators import accounts as A
from ledgerwatch.operators import evidence as E
from ledgerwatch.operators import graph as G
from ledgerwatch.operators import isolation_forest as IF
from ledgerwatch.operators import metrics as M
from ledgerwatch.operators import models as MD
from ledgerwatch.operators import snapshots as SN
from ledgerwatch.operators import neighbours as NN
from ledgerwatch.operators.neighbours import nearest
from ledgerwatch.operators.scaling import Scaler
from ledgerwatch.plans import catalog as catalog_module
from ledgerwatch.session import scratch_path


def test_superseded_tables_of_the_neighbour_search_go(spark, monkeypatch):
    kept, stored = [], NN.cut_lineage

    def noted(df, **more):
        out = stored(df, **more)
        kept.append(out)
        return out

    monkeypatch.setattr(NN, "cut_lineage", noted)
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(f"P{i}", x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 3)))], "id string, x array<double>")
    monkeypatch.setattr(NN, "FAN", 4)
    found = nearest(points, 3, leaf=40).collect()
    assert len(found) == 4500
    there = [os.path.isdir(df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]) if df.inputFiles() else True for df in kept if set(df.columns) == {"id", "x", "cell"}]
    assert len(there) > 2 and there == [False] * (len(there) - 1) + [True]


def test_the_forest_gets_no_more_partitions_than_cores(spark, monkeypatch):
    """Every partition sends statistics of all open nodes, on every level."""
    seen = []
    monkeypatch.setattr(MD.RandomForestClassifier, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    for key, value in (("minPartitionNum", "40"), ("openCostInBytes", "64")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        rows = spark.range(4000, numPartitions=40).select(F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
        MD.fit_random_forest(rows, trees=2, depth=2)
    finally:
        for key in ("minPartitionNum", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert seen == [(spark.sparkContext.defaultParallelism, 4000)]


def account_rows(n, seed):
    rng = random.Random(seed)
    return [(f"A{i}", f"C{rng.randint(1, n // 3)}" if i else "", rng.choice([1.0, 2.0, 3.0]), rng.choice([0.2, 0.5, 0.51, 0.9]), rng.uniform(0, 9)) for i in range(n)]


def linked(a, b):
    same = a[1] == b[1] and a[1] != ""
    return a[0] == b[0] or same or (a[2] == b[2] and a[3] > 0.5 and b[3] > 0.5)


def test_group_arithmetic_equals_edge_list(spark):
    rows = account_rows(60, 5)
    accounts = spark.createDataFrame(rows, "account_id string, customer_id string, tier_numeric double, max_cross_ratio_6h double, v double")
    nodes = G.members(accounts)
    degree = {r["account_id"]: r["edges_out"] for r in G.degrees(nodes).collect()}
    mean = {r["account_id"]: r["mean_v"] for r in G.neighbor_mean(nodes, ["v"]).collect()}
    for a in rows:
        near = [b for b in rows if linked(a, b)]
        assert degree[a[0]] == len(near)
        assert math.isclose(mean[a[0]], sum(b[4] for b in near) / len(near))


def test_order_statistics(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1e6), 5.0, 5.0, float(rng.randint(-3, 3))]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    ranks = [1, 2, 700, 1500, 2999, 3000]
    assert M.order_statistics(df, "v", ranks, k=200, small=3) == [ordered[r - 1] for r in ranks]
    assert math.isclose(M.percentile(df, "v", 0.975), np.percentile(values, 97.5), rel_tol=1e-12)


def test_splits_keep_order(spark):
    df = frame(spark, random_rows(41, ["C1", "C2"], seed=9))
    split = {r["arrival_seq"]: r["split"] for r in M.temporal_split(df).collect()}
    assert [split[i] for i in range(41)] == ["train"] * 30 + ["test"] * 11


def test_average_precision_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    expected = (1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    for rows_per_segment in (1, 1000):
        got = M.average_precision(df, "y", "s", rows_per_segment=rows_per_segment).first()[0]
        assert math.isclose(got, expected)


def test_confusion_divides_by_zero_as_zero(spark):
    row = M.confusion(spark.createDataFrame([(0, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 1)


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = Scaler.from_json(Scaler.fit(df, ["a", "b"]).to_json())
    assert [tuple(r) for r in df.select(*scaler.expressions()).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("sizes", [dict(), dict(leaf=20, rows_per_block=15)], ids=["one cell", "many"])
def test_nearest_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    data = np.vstack([rng.normal(c, 1, (50, 4)) for c in (0, 5, 9)] + [np.full((60, 4), 2.5)])  # a third are copies
    points = spark.createDataFrame([(f"p{i:03d}", row.tolist()) for i, row in enumerate(data)], "id string, x array<double>")
    got = {(r["id"], r["place"]): r["distance"] for r in nearest(points, 5, **sizes).collect()}
    far = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    best = np.sort(far, axis=1)[:, :5]
    assert len(got) == len(data) * 5
    assert all(math.isclose(got[(f"p{i:03d}", j + 1)], best[i, j], abs_tol=1e-9) for i in range(len(data)) for j in range(5))


def training_set(spark, n=400, positives=40):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        y = int(i % (n // positives) == 0)
        rows.append((f"t{i:04d}", (rng.normal(4 * y, 1, 5)).tolist(), y, "train" if i < n * 3 // 4 else "test"))
    return MD.TrainingSet(spark.createDataFrame(rows, "id string, x array<double>, label int, split string"), None)


def test_oversampling_balances_exactly(spark):
    data = training_set(spark)
    counts = {r["label"]: r["n"] for r in MD.oversample(data).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == counts[1] == data.train.where("label = 0").count()
    assert MD.oversample(data).select("id").distinct().count() == 2 * counts[0]


def test_isolation_forest_ranks_outliers_first(spark):
    data = training_set(spark)
    forest = MD.fit_isolation_forest(data, trees=50)
    scored = MD.anomaly_predictions(data, forest).collect()
    assert all(0 < r["raw_score"] <= 1 and 0 <= r["iso_score"] <= 1 for r in scored)
    outliers = statistics.mean(r["raw_score"] for r in scored if r["label"] == 1)
    assert outliers > statistics.mean(r["raw_score"] for r in scored if r["label"] == 0)
    again = MD.anomaly_predictions(data, MD.fit_isolation_forest(data, trees=50)).collect()
    assert {r["id"]: r["raw_score"] for r in again} == {r["id"]: r["raw_score"] for r in scored}
    assert (IF.expected_depth(1), IF.expected_depth(2)) == (0, 1)


def test_random_forest_beats_base_rate_and_reloads(spark, folder):
    data = training_set(spark)
    model = MD.fit_random_forest(MD.oversample(data), trees=10, depth=5)
    scored = MD.forest_predictions(model, data.test)
    assert M.average_precision(scored, "label", "rf_score").first()[0] > 0.8
    nodes = IF.fit(data.train, trees=3)
    MD.save(model, nodes, Scaler(["a"], [0.0], [1.0]), spark, folder)
    loaded, forest, scaler = MD.load(spark, folder)
    assert loaded.getNumTrees == 10 and forest.feature.shape[0] == 3 and scaler.columns == ["a"]


def test_snapshots_merge(spark):
    rows = random_rows(80, ["C1", "C2", "C3"], seed=4)
    scored = frame(spark, rows).withColumn("risk_score", (F.col("arrival_seq") * 37 % 100).cast("double")).withColumn("risk_tier", F.lit("x"))
    whole = SN.snapshot(SN.delta(scored)).orderBy("customer_id").collect()
    early, late = scored.where("arrival_seq < 31"), scored.where("arrival_seq >= 31")
    merged = SN.snapshot(SN.merge(SN.delta(early).unionByName(SN.delta(late)))).orderBy("customer_id").collect()
    assert merged == whole


def test_breakdown_keeps_empty_accounts(spark):
    txns = frame(spark, [txn(1, 0, 2_500_000), txn(2, 1, 5_000_000)])
    listed = spark.createDataFrame([("C1", "A1"), ("C1", "A2")], "customer_id string, account_id string")
    rows = E.account_breakdown(txns, listed)
    assert [(r["account_id"], r["transactions"], r["total"], r["threshold_multiple"]) for r in rows.orderBy("account_id").collect()] == [
        ("A1", 2, 7_500_000.0, 1.5), ("A2", 0, 0.0, 1.5),
    ]
    text = E.breakdown_text(rows).first()["breakdown"]
    assert "A2: 0 transactions | ₦0.00 total" in text and text.endswith("VS NFIU THRESHOLD: 1.50x the ₦5,000,000 limit")


def test_account_vector_has_33_values(spark):
    assert len(A.ACCOUNT_COLUMNS) == len(set(A.ACCOUNT_COLUMNS)) == 33


def test_feature_profile_does_not_depend_on_partitions(spark):
    import __spark_entry__ as entry_module
    from compare import connect, differences

    sf = "/root/testdata/sf0.01"
    rows = catalog_module.feature_table(spark, sf).select("account_id", *catalog_module.PROFILED)
    path = scratch_path(spark, "profiled")
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    found = [
        sorted(map(tuple, catalog_module.rounded(A.feature_profile(stored.repartition(n), catalog_module.PROFILED), 4).collect()))
        for n in (1, 16)
    ]
    assert found[0] == found[1]
    profile = catalog_module.rounded(A.feature_profile(stored.repartition(7), catalog_module.PROFILED), 4)
    assert differences(profile, connect(sf), entry_module.oracle_sql()["feature_profile"]) == []


def test_feature_profile_of_odd_values(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("b", float("inf")), ("c", 2.0), ("c", None), ("d", 1e300)]
    found = A.feature_profile(spark.createDataFrame(rows, "account_id string, x double"), ["x"]).first()
    assert (found.nan_values, found.inf_values, found.distinct_values) == (1, 1, 4)


def test_two_passes_for_any_number_of_ranks(spark, monkeypatch):
    passes, scan = [], M._scan
    monkeypatch.setattr(M, "_scan", lambda df: passes.append(1) or scan(df))
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25), [np.inf, -np.inf]])
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    ranks = [1, 2, 777, 30_000, 45_000, 45_001, 60_001, 60_002]
    ordered = np.sort(values)
    assert M.order_statistics(df, "v", ranks) == [ordered[r - 1] for r in ranks] and len(passes) == 2
    passes.clear()
    assert math.isclose(M.percentile(df, "v", 0.9), np.percentile(values, 90), rel_tol=1e-12) and len(passes) == 2
    passes.clear()
    split = M.temporal_split(df, 0.5, "v")
    assert len(passes) == 2 and split.where("split = 'train'").count() == int((values <= ordered[30_000]).sum())


def test_order_statistics_when_the_sketch_is_wrong(spark, monkeypatch):
    """Brackets in the wrong place cost passes, not results; so do many values within them."""
    values = [((i * 7919) % 5000) - 2500 for i in range(5000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    wanted = {1: -2500, 2500: -1, 5000: 2499}
    assert M.order_statistics(df, "v", list(wanted), k=200, small=0) == list(wanted.values())
    monkeypatch.setattr(M, "_brackets", lambda spark, ranks, kind, k: {r: (2000, 2010) for r in ranks})
    assert M.order_statistics(df, "v", list(wanted), small=20_000) == list(wanted.values())
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert math.isnan(M.order_statistics(nan, "v", [3])[0]) and M.order_statistics(nan, "v", [2]) == [2.0]
    with pytest.raises(ValueError):
        M.order_statistics(nan, "v", [4])
    assert M.order_statistics(nan.where("false"), "v", lambda n: []) == []


def test_visits_stay_bounded_as_clusters_grow_in_number(spark, monkeypatch):
    """35 dimensions, clusters of 100 points: a point visits as many cells among 2,000 points as among 16,000."""
    monkeypatch.setattr(NN, "FAN", 16)  # several levels of boxes
    rng = np.random.default_rng(4)
    per_point = []
    for n in (2_000, 16_000):
        centres = rng.uniform(-100, 100, (n // 100, 35))
        data = np.repeat(centres, 100, axis=0) + rng.normal(size=(n, 35))
        points = spark.createDataFrame(pa.table({"id": [f"p{i}" for i in range(n)], "x": data.tolist()}))
        cells = NN.partition(points, 128)
        sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 128
        reach = points.select("id", F.lit(12.0).alias("reach"))  # about the fifth neighbour's distance within a cluster
        per_point.append(NN.visits(cells, reach, 35).count() / n)
    assert per_point[1] < 1.5 * max(per_point[0], 0.5) and max(per_point) < 4
