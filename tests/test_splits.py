import hashlib

import pytest
from pyspark.sql import functions as F

from turnwise.operators import splits


def ids(spark, n):
    return spark.range(n).select((F.col("id") * 7).alias("conv_id"))


def in_order(n, seed=42):
    return sorted((hashlib.md5(f"{seed}:{i * 7}".encode()).hexdigest(), i * 7) for i in range(n))


@pytest.mark.parametrize("n,sizes", [(0, (0, 0, 0)), (1, (0, 0, 1)), (10, (8, 1, 1)), (77, (61, 7, 9)), (5000, None)])
def test_sizes_and_members_are_exact(spark, n, sizes):
    got = {r.conv_id: r.split for r in splits.assign_splits(ids(spark, n)).collect()}
    n_train, n_val = int(n * 0.8), int(n * 0.1)
    assert sizes is None or sizes == (n_train, n_val, n - n_train - n_val)
    expected = {}
    for rank, (_, conv_id) in enumerate(in_order(n)):
        expected[conv_id] = "train" if rank < n_train else "val" if rank < n_train + n_val else "test"
    assert got == expected


@pytest.mark.parametrize("ratios", [(0.0, 0.5), (1.0, 0.0), (0.5, 0.5), (0.0, 0.0), (0.29, 0.57)])
def test_other_ratios(spark, ratios):
    got = splits.split_sizes(splits.assign_splits(ids(spark, 100), None, *ratios)).collect()
    sizes = {r.split: r.n for r in got}
    n_train, n_val = int(100 * ratios[0]), int(100 * ratios[1])
    expected = {"train": n_train, "val": n_val, "test": 100 - n_train - n_val}
    assert sizes == {k: v for k, v in expected.items() if v}


def test_order_is_the_hash_order_and_ignores_partitioning(spark):
    for df in (ids(spark, 3000), ids(spark, 3000).repartition(13, F.rand(3)), ids(spark, 3000).coalesce(1)):
        got = {r.split_rank: (r.shuffle_key, r.conv_id) for r in splits.seeded_order(df).collect()}
        assert [got[i] for i in range(3000)] == in_order(3000)


def test_another_seed_is_another_order(spark):
    a = splits.seeded_order(ids(spark, 50), 1).orderBy("split_rank").collect()
    assert [r.conv_id for r in a] == [i for _, i in in_order(50, 1)]


def test_texts_are_not_shuffled(spark, tmp_path):
    rows = ids(spark, 100).withColumn("turns", F.array(F.lit("some text")))
    rows.write.parquet(f"{tmp_path}/c")
    plan = splits.assign_splits(spark.read.parquet(f"{tmp_path}/c"))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def test_stable_splits_do_not_change_as_data_grows(spark, tmp_path):
    ids = spark.range(4000).select(F.col("id").alias("conv_id"))

    def assigned(df, *ratios):
        return {r.conv_id: r.split for r in splits.assign_stable_splits(df, *ratios).collect()}

    all_of_them = assigned(ids)
    some = assigned(ids.filter("conv_id % 3 = 0").repartition(5))
    assert some == {k: all_of_them[k] for k in some}
    counts = {s: list(all_of_them.values()).count(s) for s in ("train", "val", "test")}
    assert abs(counts["train"] - 3200) < 100 and abs(counts["val"] - 400) < 80 and sum(counts.values()) == 4000
    more = assigned(ids, 0.85, 0.1)
    assert all(more[k] == "train" for k, s in all_of_them.items() if s == "train")
    assert set(assigned(ids, 0.0, 1.0).values()) == {"val"} and set(assigned(ids, 1.0, 0.0).values()) == {"train"}
    with pytest.raises(ValueError):
        splits.assign_stable_splits(ids, 0.9, 0.2)
    plan = splits.assign_stable_splits(ids)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
