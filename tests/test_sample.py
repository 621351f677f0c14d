"""Exact sampling invariants: sizes, disjointness, partition independence, SQL order."""

import math

import pytest
from pyspark.sql import functions as F

from dpframe.operators import sample
from tests.conftest import SF01


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF01}/orders.parquet").withColumn("key", F.col("o_orderkey").cast("string"))


def test_split_exact_sizes_and_partition_independence(orders):
    a = sample.split(orders, F.col("key"), 0.2, 42, stratify="o_orderstatus")
    b = sample.split(orders.repartition(7), F.col("key"), 0.2, 42, stratify="o_orderstatus")
    ka = {r[0] for r in a.where("is_test = 1").select("o_orderkey").collect()}
    kb = {r[0] for r in b.where("is_test = 1").select("o_orderkey").collect()}
    assert ka == kb
    sizes = {r[0]: r[1] for r in orders.groupBy("o_orderstatus").count().collect()}
    got = {r[0]: r[1] for r in a.where("is_test = 1").groupBy("o_orderstatus").count().collect()}
    assert got == {s: math.ceil(0.2 * n) for s, n in sizes.items()}


def test_first_rows_follow_md5_order(orders):
    d = sample.shuffle_order(orders, F.col("key"), 42)
    first = [r[0] for r in d.orderBy("pos").limit(5).select("o_orderkey").collect()]
    assert first == [14563, 1808, 11778, 11012, 11664]


def test_radix_select_multiple_levels(orders, monkeypatch):
    monkeypatch.setattr(sample, "FINISH_ROWS", 2)   # force every radix level
    d = sample.prepare(orders, F.col("key"), 42, ["o_orderstatus"])
    keep = sample.select_first(d, 123).groupBy("o_orderstatus").count().collect()
    assert all(r[1] == 123 for r in keep)
    monkeypatch.undo()
    ref = sample.select_first(d, 123).select("o_orderkey").collect()
    assert len(ref) == 3 * 123


def test_hash_rank_is_a_permutation(orders):
    r = sample.shuffle_order(orders, F.col("key"), 42)
    n = orders.count()
    assert sorted(x[0] for x in r.select("pos").collect()) == list(range(1, n + 1))


def test_downsample_and_short_class(orders):
    d = sample.downsample(orders, F.col("key"), "o_orderstatus", 43)
    counts = {r[1] for r in d.groupBy("o_orderstatus").count().collect()}
    assert len(counts) == 1
    with pytest.raises(ValueError):
        sample.downsample(orders, F.col("key"), "o_orderstatus", 43, n=10 ** 6)


def test_oversample_exact_count(orders):
    d = sample.oversample(orders, F.col("key"), "o_orderstatus", 43, targets={"F": 7000, "O": 100})
    got = {r[0]: r[1] for r in d.groupBy("o_orderstatus").count().collect()}
    assert got == {"F": 7000, "O": 100}


def test_resample_large_class_without_and_small_class_with_replacement(orders):
    sizes = {r[0]: r[1] for r in orders.groupBy("o_orderstatus").count().collect()}
    d = sample.oversample(orders, F.col("key"), "o_orderstatus", 43, targets={"F": sizes["F"] - 5, "O": sizes["O"] + 5})
    got = {r[0]: (r[1], r[2]) for r in d.groupBy("o_orderstatus").agg(F.count("*"), F.countDistinct("key")).collect()}
    assert got["F"] == (sizes["F"] - 5, sizes["F"] - 5)
    assert got["O"][0] == sizes["O"] + 5 and got["O"][1] < sizes["O"]
    with pytest.raises(ValueError):
        sample.oversample(orders, F.col("key"), "o_orderstatus", 43, targets={"none": 3})


def test_batches_and_microbatch_guard(orders):
    b = sample.assign_batches(orders.limit(1000), F.col("key"), 64, epochs=2, seed=1, microbatches=8)
    sizes = {(r[0], r[1]): r[2] for r in b.groupBy("epoch", "step").count().collect()}
    assert max(sizes.values()) == 64 and len({e for e, _ in sizes}) == 2
    with pytest.raises(ValueError):
        sample.assign_batches(orders, F.col("key"), 64, microbatches=7)


def test_hot_group_exact(spark):
    """One class holds a third of all rows: sizes and ranks stay exact."""
    import hashlib
    n = 9000
    rows = [(str(i), "hot" if i % 3 == 0 else f"g{i % 50}") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, cls string")
    d = sample.prepare(df, F.col("key"), 7, ["cls"])
    sizes = {r[0]: r[1] for r in df.groupBy("cls").count().collect()}
    kept = {r[0]: r[1] for r in sample.select_first(d, 40).groupBy("cls").count().collect()}
    assert kept == {g: min(40, c) for g, c in sizes.items()}
    hot_keys = sorted((hashlib.md5(f"{k}-7".encode()).hexdigest() + "|" + k, k) for k, c in rows if c == "hot")
    want = [k for _, k in hot_keys[:40]]
    got = sorted(r[0] for r in sample.select_first(d, 40).where("cls = 'hot'").select("key").collect())
    assert got == sorted(want)
    ranked = sample.hash_rank(d.where("cls = 'hot'")).select("key", "rn").collect()
    assert sorted((r["rn"], r["key"]) for r in ranked) == [(i + 1, k) for i, (_, k) in enumerate(hot_keys)]


def test_split_by_equals_stratified_split(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 30).cast("string")).alias("g"))
    a = sample.split(df, F.col("key"), 0.2, 7, stratify="g").where("is_test = 1").select("key").collect()
    b = sample.split_by(df, F.col("key"), ["g"], 0.2, 7).where("is_test = 1").select("key").collect()
    assert {r[0] for r in a} == {r[0] for r in b} and len(b) == 400 + 10 * 20


def test_exact_sizes_with_repeated_keys_and_rows(spark, monkeypatch):
    """A key in many rows and rows equal in all columns, at the boundary: exactly n, the same on any partitioning."""
    rows = [(f"k{i % 5}", c, i % 7 if i % 2 else 0) for c in ("a", "b") for i in range(60)] + [("solo", "b", 1)]
    df = spark.createDataFrame(rows, "key string, cls string, v int")
    for n in (1, 11, 21, 23, 59, 60):
        got = sample.downsample(df, F.col("key"), "cls", 43, n=n)
        assert {r[0]: r[1] for r in got.groupBy("cls").count().collect()} == {"a": n, "b": n}
        again = sample.downsample(df.repartition(5), F.col("key"), "cls", 43, n=n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
        assert got.exceptAll(df).count() == 0                 # only rows there are, as often as they are
    with pytest.raises(ValueError):
        sample.downsample(df, F.col("key"), "cls", 43, n=1, classes=["a", "b", "c"])
    assert sample.downsample(df, F.col("key"), "cls", 43, classes=["a", "b", "c"]).count() == 0
    assert {r[0]: r[1] for r in sample.downsample(df, F.col("key"), "cls", 43).groupBy("cls").count().collect()} == {"a": 60, "b": 60}
    split = sample.split(df, F.col("key"), 0.3, 42, stratify="cls")
    assert {(r[0], r[1]): r[2] for r in split.groupBy("cls", "is_test").count().collect()} == {("a", 1): 18, ("a", 0): 42, ("b", 1): 19, ("b", 0): 42}
    assert split.drop("is_test").exceptAll(df).count() == 0 and split.count() == df.count()
    assert sample.validation_tail(df, F.col("key"), 0.25, 42).where("is_val = 1").count() == 121 - 90
    monkeypatch.setattr(sample, "FINISH_ROWS", 2)             # more rows of one key than are ordered directly
    got = sample.downsample(df, F.col("key"), "cls", 43, n=21)
    assert {r[0]: r[1] for r in got.groupBy("cls").count().collect()} == {"a": 21, "b": 21}


def test_rows_are_hashed_twice_whatever_the_levels(spark, monkeypatch):
    """Level 0 and one pass for the boundary buckets read all rows; the further levels read only those."""
    monkeypatch.setattr(sample, "FINISH_ROWS", 2)               # force every radix level
    calls = spark.sparkContext.accumulator(0)

    def seen(k):
        calls.add(1)
        return k
    d = spark.range(3000).select(F.udf(seen, "string")(F.col("id").cast("string")).alias("key"))
    d = sample.prepare(d, F.col("key"), 7, [])
    thr = sample._thresholds(d, 1000)
    assert thr[""].need == thr[""].ties == 1 and calls.value < 2.1 * 3000      # the boundary rows once more, after their filter
    monkeypatch.undo()
    assert sample._thresholds(d, 1000)[""] == thr[""]
