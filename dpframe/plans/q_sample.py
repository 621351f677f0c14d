"""Queries for splitting, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from dpframe.operators import sample
from dpframe.plans.datasets import LINEITEM_KEY_SQL, SEED, labelled_lineitem, table
from dpframe.plans.q_flagship import token_sql
from dpframe.plans.registry import register

OKEY = "CAST(o_orderkey AS VARCHAR)"
LABEL_SQL = "CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)"
BAL_SEED = 43


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumn("key", F.col("o_orderkey").cast("string"))


@register("t1_split", f"""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {token_sql(OKEY, SEED)}) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS INT) AS is_test
FROM orders""")
def t1_split(spark, sf_dir):
    """Exact random split, test = ceil(0.2 n) rows."""
    return sample.split(_orders(spark, sf_dir), F.col("key"), 0.2, SEED).select("o_orderkey", "is_test")


@register("t2_stratified_split", f"""
SELECT o_orderkey, o_orderstatus,
  CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {token_sql(OKEY, SEED)})
       <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderstatus)) AS INT) AS is_test
FROM orders""")
def t2_stratified_split(spark, sf_dir):
    """Stratified exact split on order status (every class keeps its share)."""
    return sample.split(_orders(spark, sf_dir), F.col("key"), 0.2, SEED, stratify="o_orderstatus") \
        .select("o_orderkey", "o_orderstatus", "is_test")


@register("t2_split_many_groups", f"""
SELECT o_orderkey, o_custkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {token_sql(OKEY, SEED)})
       <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY o_custkey)) AS INT) AS is_test
FROM orders""")
def t2_split_many_groups(spark, sf_dir):
    """T2 over as many groups as there are customers (ranks and sizes joined, no literal thresholds)."""
    return sample.split_by(_orders(spark, sf_dir), F.col("key"), ["o_custkey"], 0.2, SEED) \
        .select("o_orderkey", "o_custkey", "is_test")


@register("t3_validation_tail", f"""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {token_sql(OKEY, SEED)}) > floor(0.8::DOUBLE * count(*) OVER ()) AS INT) AS is_val
FROM orders""")
def t3_validation_tail(spark, sf_dir):
    """validation = last 20 % of the shuffled set."""
    return sample.validation_tail(_orders(spark, sf_dir), F.col("key"), 0.2, SEED).select("o_orderkey", "is_val")


_BAL_SQL = f"""
SELECT key, label FROM (
  SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY {token_sql('key', BAL_SEED)}) AS rn,
         min(cnt) OVER () AS m
  FROM (SELECT {LINEITEM_KEY_SQL} AS key, {LABEL_SQL} AS label,
               count(*) OVER (PARTITION BY {LABEL_SQL}) AS cnt FROM lineitem) a) b
WHERE rn <= m"""


@register("t4_downsample", _BAL_SQL)
def t4_downsample(spark, sf_dir):
    """T4: majority cut to the minority count without replacement (exact n)."""
    li = labelled_lineitem(spark, sf_dir)
    return sample.downsample(li, F.col("key"), "label", BAL_SEED).select("key", "label")


@register("t5_fixed_n_per_class", f"""
SELECT o_orderkey, o_orderstatus FROM (
  SELECT o_orderkey, o_orderstatus,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY {token_sql(OKEY, BAL_SEED)}) AS rn FROM orders) a
WHERE rn <= 400""")
def t5_fixed_n_per_class(spark, sf_dir):
    """T5: exactly 400 orders from every status (raises when a status is short)."""
    o = _orders(spark, sf_dir)
    return sample.downsample(o, F.col("key"), "o_orderstatus", BAL_SEED, n=400).select("o_orderkey", "o_orderstatus")


OVERSAMPLE_TO = 2000


@register("t6_oversample", f"""
WITH r AS (
  SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY {token_sql('key', BAL_SEED)}) AS rn,
         count(*) OVER (PARTITION BY label) AS cnt
  FROM (SELECT {LINEITEM_KEY_SQL} AS key, {LABEL_SQL} AS label FROM lineitem) a),
sizes AS (SELECT DISTINCT label, cnt FROM r),
draws AS (
  SELECT s.label, d.range AS draw,
         (('0x' || substr(md5(CAST(d.range AS VARCHAR) || '-{BAL_SEED}-' || CAST(s.label AS VARCHAR)), 1, 15))::BIGINT % s.cnt) + 1 AS rn
  FROM sizes s, range({OVERSAMPLE_TO}) d WHERE s.cnt < {OVERSAMPLE_TO}
  UNION ALL
  SELECT label, rn - 1, rn FROM r WHERE cnt >= {OVERSAMPLE_TO} AND rn <= {OVERSAMPLE_TO})
SELECT r.key, r.label, count(*) AS copies FROM draws JOIN r USING (label, rn) GROUP BY r.key, r.label""")
def t6_oversample(spark, sf_dir):
    """2,000 rows of each class, the majority without and the minority with replacement; copies per row."""
    li = labelled_lineitem(spark, sf_dir)
    drawn = sample.oversample(li, F.col("key"), "label", BAL_SEED, targets={0: OVERSAMPLE_TO, 1: OVERSAMPLE_TO})
    return drawn.groupBy("key", "label").agg(F.count(F.lit(1)).alias("copies"))


@register("t7_union_samples", _BAL_SQL.replace("SELECT key, label FROM (", "SELECT label, count(*) AS n FROM (", 1)
          + " GROUP BY label")
def t7_union_samples(spark, sf_dir):
    """Union of the downsampled majority and the whole minority."""
    li = labelled_lineitem(spark, sf_dir)
    maj = li.where("label = 0")
    mino = li.where("label = 1")
    n_min = mino.count()
    cut = sample.downsample(maj, F.col("key"), "label", BAL_SEED, n=n_min)
    both = cut.unionByName(mino)
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("t8_seeded_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {token_sql(OKEY, SEED)}) AS pos FROM orders")
def t8_seeded_shuffle(spark, sf_dir):
    """Seeded permutation as an explicit position (no sort of the output)."""
    return sample.shuffle_order(_orders(spark, sf_dir), F.col("key"), SEED).select("o_orderkey", "pos")


@register("t9_class_counts", f"""
SELECT 'before' AS stage, {LABEL_SQL} AS label, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'after', label, count(*) FROM ({_BAL_SQL}) b GROUP BY label""")
def t9_class_counts(spark, sf_dir):
    """Class counts before and after balancing."""
    li = labelled_lineitem(spark, sf_dir)
    bal = sample.downsample(li, F.col("key"), "label", BAL_SEED)
    return (sample.class_counts(li).select(F.lit("before").alias("stage"), "label", "n")
            .unionByName(sample.class_counts(bal).select(F.lit("after").alias("stage"), "label", "n")))


def _batches_sql(micro: bool) -> str:
    ek = "(key || '-e' || CAST(epoch AS VARCHAR))"
    mb = ", CAST((rk - 1) % 8 AS INTEGER) AS microbatch" if micro else ""
    return f"""
SELECT key, epoch, CAST(floor((rk - 1) / 64) AS INTEGER) AS step{mb} FROM (
  SELECT key, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {token_sql(ek, SEED)}) AS rk
  FROM ({_BAL_SQL}) b, (SELECT CAST(range AS INTEGER) AS epoch FROM range(1, 3)) e) x"""


@register("t10_epoch_batches", _batches_sql(False))
def t10_epoch_batches(spark, sf_dir):
    """Per epoch a full reshuffle of the balanced set, then batches of 64."""
    li = labelled_lineitem(spark, sf_dir)
    bal = sample.downsample(li, F.col("key"), "label", BAL_SEED).select("key")
    return sample.assign_batches(bal, F.col("key"), 64, epochs=2, seed=SEED).select("key", "epoch", "step")


@register("t11_microbatches", _batches_sql(True))
def t11_microbatches(spark, sf_dir):
    """Batches of 64 split into 8 microbatches (batch must divide evenly)."""
    li = labelled_lineitem(spark, sf_dir)
    bal = sample.downsample(li, F.col("key"), "label", BAL_SEED).select("key")
    return sample.assign_batches(bal, F.col("key"), 64, epochs=2, seed=SEED, microbatches=8) \
        .select("key", "epoch", "step", "microbatch")


@register("t5_repeated_keys", f"""
SELECT l_returnflag, key, count(*) AS n FROM (
  SELECT l_returnflag, {{key}} AS key, row_number() OVER (PARTITION BY l_returnflag ORDER BY {token_sql('{key}', BAL_SEED)}) AS rn FROM lineitem) a
WHERE rn <= 777 GROUP BY l_returnflag, key""".replace("{key}", "CAST(l_suppkey AS VARCHAR)"))
def t5_repeated_keys(spark, sf_dir):
    """T5 with a key that many rows share (the supplier): exactly 777 rows a class, rows per key."""
    li = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_suppkey").cast("string"))
    return sample.downsample(li, F.col("key"), "l_returnflag", BAL_SEED, n=777).groupBy("l_returnflag", "key").agg(F.count(F.lit(1)).alias("n"))
