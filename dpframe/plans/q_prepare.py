"""Queries for scans, projections, predicates, encoding and scaling (S1, P, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dpframe.operators import prepare, sample
from dpframe.plans.datasets import (LINEITEM_KEY_SQL, METRIC_HISTORY_SQL, SEED, labelled_lineitem,
                                    metric_history, table)
from dpframe.plans.q_flagship import token_sql
from dpframe.plans.registry import register, rounded
from dpframe.session import checkpoint_dir

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long_stats(df: DataFrame, arr: str, digits: int = 6) -> DataFrame:
    """Per array position: count, sum, min, max (exact check of every element)."""
    e = df.select(F.posexplode(arr).alias("pos", "v"))
    return rounded(e.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("double")).alias("s"),
                                         F.min(F.col("v").cast("double")).alias("lo"),
                                         F.max(F.col("v").cast("double")).alias("hi")), digits)


def _long_stats_sql(exprs: list[str], src: str, digits: int = 6) -> str:
    parts = [f"SELECT {i} AS pos, CAST({e} AS DOUBLE) AS v FROM {src}" for i, e in enumerate(exprs)]
    return (f"SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(sum(v), {digits}) AS s, "
            f"round(min(v), {digits}) AS lo, round(max(v), {digits}) AS hi FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY pos")


# ------------------------------------------------------------------ S1

LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
])


@register("s1_csv_scan", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey,
       round(sum(l_extendedprice), 6) AS sum_price, round(sum(l_discount), 6) AS sum_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write lineitem as headed CSV, read it back with a declared schema."""
    import uuid
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    cols = [f.name for f in LINEITEM_SCHEMA.fields]
    table(spark, sf_dir, "lineitem").select(*cols).write.option("header", True).csv(path)
    df = spark.read.schema(LINEITEM_SCHEMA).option("header", True).csv(path)
    return rounded(df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("sum_orderkey"),
        F.sum("l_extendedprice").alias("sum_price"), F.sum("l_discount").alias("sum_discount")), 6)


# ------------------------------------------------------------------ P1–P11

@register("p1_split_target", f"""
SELECT {LINEITEM_KEY_SQL} AS key, CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT) AS label,
       l_extendedprice, l_tax, l_returnflag, l_linestatus FROM lineitem""")
def p1_split_target(spark, sf_dir):
    """The target becomes ``label``; it and its inputs leave the features."""
    li = labelled_lineitem(spark, sf_dir)
    return prepare.split_target(li, "label").select(
        "key", "label", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")


@register("p2_columns_by_kind", """
SELECT 'numeric' AS kind, count(*) AS n_rows, round(sum(c_acctbal), 6) AS s_first FROM customer
UNION ALL SELECT 'categorical', count(*), CAST(count(DISTINCT c_name) AS DOUBLE) FROM customer""")
def p2_columns_by_kind(spark, sf_dir):
    """Pick numeric and string columns by schema; aggregate each block."""
    c = table(spark, sf_dir, "customer").drop("c_custkey", "c_nationkey")
    num, cat = prepare.columns_by_kind(c)
    a = c.select(*num).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(num[0]).alias("s_first"))
    b = c.select(*cat).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(cat[0]).cast("double").alias("s_first"))
    return rounded(a.select(F.lit("numeric").alias("kind"), "*")
                   .unionByName(b.select(F.lit("categorical").alias("kind"), "*")), 6)


@register("p3_cast_float_array", _long_stats_sql([f"CAST({c} AS FLOAT)" for c in NUM], "lineitem"))
def p3_cast_float_array(spark, sf_dir):
    """Numeric features as ``array<float>``; checked per position."""
    li = table(spark, sf_dir, "lineitem")
    return _long_stats(li.select(prepare.to_float_array(NUM).alias("f")), "f")


@register("p4_filter_class", f"""
SELECT {LINEITEM_KEY_SQL} AS key, l_quantity, l_discount FROM lineitem
WHERE CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT) = 1""")
def p4_filter_class(spark, sf_dir):
    """Rows of the positive class."""
    li = labelled_lineitem(spark, sf_dir)
    return prepare.label_rows(li, "label", 1).select("key", "l_quantity", "l_discount")


_P5_EXPRS = ([f"CAST({c} AS FLOAT)" for c in NUM]
             + [f"CAST(CAST(l_returnflag = '{v}' AS INT) AS FLOAT)" for v in "ANR"]
             + [f"CAST(CAST(l_linestatus = '{v}' AS INT) AS FLOAT)" for v in "FO"])


@register("p5_concat_blocks", _long_stats_sql(_P5_EXPRS, "lineitem"))
def p5_concat_blocks(spark, sf_dir):
    """P5: numeric block then one-hot block, concatenated."""
    li = table(spark, sf_dir, "lineitem")
    cats = prepare.onehot_fit(li, ["l_returnflag", "l_linestatus"])
    oh = prepare.onehot_columns(cats)
    f = prepare.concat_blocks(prepare.to_float_array(NUM), prepare.to_float_array([e for _, e in oh]))
    return _long_stats(li.select(f.alias("f")), "f")


@register("p6_pick_positions", _long_stats_sql([_P5_EXPRS[i] for i in (6, 0, 2)], "lineitem"))
def p6_pick_positions(spark, sf_dir):
    """Keep positions [6, 0, 2] in that (rank) order."""
    li = table(spark, sf_dir, "lineitem")
    cats = prepare.onehot_fit(li, ["l_returnflag", "l_linestatus"])
    oh = prepare.onehot_columns(cats)
    f = prepare.concat_blocks(prepare.to_float_array(NUM), prepare.to_float_array([e for _, e in oh]))
    return _long_stats(li.select(prepare.pick_positions(f, [6, 0, 2]).alias("f")), "f")


@register("p7_truncate_to_batch", f"""
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM (
  SELECT CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT) AS label,
         row_number() OVER (ORDER BY {token_sql(LINEITEM_KEY_SQL, SEED)}) AS rn,
         count(*) OVER () AS cnt FROM lineitem) WHERE rn <= (cnt // 256) * 256""")
def p7_truncate_to_batch(spark, sf_dir):
    """Keep the first (n // batch) * batch rows in seeded order (tail dropped)."""
    li = labelled_lineitem(spark, sf_dir)
    d = sample.prepare(li, F.col("key"), SEED)
    thr = sample._thresholds(d, lambda total: F.floor(total / 256) * 256)
    kept = sample._mark(d, thr, "_first").where("_first").drop("_first")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"))


@register("p9_every_fifth_and_last", f"""
SELECT run_id, key, step, round(value, 6) AS value FROM (
  SELECT *, max(step) OVER (PARTITION BY run_id, key) AS last_step FROM ({METRIC_HISTORY_SQL}) h) x
WHERE step % 5 = 0 OR step = last_step""")
def p9_every_fifth_and_last(spark, sf_dir):
    """Keep epochs divisible by 5 and the last epoch of each run/metric."""
    h = metric_history(spark, sf_dir)
    # last step per series as a combinable aggregate joined back (AQE splits a hot series in the join)
    last = h.groupBy("run_id", "key").agg(F.max("step").alias("last_step"))
    return rounded(h.join(last, ["run_id", "key"])
                   .where((F.col("step") % 5 == 0) | (F.col("step") == F.col("last_step")))
                   .select("run_id", "key", "step", "value"), 6)


@register("p10_report_trials", f"""
SELECT run_id, key, trial_num, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER w AS trial_num, count(*) OVER (PARTITION BY run_id, key) AS total,
         min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
  FROM ({METRIC_HISTORY_SQL}) h
  WINDOW w AS (PARTITION BY run_id, key ORDER BY step, ts, event_id)) x
WHERE best_before IS NULL OR value < best_before OR trial_num = 1 OR trial_num % 10 = 0 OR trial_num = total""")
def p10_report_trials(spark, sf_dir):
    """P10: rows that are a new best (lower), the first, every 10th or the last (chunked series scan)."""
    from dpframe.operators import runs
    h = metric_history(spark, sf_dir)
    d = runs.series_scan(h, ["run_id", "key"], ["step", "ts", "event_id"], "value")
    d = d.withColumn("trial_num", F.col("_i").cast("int"))
    keep = (F.col("_min_before").isNull() | (F.col("value") < F.col("_min_before")) | (F.col("_i") == 1)
            | (F.col("_i") % 10 == 0) | (F.col("_i") == F.col("_n")))
    return rounded(d.where(keep).select("run_id", "key", "trial_num", "value"), 6)


@register("p11_nan_to_zero", """
SELECT l_returnflag, round(sum(r), 6) AS s, CAST(sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM (
  SELECT l_returnflag, CASE WHEN isnan(x) THEN 0.0 ELSE x END AS r FROM (
    SELECT l_returnflag, CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_tax / l_discount END AS x
    FROM lineitem) a) b GROUP BY l_returnflag""")
def p11_nan_to_zero(spark, sf_dir):
    """Undefined ratios arrive as NaN and are replaced by 0."""
    li = table(spark, sf_dir, "lineitem")
    x = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    r = prepare.nan_to_zero(x)
    return rounded(li.select("l_returnflag", r.alias("r")).groupBy("l_returnflag").agg(
        F.sum("r").alias("s"), F.sum((F.col("r") == 0).cast("long")).alias("zeros")), 6)


# ------------------------------------------------------------------ E1–E7

ORDER_CATS = ["o_orderpriority", "o_orderstatus"]


def _indicator_counts(df: DataFrame, cols) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), e.cast("long").alias("v"))
                                        for n, e in cols])).alias("x")) \
        .groupBy("x.feature").agg(F.sum("x.v").alias("ones"))


def _indicator_sql(drop_first: bool) -> str:
    parts = []
    for c in ORDER_CATS:
        first = f" WHERE v > (SELECT min({c}) FROM orders)" if drop_first else ""
        parts.append(f"""SELECT '{c}_' || v AS feature, ones FROM (
            SELECT v, CAST(sum(CASE WHEN {c} = v THEN 1 ELSE 0 END) AS BIGINT) AS ones
            FROM orders, (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL) d GROUP BY v) g{first}""")
    return " UNION ALL ".join(parts)


@register("e1_onehot", _indicator_sql(False))
def e1_onehot(spark, sf_dir):
    """One-hot of order priority and status; ones per named indicator."""
    o = table(spark, sf_dir, "orders")
    cats = prepare.onehot_fit(o, ORDER_CATS)
    return _indicator_counts(o, prepare.onehot_columns(cats))


@register("e1_wide_domain", """
WITH seen AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_returnflag = 'N'),
idx AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS position FROM seen)
SELECT CAST(position AS BIGINT) AS position, count(*) AS n FROM lineitem LEFT JOIN idx ON CAST(l_partkey AS VARCHAR) = value GROUP BY position""")
def e1_wide_domain(spark, sf_dir):
    """E1 on a wide domain: parts seen in one return class get a position, rows of all classes use it."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    index = prepare.category_index(li.where("l_returnflag = 'N'"), "l_partkey")
    return prepare.onehot_position(li, "l_partkey", index).groupBy("position").agg(F.count(F.lit(1)).alias("n"))


@register("e2_dummies_drop_first", _indicator_sql(True))
def e2_dummies_drop_first(spark, sf_dir):
    """Dummy coding without the alphabetically first category."""
    o = table(spark, sf_dir, "orders")
    cats = prepare.onehot_fit(o, ORDER_CATS)
    return _indicator_counts(o, prepare.onehot_columns(cats, drop_first=True))


@register("e3_feature_names", """
SELECT row_number() OVER (ORDER BY blk, name) - 1 AS idx, name FROM (
  SELECT 0 AS blk, 'c_acctbal' AS name
  UNION ALL SELECT DISTINCT 1, 'c_mktsegment_' || c_mktsegment FROM customer)""")
def e3_feature_names(spark, sf_dir):
    """Encoder output names ``col_value`` after the numeric names, with index."""
    c = table(spark, sf_dir, "customer")
    cats = prepare.onehot_fit(c, ["c_mktsegment"])
    names = ["c_acctbal"] + [n for n, _ in prepare.onehot_columns(cats)]
    # names come from the fitted encoder (a bounded list); one row per feature
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "idx long, name string")


@register("e4_label_onehot_argmax", """
SELECT label, repeat('0', label) || '1' || repeat('0', 9 - label) AS code,
       count(*) AS n, CAST(sum(CASE WHEN label = label THEN 1 ELSE 0 END) AS BIGINT) AS decoded_ok
FROM embeddings GROUP BY label""")
def e4_label_onehot_argmax(spark, sf_dir):
    """Label -> 10-wide one-hot -> argmax decodes back to the label."""
    e = table(spark, sf_dir, "embeddings")
    oh = prepare.label_onehot(F.col("label"), 10)
    d = e.select("label", oh.alias("oh"))
    return d.groupBy("label", F.array_join(F.transform("oh", lambda v: v.cast("string")), "").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((prepare.argmax(F.col("oh")) == F.col("label")).cast("long")).alias("decoded_ok"))


def _scaled_sql(where_fit: str = "", where_out: str = "", src: str = "lineitem") -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    cols = ", ".join(f"round(CASE WHEN s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END, 9) AS {c}" for c in NUM)
    return f"SELECT key, {cols} FROM {src} x, (SELECT {stats} FROM {src} {where_fit}) st {where_out}"


@register("e5_standard_scale", f"WITH src AS (SELECT *, {LINEITEM_KEY_SQL} AS key FROM lineitem) "
          + _scaled_sql(src="src"))
def e5_standard_scale(spark, sf_dir):
    """E5: standard score with population std, fitted and applied on all rows."""
    li = labelled_lineitem(spark, sf_dir)
    stats = prepare.scaler_fit(li, NUM)
    return rounded(li.select("key", *[e.alias(n) for n, e in prepare.scale_columns(stats)]))


_SPLIT_SRC = f"""WITH src AS (SELECT *, CASE WHEN rn <= ceil(0.2::DOUBLE * cnt) THEN 1 ELSE 0 END AS is_test FROM (
  SELECT *, {LINEITEM_KEY_SQL} AS key,
         row_number() OVER (PARTITION BY CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)
                            ORDER BY {token_sql(LINEITEM_KEY_SQL, SEED)}) AS rn,
         count(*) OVER (PARTITION BY CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)) AS cnt
  FROM lineitem) a) """


@register("e6_fit_train_apply_test", _SPLIT_SRC + _scaled_sql("WHERE is_test = 0", "WHERE x.is_test = 1", "src"))
def e6_fit_train_apply_test(spark, sf_dir):
    """Scaler fitted on the (stratified) train rows, applied to the test rows."""
    li = labelled_lineitem(spark, sf_dir)
    sp = sample.split(li, F.col("key"), 0.2, SEED, stratify="label")
    stats = prepare.scaler_fit(sp.where("is_test = 0"), NUM)
    return rounded(sp.where("is_test = 1").select("key", *[e.alias(n) for n, e in prepare.scale_columns(stats)]))


def _e7_sql() -> str:
    dummies = []
    for c in ORDER_CATS:
        dummies.append(f"SELECT DISTINCT '{c}' AS col, {c} AS v FROM orders WHERE {c} > (SELECT min({c}) FROM orders)")
    return f"""WITH d AS ({' UNION ALL '.join(dummies)}),
long AS (
  SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice AS x FROM orders
  UNION ALL
  SELECT o_orderkey, d.col || '_' || d.v, CAST(CASE WHEN (d.col = 'o_orderpriority' AND o_orderpriority = d.v)
      OR (d.col = 'o_orderstatus' AND o_orderstatus = d.v) THEN 1 ELSE 0 END AS DOUBLE) FROM orders, d),
st AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY feature)
SELECT feature, round(sum(z), 6) AS sum_z, round(sum(z * z), 6) AS sum_z2, round(max(z), 6) AS max_z FROM (
  SELECT long.feature, CASE WHEN s = 0 THEN x - m ELSE (x - m) / s END AS z FROM long JOIN st USING (feature)) q
GROUP BY feature"""


@register("e7_scale_with_dummies", _e7_sql())
def e7_scale_with_dummies(spark, sf_dir):
    """Dummies (drop first) then standardise every column, fitted on all rows."""
    o = table(spark, sf_dir, "orders")
    cats = prepare.onehot_fit(o, ORDER_CATS)
    dummies = prepare.onehot_columns(cats, drop_first=True)
    wide = o.select(F.col("o_totalprice").cast("double").alias("o_totalprice"),
                    *[e.cast("double").alias(n) for n, e in dummies])
    stats = prepare.scaler_fit(wide, wide.columns)
    scaled = wide.select(*[e.alias(n) for n, e in prepare.scale_columns(stats)])
    long = scaled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("z"))
                                            for c in scaled.columns])).alias("x"))
    return rounded(long.groupBy("x.feature").agg(F.sum("x.z").alias("sum_z"), F.sum(F.col("x.z") * F.col("x.z")).alias("sum_z2"),
                                                 F.max("x.z").alias("max_z")), 6)
