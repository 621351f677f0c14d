"""Queries for class weights (W1–W4), clipped/noisy sums (D1–D4), losses and scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dpframe.functions import vec
from dpframe.operators import dpagg, prepare, sample, weights
from dpframe.plans.datasets import LINEITEM_KEY_SQL, SEED, labelled_lineitem, table
from dpframe.plans.q_flagship import (BALANCE_SEED, balanced_sql, prepared_lineitem, prepared_sql,
                                      score_sql, scored_splits, token_sql)
from dpframe.plans.registry import register, rounded

LABEL_SQL = "CAST(l_quantity >= 50 AND l_discount >= 0.05 AS INT)"
TEST_SEED = "dpframe-test-seed"   # fixed only so the oracle can reproduce the noise
TWO_PI = 2.0 * math.pi


# ------------------------------------------------------------------ W1–W4

@register("w1_fixed_class_weight", f"""
SELECT label, count(*) AS n, CASE WHEN label = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS weight,
       round(sum(CASE WHEN label = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 6) AS total_weight
FROM (SELECT {LABEL_SQL} AS label FROM lineitem) GROUP BY label""")
def w1_fixed_class_weight(spark, sf_dir):
    """0.3 for class 0, 0.7 for class 1."""
    li = labelled_lineitem(spark, sf_dir).withColumn("weight", weights.fixed_class_weight(F.col("label")))
    return rounded(li.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"),
                                           F.sum("weight").alias("total_weight")), 6)


@register("w2_balanced_weight", f"""
SELECT label, round(sum(count(*)) OVER () / (2.0 * count(*)), 9) AS weight
FROM (SELECT {LABEL_SQL} AS label FROM lineitem) GROUP BY label""")
def w2_balanced_weight(spark, sf_dir):
    """N / (k n_c) per class."""
    li = labelled_lineitem(spark, sf_dir)
    w = weights.balanced_weights(weights.class_counts(li))
    return rounded(li.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).select(
        "label", weights.class_weight_column(F.col("label"), w).alias("weight")))


def _blend_sql() -> str:
    return f"""
WITH o AS (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0, sum(label) AS n1, count(*) AS n
           FROM (SELECT {LABEL_SQL} AS label FROM lineitem)),
p AS (SELECT count(*) AS bn FROM ({balanced_sql("(SELECT {0} AS key, {1} AS label FROM lineitem)".format(LINEITEM_KEY_SQL, LABEL_SQL), BALANCE_SEED)}) b),
w AS (SELECT 0.5 * (p.bn / (2.0 * (p.bn / 2))) + 0.5 * (o.n / (2.0 * o.n0)) AS w0,
             0.5 * (p.bn / (2.0 * (p.bn / 2))) + 0.5 * (o.n / (2.0 * o.n1)) AS w1 FROM o, p)
SELECT round(CASE WHEN w0 > 3.0 * w1 THEN w1 * 3.0 ELSE w0 END, 9) AS w0, round(CASE WHEN w1 > 3.0 * w0 THEN w0 * 3.0 ELSE w1 END, 9) AS w1
FROM w"""


def _balanced_pair(df, names):
    """W2 weights of classes 0 and 1 as one row."""
    n = F.count(F.lit(1))
    return df.agg(*[(n / (2 * F.sum((F.col("label") == c).cast("int")))).alias(names + str(c)) for c in (0, 1)])


@register("w3_blended_capped", _blend_sql())
def w3_blended_capped(spark, sf_dir):
    """Blend original and post-balancing weights (alpha 0.5), cap the ratio at 3."""
    li = labelled_lineitem(spark, sf_dir)
    bal = sample.downsample(li, F.col("key"), "label", BALANCE_SEED)
    pair = _balanced_pair(li, "orig").crossJoin(_balanced_pair(bal, "post"))      # one row each
    return rounded(weights.blended_weights(pair, 0.5, 3.0))


@register("w4_normalised_weight", f"""
WITH li AS (SELECT {LABEL_SQL} AS label, CASE WHEN {LABEL_SQL} = 1 THEN 0.7 ELSE 0.3 END AS w FROM lineitem)
SELECT label, count(*) AS n, round(max(w / (m + 1e-8)), 9) AS weight, round(sum(w / (m + 1e-8)), 6) AS total
FROM li, (SELECT avg(w) AS m FROM li) a GROUP BY label""")
def w4_normalised_weight(spark, sf_dir):
    """W1 weights normalised to mean 1 (+1e-8) over the whole table."""
    li = labelled_lineitem(spark, sf_dir).withColumn("weight", weights.fixed_class_weight(F.col("label")))
    nw = weights.normalise_weights(li, "weight")
    return rounded(nw.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
                   .join(rounded(nw.groupBy("label").agg(F.sum("weight").alias("total")), 6), "label"))


@register("w4_batch_normalised_weight", f"""
WITH b AS (SELECT key, label, CAST(floor((row_number() OVER (ORDER BY {token_sql("(key || '-e1')", SEED)}) - 1) / 64) AS INTEGER) AS step,
                  CASE WHEN label = 1 THEN 0.7 ELSE 0.3 END AS w
           FROM {balanced_sql("(SELECT {0} AS key, {1} AS label FROM lineitem)".format(LINEITEM_KEY_SQL, LABEL_SQL), BALANCE_SEED)} x)
SELECT step, label, count(*) AS n, round(max(w / (m + 1e-8)), 9) AS weight
FROM b JOIN (SELECT step, avg(w) AS m FROM b GROUP BY step) a USING (step) GROUP BY step, label""")
def w4_batch_normalised_weight(spark, sf_dir):
    """W4 per batch: weights renormalised inside each batch of 64 of the balanced set."""
    li = labelled_lineitem(spark, sf_dir)
    bal = sample.downsample(li, F.col("key"), "label", BALANCE_SEED).select("key", "label")
    b = sample.assign_batches(bal, F.col("key"), 64, 1, SEED).withColumn("weight", weights.fixed_class_weight(F.col("label")))
    nw = weights.normalise_weights(b, "weight", by=["step"])
    return rounded(nw.groupBy("step", "label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


# ------------------------------------------------------------------ D1–D4

EMB_UNNEST = ("SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, "
              "CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings")


def _uniform_sql(txt: str) -> str:
    return f"(CAST(('0x' || substr(md5({txt}), 1, 13))::BIGINT AS DOUBLE) / {float(1 << 52)!r})"


def _gauss_sql(txt: str) -> str:
    u1 = f"greatest({_uniform_sql(txt + " || '|u1'")}, {2.0 ** -53!r})"
    u2 = _uniform_sql(txt + " || '|u2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos({TWO_PI!r} * {u2}))"


@register("d1_clip_l2", f"""
SELECT label, count(*) AS n, round(sum(norm), 6) AS sum_norm,
       round(sum(least(norm, 0.5)), 6) AS sum_clipped_norm, round(max(least(norm, 0.5)), 9) AS max_clipped_norm
FROM (SELECT vec_id, label, sqrt(sum(x * x)) AS norm FROM ({EMB_UNNEST}) GROUP BY vec_id, label) GROUP BY label""")
def d1_clip_l2(spark, sf_dir):
    """Each embedding scaled to L2 norm <= 0.5; norms before and after."""
    e = table(spark, sf_dir, "embeddings")
    c = dpagg.clipped_norms(e, "embedding", 0.5)
    out = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("norm").alias("sum_norm"),
                                 F.sum("clipped_norm").alias("sum_clipped_norm"))
    mx = rounded(c.groupBy("label").agg(F.max("clipped_norm").alias("max_clipped_norm")), 9)
    return rounded(out, 6).join(mx, "label")


def _d2_sql(noise_multiplier: float, clip: float = 0.5) -> str:
    sigma = clip * noise_multiplier
    txt = f"'{TEST_SEED}' || '|' || CAST(label AS VARCHAR) || '|' || CAST(pos AS VARCHAR)"
    noise = f"{sigma!r} * {_gauss_sql(txt)}" if sigma > 0 else "CAST(0.0 AS DOUBLE)"
    return f"""
WITH e AS ({EMB_UNNEST}),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id),
s AS (SELECT label, pos, sum(x * CASE WHEN norm > {clip!r} THEN {clip!r} / norm ELSE 1.0 END) AS s, count(*) AS n
      FROM e JOIN nrm USING (vec_id) GROUP BY label, pos)
SELECT label, pos, round(s, 9) AS sum, round(s + {noise}, 9) AS noisy_sum, n FROM s"""


@register("d2_clipped_sum", _d2_sql(0.0))
def d2_clipped_sum(spark, sf_dir):
    """D2 with noise 0: per-label sum of clipped (C 0.5) embeddings, per coordinate."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(dpagg.noisy_sum(e, "embedding", 0.5, 0.0, ["label"], TEST_SEED))


@register("d2_gaussian_sum", f"SELECT label, pos, noisy_sum FROM ({_d2_sql(1.1)}) x")
def d2_gaussian_sum(spark, sf_dir):
    """Gaussian sum query, sigma = 0.5 * 1.1, fixed test seed (noise reproducible by SQL)."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(dpagg.noisy_sum(e, "embedding", 0.5, 1.1, ["label"], TEST_SEED))


#: The public domain of event types (fixed values): it must not come from the private rows.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_TYPES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in EVENT_TYPES) + ") v(event_type))"


def _d3_sql(noise_multiplier: float, clip: float = 500.0) -> str:
    sigma = clip * noise_multiplier
    txt = f"'{TEST_SEED}' || '|' || CAST(pos AS VARCHAR)"
    noise = f"{sigma!r} * {_gauss_sql(txt)}" if sigma > 0 else "CAST(0.0 AS DOUBLE)"
    cnt_noise = f"{noise_multiplier!r} * {_gauss_sql(chr(39) + TEST_SEED + chr(39) + ' || ' + chr(39) + '|count' + chr(39))}" \
        if sigma > 0 else "CAST(0.0 AS DOUBLE)"
    return f"""
WITH t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS pos FROM {EVENT_TYPES_SQL}),
u AS (SELECT DISTINCT user_id FROM events),
cell AS (SELECT u.user_id, t.event_type, t.pos, coalesce(sum(e.value), 0.0) AS v
         FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type
         GROUP BY u.user_id, t.event_type, t.pos),
nrm AS (SELECT user_id, sqrt(sum(v * v)) AS norm FROM cell GROUP BY user_id),
s AS (SELECT event_type, pos, sum(v * CASE WHEN norm > {clip!r} THEN {clip!r} / norm ELSE 1.0 END) AS s, count(*) AS n
      FROM cell JOIN nrm USING (user_id) GROUP BY event_type, pos)
SELECT event_type, round(s, 6) AS sum, round(s + {noise}, 6) AS noisy_sum, n AS users,
       round(n + {cnt_noise}, 6) AS noisy_users,
       round((s + {noise}) / greatest(n + {cnt_noise}, 1.0), 6) AS noisy_mean FROM s"""


def _d3(spark, sf_dir, nm):
    ev = table(spark, sf_dir, "events")
    return rounded(dpagg.per_user_noisy_sum(ev, "user_id", "event_type", "value", EVENT_TYPES, 500.0, nm, TEST_SEED), 6)


@register("d3_per_user_sum", _d3_sql(0.0))
def d3_per_user_sum(spark, sf_dir):
    """D3 with noise 0: per-user totals by event type as one clipped record per user."""
    return _d3(spark, sf_dir, 0.0)


@register("d3_per_user_noisy_sum", f"SELECT event_type, noisy_sum, noisy_users, noisy_mean FROM ({_d3_sql(1.0)}) x")
def d3_per_user_noisy_sum(spark, sf_dir):
    """D3: noisy per-type sums, noisy user count and noisy mean (fixed test seed)."""
    return _d3(spark, sf_dir, 1.0)


KEYS_PER_USER, KEY_EPSILON, KEY_DELTA, KEY_CLIP = 4, 2.0, 1e-5, 200.0
KEY_SQL = "event_type || ':' || CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) // 20 AS VARCHAR)"


def _private_keys_sql() -> str:
    u = f"({_uniform_sql(chr(39) + TEST_SEED + '|' + chr(39) + ' || k || ' + chr(39) + '|lap' + chr(39))} - 0.5)"
    noise = f"{KEYS_PER_USER / KEY_EPSILON!r} * (-sign({u}) * ln(greatest(1.0 - 2.0 * abs({u}), {2.0 ** -53!r})))"
    return f"""
WITH pairs AS (SELECT user_id, {KEY_SQL} AS k, sum(value) AS v FROM events GROUP BY ALL),
kept AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '|' || k || '|{TEST_SEED}'), k) <= {KEYS_PER_USER}),
shown AS (SELECT * FROM (SELECT k, count(*) + {noise} AS noisy_users FROM kept GROUP BY k) x
          WHERE noisy_users >= {dpagg.key_threshold(KEY_EPSILON, KEY_DELTA, KEYS_PER_USER)!r})"""


def _keyed_events(spark, sf_dir):
    step = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").withColumn("k", F.concat("event_type", F.lit(":"), F.floor(step / 20).cast("string")))


@register("d3_private_keys", f"{_private_keys_sql()} SELECT k, round(noisy_users, 6) AS noisy_users FROM shown")
def d3_private_keys(spark, sf_dir):
    """D3: the (event type, step range) keys that enough users share, under (2, 1e-5), with noisy users (fixed test seed)."""
    ev = _keyed_events(spark, sf_dir)
    return rounded(dpagg.private_keys(ev, "user_id", "k", KEY_EPSILON, KEY_DELTA, KEYS_PER_USER, TEST_SEED), 6)


@register("d3_private_key_sums", f"""{_private_keys_sql()},
r AS (SELECT * FROM kept JOIN shown USING (k)),
nrm AS (SELECT user_id, sqrt(sum(v * v)) AS norm FROM r GROUP BY user_id),
s AS (SELECT k, noisy_users, sum(v * CASE WHEN norm > {KEY_CLIP!r} THEN {KEY_CLIP!r} / norm ELSE 1.0 END) AS s
      FROM r JOIN nrm USING (user_id) GROUP BY k, noisy_users),
z AS (SELECT k, noisy_users, s + {KEY_CLIP!r} * {_gauss_sql(f"'{TEST_SEED}|' || k")} AS noisy_sum FROM s)
SELECT k, round(noisy_users, 6) AS noisy_users, round(noisy_sum, 6) AS noisy_sum, round(noisy_sum / greatest(noisy_users, 1.0), 6) AS noisy_mean FROM z""")
def d3_private_key_sums(spark, sf_dir):
    """D3 with keys found in the data: noisy users, sum and mean of the keys shown (fixed test seed)."""
    ev = _keyed_events(spark, sf_dir)
    return rounded(dpagg.private_key_sums(ev, "user_id", "k", "value", KEY_CLIP, 1.0, KEY_EPSILON, KEY_DELTA, KEYS_PER_USER, TEST_SEED), 6)


@register("d4_microbatch_noisy_mean", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {token_sql("(CAST(vec_id AS VARCHAR) || '-e1')", SEED)}) AS rk FROM embeddings),
e AS (SELECT e.*, CAST(floor((rk - 1) / 64) AS INTEGER) AS step, CAST((rk - 1) % 8 AS INTEGER) AS mb
      FROM ({EMB_UNNEST}) e JOIN r USING (vec_id)),
m AS (SELECT step, mb, pos, avg(x) AS x FROM e GROUP BY step, mb, pos),
nrm AS (SELECT step, mb, sqrt(sum(x * x)) AS norm FROM m GROUP BY step, mb),
s AS (SELECT step, pos, sum(x * CASE WHEN norm > 1.0 THEN 1.0 / norm ELSE 1.0 END) AS s FROM m JOIN nrm USING (step, mb) GROUP BY step, pos)
SELECT step, pos, round(s / 8.0, 9) AS value, round(s / 8.0, 9) AS clean_value FROM s""")
def d4_microbatch_noisy_mean(spark, sf_dir):
    """D4 with noise 0: batches of 64 in 8 microbatches; mean, clip (C 1), sum, / 8."""
    e = table(spark, sf_dir, "embeddings").withColumn("key", F.col("vec_id").cast("string"))
    b = sample.assign_batches(e, F.col("key"), 64, 1, SEED, microbatches=8)
    return rounded(dpagg.microbatch_noisy_mean(b, "embedding", 1.0, 0.0, 8, seed=TEST_SEED))


@register("d4_gaussian_microbatch_mean", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {token_sql("(CAST(vec_id AS VARCHAR) || '-e1')", SEED)}) AS rk FROM embeddings),
e AS (SELECT e.*, CAST(floor((rk - 1) / 64) AS INTEGER) AS step, CAST((rk - 1) % 8 AS INTEGER) AS mb
      FROM ({EMB_UNNEST}) e JOIN r USING (vec_id)),
m AS (SELECT step, mb, pos, avg(x) AS x FROM e GROUP BY step, mb, pos),
nrm AS (SELECT step, mb, sqrt(sum(x * x)) AS norm FROM m GROUP BY step, mb),
s AS (SELECT step, pos, sum(x * CASE WHEN norm > 1.0 THEN 1.0 / norm ELSE 1.0 END) AS s FROM m JOIN nrm USING (step, mb) GROUP BY step, pos)
SELECT step, pos, round((s + 1.1 * {_gauss_sql(f"'{TEST_SEED}|' || step || '|' || pos")}) / 8.0, 9) AS value FROM s""")
def d4_gaussian_microbatch_mean(spark, sf_dir):
    """The same with noise 1.1 on the sum of clipped means (fixed test seed); no exact values."""
    e = table(spark, sf_dir, "embeddings").withColumn("key", F.col("vec_id").cast("string"))
    b = sample.assign_batches(e, F.col("key"), 64, 1, SEED, microbatches=8)
    return rounded(dpagg.microbatch_noisy_mean(b, "embedding", 1.0, 1.1, 8, seed=TEST_SEED))


# ------------------------------------------------------------------ D5–D7, D13

def _test_scored_sql() -> str:
    return f"WITH {prepared_sql()} SELECT key, label, {score_sql('p')} FROM prep WHERE is_test = 1"


@register("d13_batch_score", f"""
SELECT key, label, round(p, 9) AS score, CAST(p > 0.5 AS INT) AS class_id FROM ({_test_scored_sql()}) s""")
def d13_batch_score(spark, sf_dir):
    """Probability and class for every test row (logistic model, literal weights)."""
    sc = scored_splits(spark, sf_dir).where(F.col("split") == "test")
    return rounded(sc.select("key", "label", "score", (F.col("score") > 0.5).cast("int").alias("class_id")))


@register("d5_binary_cross_entropy", f"""
SELECT label, count(*) AS n, round(sum(l), 6) AS sum_loss, round(max(l), 9) AS max_loss FROM (
  SELECT label, -(label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7))) AS l
  FROM ({_test_scored_sql()}) s) GROUP BY label""")
def d5_binary_cross_entropy(spark, sf_dir):
    """Per-row BCE on clipped probabilities, summed per class."""
    sc = scored_splits(spark, sf_dir).where(F.col("split") == "test")
    l = sc.withColumn("l", vec.bce(F.col("label"), F.col("score")))
    return rounded(l.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("sum_loss")), 6) \
        .join(rounded(l.groupBy("label").agg(F.max("l").alias("max_loss"))), "label")


@register("d6_categorical_cross_entropy", f"""
WITH e AS ({EMB_UNNEST}), z AS (SELECT * FROM e),
mx AS (SELECT vec_id, max(x) AS m FROM z GROUP BY vec_id),
l AS (SELECT z.vec_id, any_value(z.label) AS label,
             any_value(mx.m) + ln(sum(exp(z.x - mx.m))) - sum(CASE WHEN z.pos = z.label THEN z.x ELSE 0 END) AS loss
      FROM z JOIN mx USING (vec_id) GROUP BY z.vec_id)
SELECT label, count(*) AS n, round(sum(loss), 6) AS sum_loss FROM l GROUP BY label""")
def d6_categorical_cross_entropy(spark, sf_dir):
    """Categorical cross-entropy from logits (all embedding positions vs the label)."""
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    loss = vec.cce_from_logits(prepare.label_onehot(F.col("label"), width), F.col("embedding"))
    return rounded(e.select("label", loss.alias("loss")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("sum_loss")), 6)


@register("d7_logistic_gradient", f"""
WITH {prepared_sql()},
train AS (SELECT * FROM prep WHERE is_test = 0),
bal AS {balanced_sql('train', BALANCE_SEED)},
g AS (SELECT label, {score_sql('p')}, f0, f1, f2, f3, f4, f5, f6, f7, f8,
             CASE WHEN label = 1 THEN 0.7 ELSE 0.3 END AS w FROM bal)
SELECT pos, round(sum(v), 6) AS grad_sum FROM (
  {' UNION ALL '.join(f"SELECT {i} AS pos, (p - label) * w * f{i} AS v FROM g" for i in range(9))}
  UNION ALL SELECT 9 AS pos, (p - label) * w AS v FROM g) GROUP BY pos""")
def d7_logistic_gradient(spark, sf_dir):
    """Per-row weighted logistic gradient (p - y) w [x, 1], summed over the balanced train set."""
    from dpframe.plans.q_flagship import BIAS, WEIGHTS
    prep = prepared_lineitem(spark, sf_dir).df
    bal = sample.downsample(prep.where("is_test = 0"), F.col("key"), "label", BALANCE_SEED)
    p = vec.logistic_score(F.col("features"), WEIGHTS, BIAS)
    g = vec.logistic_grad(F.col("features"), F.col("label"), p, weights.fixed_class_weight(F.col("label")))
    s = dpagg.vector_sum(bal.select(g.alias("g")), "g")
    return rounded(s.select(F.posexplode("sum").alias("pos", "grad_sum")).select(
        F.col("pos").cast("int").alias("pos"), "grad_sum"), 6)
