"""Clipped sums (golden), noise properties, one training step against a direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpframe.operators import dpagg, train
from tests.conftest import SF01


def test_clipped_sum_golden(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    s = dpagg.noisy_sum(e, "embedding", 0.5, 0.0, ["label"], "t").where("label = 0 AND pos < 3").orderBy("pos")
    got = [r["sum"] for r in s.collect()]
    assert got == pytest.approx([0.21385300825694015, 0.36415844536583153, 0.4279949289670984], abs=1e-12)


def test_noise_once_per_cell_and_variance(spark):
    df = spark.range(20000).select(F.col("id").alias("g"), F.array(F.lit(0.0)).alias("v"))
    out = dpagg.noisy_sum(df, "v", 1.0, 2.0, ["g"], "seed-x").select("noisy_sum").collect()
    z = np.array([r[0] for r in out])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 2.0) < 0.1
    again = dpagg.noisy_sum(df.repartition(3), "v", 1.0, 2.0, ["g"], "seed-x").orderBy("g").select("noisy_sum").collect()
    first = dpagg.noisy_sum(df, "v", 1.0, 2.0, ["g"], "seed-x").orderBy("g").select("noisy_sum").collect()
    assert [r[0] for r in again] == [r[0] for r in first]


def _toy(spark, n=600, d=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = (X[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(str(i), X[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, features array<double>, label int"), X, y


def test_one_zero_noise_step_matches_numpy(spark):
    df, X, y = _toy(spark)
    cfg = train.FitConfig(model="logistic", learning_rate=0.5, l2_norm_clip=0.7, noise_multiplier=0.0,
                          batch_size=64, seed="s1")
    got = train.run_steps(df, cfg, 1, 1)
    q = 64 / len(y)
    sched = train.poisson_schedule(df, "key", q, len(y) // 64, 1, "s1")
    members = sched.where("step = 0").select("key").collect()
    idx = np.array([int(r[0]) for r in members])
    r = 0.5 - y[idx]
    nrm = np.abs(r) * np.sqrt((X[idx] ** 2).sum(1) + 1)
    f = np.minimum(1.0, 0.7 / nrm)
    g = np.concatenate([X[idx].T @ (r * f), [(r * f).sum()]]) / 64
    assert got == pytest.approx(-0.5 * g, abs=1e-12)
    sql = train.run_steps(df, train.FitConfig(**{**cfg.__dict__, "step_engine": "sql"}), 1, 1)
    assert sql == pytest.approx(got, abs=1e-12)


def test_step_noise_is_normal_and_its_own_for_each_step_and_trial():
    z = train.step_noise("s", 0, 0, 20001)
    assert len(z) == 20001 and abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    assert abs(np.corrcoef(z[:-1:2], z[1::2])[0, 1]) < 0.03
    firsts = {train.step_noise(*a, 1)[0] for a in [("s", 0, 0), ("s", 0, 1), ("s", 1, 0), ("s2", 0, 0)]}
    assert len(firsts) == 4 and train.step_noise("s", 0, 0, 3) == pytest.approx(z[:3])


def test_grid_and_single_fit_average_alike_without_clipping(spark):
    df, X, y = _toy(spark)
    cfg = train.FitConfig(learning_rate=0.1, l2_norm_clip=None, noise_multiplier=0.0, batch_size=64, epochs=1, seed="g")
    assert train.fit_grid(df, [cfg])[0].params == pytest.approx(train.fit(df, cfg).params, abs=1e-12)
    with pytest.raises(ValueError):
        train.fit_grid(df, [train.FitConfig(microbatches=8)])


def test_nonprivate_fit_learns_and_mlp_runs(spark):
    df, X, y = _toy(spark)
    res = train.fit(df, train.FitConfig(model="logistic", optimizer="momentum", learning_rate=0.1, l2_norm_clip=None,
                                        noise_multiplier=0.0, batch_size=64, epochs=3, seed=1), evaluate_on=df)
    auroc = [h["value"] for h in res.history if h["metric"] == "auroc"]
    assert auroc[-1] > 0.9
    mlp = train.fit(df, train.FitConfig(model="mlp", hidden=(8, 4), optimizer="adam", learning_rate=0.01,
                                        l2_norm_clip=1.0, noise_multiplier=0.5, batch_size=64, epochs=1,
                                        microbatches=8, seed=2))
    assert mlp.steps > 0 and np.isfinite(mlp.params).all()
    with pytest.raises(ValueError):
        train.fit(df, train.FitConfig(optimizer="rmsprop"))


def test_mlp_clipped_sum_matches_per_example_loop():
    m = train.MLP(4, (5, 3))
    rng = np.random.default_rng(0)
    p = m.init(rng) + 0.1
    X, y, w = rng.normal(size=(9, 4)), (rng.random(9) > 0.5).astype(float), np.ones(9)
    fast = m.clipped_sum(p, X, y, w, 0.3)
    slow = np.zeros(m.size)
    for i in range(9):
        g = m.gradient_sum(p, X[i:i + 1], y[i:i + 1], w[i:i + 1])
        n = np.linalg.norm(g)
        slow += g * min(1.0, 0.3 / n)
    assert fast == pytest.approx(slow, abs=1e-12)


def test_grid_fit_equals_single_fit(spark):
    df, _, _ = _toy(spark)
    cfg = train.FitConfig(model="logistic", learning_rate=0.3, l2_norm_clip=0.8, noise_multiplier=0.0,
                          batch_size=64, epochs=1, seed="same")
    one = train.fit(df, cfg)
    many = train.fit_grid(df, [cfg, train.FitConfig(**{**cfg.__dict__, "learning_rate": 0.1})])
    assert many[0].params == pytest.approx(one.params, abs=1e-12)


def test_schedule_matches_bernoulli_rate(spark):
    df, _, _ = _toy(spark, n=4000)
    sched = train.poisson_schedule(df, "key", 0.05, 20, 3, "rate", draws=2)
    per_step = [r[1] for r in sched.groupBy("step").count().collect()]
    assert len(per_step) == 60
    assert abs(sum(per_step) / 60 - 200) < 15
    # rows that need more than one round of draws are continued, not cut off
    multi = sched.groupBy("key", "epoch").count().where("count > 2").count()
    assert multi > 0


def test_large_step_is_spread_and_kept_whole(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.lit(0).cast("long").alias("step"))
    out = train._by_step(rows, 4, "key").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in out]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000


@pytest.mark.parametrize("model", ["logistic", "mlp"])
def test_microbatch_means_do_not_depend_on_partitions_or_batches(spark, model):
    """Means of whole microbatches are clipped, whatever the partitions and Arrow batches; equal to a plain loop."""
    df, X, y = _toy(spark, n=400)
    cfg = train.FitConfig(model=model, hidden=(4, 3), l2_norm_clip=0.05, microbatches=8, batch_size=400, seed="m")
    net = train.make_model(cfg, 5)
    params = net.init(train.noise_stream("m")) + 0.05
    rows = df.withColumn("_micro", train._micro_id(F.col("key"), 3, 8, "m"))
    micro = {r["key"]: r["_micro"] for r in rows.select("key", "_micro").collect()}
    want = np.zeros(net.size)
    for b in range(8):
        mine = np.array([micro[str(i)] == b for i in range(400)])
        g = net.gradient_sum(params, X[mine], y[mine].astype(float), np.ones(mine.sum())) / mine.sum()
        want += g * min(1.0, 0.05 / np.linalg.norm(g))
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, batch in ((1, 10_000), (4, 10_000), (7, 10_000), (1, 100), (4, 100), (200, 10_000)):
            spark.conf.set(key, str(batch))
            g, _, n = train._numpy_step(rows.repartition(parts), net, params, cfg, "_micro", parts)
            assert n == 400 and g == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set(key, old)
    if model == "logistic":
        assert train._logistic_step(rows.repartition(4), net, params, cfg, "_micro", 4)[0] == pytest.approx(want, abs=1e-12)


def test_many_partial_sums_are_reduced_in_spark(spark):
    df, X, y = _toy(spark)
    cfg = train.FitConfig(l2_norm_clip=0.7, seed="r")
    net = train.make_model(cfg, 5)
    few, many = (train._numpy_step(df.repartition(k), net, np.full(6, 0.1), cfg, None, k) for k in (3, 100))
    assert few[0] == pytest.approx(many[0], abs=1e-12) and few[2] == many[2] == 600


def test_cut_run_ends_with_the_same_parameters(spark, tmp_path):
    """A run that ends after two of four epochs and goes on from its table: parameters, moments, steps, budget, history."""
    df, _, _ = _toy(spark)
    cfg = train.FitConfig(model="logistic", optimizer="adam", learning_rate=0.1, batch_size=64, epochs=4, seed="cut")
    whole = train.fit(df, cfg, evaluate_on=df)
    state = str(tmp_path / "state")
    train.fit(df, train.FitConfig(**{**cfg.__dict__, "epochs": 2}), evaluate_on=df, state=state)
    rest = train.fit(df, cfg, evaluate_on=df, state=state)
    assert rest.params == pytest.approx(whole.params, abs=1e-12) and rest.steps == whole.steps and rest.epsilon == whole.epsilon
    strip = lambda h: sorted((x["epoch"], x["metric"], round(x["value"], 9)) for x in h if x["metric"] != "epoch_seconds")
    assert strip(rest.history) == strip(whole.history)
    again = train.fit(df, cfg, state=state)                       # all epochs are there: nothing is run
    assert again.params == pytest.approx(whole.params, abs=1e-12) and again.steps == whole.steps
    other = train.fit(df, train.FitConfig(**{**cfg.__dict__, "learning_rate": 0.2, "epochs": 1}), state=state)
    assert other.steps == whole.steps // 4                         # another configuration is another run
    kept = spark.read.parquet(state)
    assert kept.count() == 5 and cfg.seed not in str(kept.collect())


def test_private_runs_report_no_exact_losses(spark):
    df, _, _ = _toy(spark)
    cfg = train.FitConfig(batch_size=64, epochs=1, seed="p")
    assert "batch_loss" not in {h["metric"] for h in train.fit(df, cfg).history}


def test_full_batch_descent_reaches_spark_logistic_regression(spark):
    """Adam over all rows against Spark's own solver, with the same L2 term on the coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    df, X, y = _toy(spark)
    cfg = train.FitConfig(optimizer="adam", learning_rate=0.3, l2_norm_clip=None, noise_multiplier=0.0, full_batch=True, epochs=120, seed="f")
    res = train.fit(df, cfg)
    assert res.steps == 120
    lr = LogisticRegression(regParam=0.0, standardization=False, tol=1e-10, maxIter=300).fit(
        df.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))
    want = np.append(lr.coefficients.toArray(), lr.intercept)
    assert res.params == pytest.approx(want, rel=0.05, abs=0.05)


def test_grid_takes_weights_and_holds_features_once(spark):
    df, _, _ = _toy(spark)
    df = df.withColumn("weight", F.expr("CASE WHEN label = 1 THEN 2.0D ELSE 0.5D END"))
    cfg = train.FitConfig(learning_rate=0.3, noise_multiplier=0.0, batch_size=64, epochs=2, seed="w")
    cfgs = [train.FitConfig(**{**cfg.__dict__, "epochs": e, "batch_size": b}) for e, b in ((2, 64), (1, 64), (2, 32))]
    for got, c in zip(train.fit_grid(df, cfgs), cfgs):
        assert got.params == pytest.approx(train.fit(df, c).params, abs=1e-12)
    trials = [(i, 0.3, 4, 1, f"s{i}") for i in range(30)]
    sched = train._epoch_batches(df, "key", trials, 1, 4)
    assert sched.rows.count() <= 600 and sched.rows.columns == ["features", "label", "weight", "at"]
    want = sum(train.poisson_schedule(df, "key", 0.3, 4, 1, f"s{i}").count() for i in range(3))
    got = sched.rows.select(F.explode(F.flatten(F.map_values("at"))).alias("t")).where("t < 3").count()
    sched.remove()
    assert got == want


def test_private_keys_bound_users_and_hide_rare_keys(spark):
    """Keys of few users stay hidden, popular ones show; a user's many keys count as at most the bound."""
    rows = [(u, k, 1.0) for u in range(300) for k in ("x", "y")] + [(u, f"own{u}", 5.0) for u in range(300)] + \
           [(7, f"many{i}", 1.0) for i in range(500)] + [(None, "x", 1.0), (5, None, 1.0)]
    ev = spark.createDataFrame(rows, "u int, k string, v double")
    kept = dpagg.bounded_keys(ev, "u", "k", "v", 3, "s")
    assert kept.groupBy("u").count().agg(F.max("count")).first()[0] == 3
    shown = {r["k"]: r["noisy_users"] for r in dpagg.private_keys(ev, "u", "k", 1.0, 1e-6, 3, "s").collect()}
    assert set(shown) == {"x", "y"} and all(abs(v - 300) < 60 for v in shown.values())
    sums = dpagg.private_key_sums(ev, "u", "k", "v", 1.0, 0.5, 1.0, 1e-6, 3, "s")
    assert sums.columns == ["k", "noisy_users", "noisy_sum", "noisy_mean"]
    got = {r["k"]: r["noisy_sum"] for r in sums.collect()}
    assert set(got) == {"x", "y"} and all(abs(v - 300 / 2 ** 0.5) < 5 for v in got.values())
    # a key of one user passes with probability delta: its noise must reach threshold - 1
    tau = dpagg.key_threshold(2.0, 1e-3, 1)
    assert 0.5 * np.exp(-(tau - 1) * 2.0) == pytest.approx(1e-3, rel=1e-9)
    z = [r[0] for r in spark.range(20000).select(dpagg.laplace("q", F.col("id"))).collect()]
    assert abs(np.mean(z)) < 0.04 and abs(np.mean(np.abs(z)) - 1) < 0.04
