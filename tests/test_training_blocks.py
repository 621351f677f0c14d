"""Blocks of training steps: few jobs whatever the steps, the same results as one job a step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpframe.operators import train
from tests.test_dpagg_and_train import _toy


def _jobs(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = work()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_steps(spark):
    df, _, _ = _toy(spark)
    cfg = train.FitConfig(learning_rate=0.1, batch_size=4, epochs=1, seed="jobs")
    _, few = _jobs(spark, "fit", lambda: train.fit(df, cfg))                          # 150 steps
    res, grid = _jobs(spark, "grid", lambda: train.fit_grid(df, [cfg, train.FitConfig(**{**cfg.__dict__, "batch_size": 8})]))
    assert few < 20 and grid < 20 and [r.steps for r in res] == [150, 75]


@pytest.mark.parametrize("kind", [dict(optimizer="adam", l2_norm_clip=0.7), dict(model="mlp", hidden=(4, 3), microbatches=4, optimizer="momentum"),
                                  dict(l2_norm_clip=None, noise_multiplier=0.0, l2_reg=1e-3)])
def test_blocks_equal_single_steps(spark, monkeypatch, kind):
    """Blocks of two steps, one block, and one job a step; steps without a row still add their noise."""
    df, _, _ = _toy(spark, n=60)
    df = df.withColumn("weight", F.expr("CASE WHEN label = 1 THEN 2.0D ELSE 0.5D END"))
    cfg = train.FitConfig(**{**dict(learning_rate=0.1, batch_size=4, epochs=2, seed="b"), **kind})
    whole = train.fit(df, cfg)
    monkeypatch.setattr(train, "BLOCK_ROWS", 8)
    cut = train.fit(df, cfg)
    monkeypatch.setattr(train, "SPREAD_FROM", 0)
    single = train.fit(df, cfg)
    assert whole.steps == cut.steps == single.steps == 30
    assert cut.params == pytest.approx(whole.params, abs=1e-12) and single.params == pytest.approx(whole.params, abs=1e-9)
    strip = lambda r: [(h["epoch"], h["step"], h["metric"], round(h["value"], 9)) for h in r.history if h["metric"] != "epoch_seconds"]
    assert strip(cut) == strip(whole) == strip(single)


def test_rows_join_the_same_steps_by_either_draw(spark):
    df, _, _ = _toy(spark)
    trials = [(0, 0.2, 30, 2, "x"), (1, 1.0, 5, 2, "y"), (2, 0.01, 50, 1, "z")]
    for epoch in (1, 2):
        rows, held = train.poisson_schedules(df.select("key"), "key", trials, epoch=epoch)
        want = {(r["key"], r["_trial"], r["_local"]) for r in rows.collect()}
        got = df.select("key", train._memberships("key", trials, epoch).alias("m")).select("key", "m.trial", "m.local").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
        assert ({r["trial"] for r in got} == {0, 1, 2}) == (epoch == 1)


def test_noise_bits_are_the_same_as_before(spark):
    import hashlib
    h = [int.from_bytes(hashlib.md5(f"s|t|3|{j}".encode()).digest(), "big") for j in range(5)]
    u1, u2 = np.array([x >> 76 for x in h]) / 2.0 ** 52, np.array([(x >> 24) & ((1 << 52) - 1) for x in h]) / 2.0 ** 52
    want = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
    assert train.step_noise("s", "t", 3, 10)[::2] == pytest.approx(want, abs=1e-15)
