"""Failed trials, null groups, one-class groups, seeds and accounting beyond the driver data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpframe.functions import accountant as acc
from dpframe.operators import dpagg, evaluate, experiments as ex, train, weights

TRIALS = [("t1", None), ("t2", float("nan")), ("t3", 0.79555), ("t4", 0.79777), ("t5", 0.80036), ("t6", 0.80036), ("t7", -0.5),
          ("t8", 0.0), ("t9", 1e-9)]


@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame([("b", t, v) for t, v in TRIALS], "bracket string, trial string, score double")


def test_failed_trials_never_win(trials):
    assert ex.best_trial(trials, "score", "trial").first()["trial"] == "t7"
    assert ex.best_overall(trials, "score", "trial").first()["trial"] == "t5"
    assert [r["trial"] for r in ex.top_results(trials, "score", "trial", 2).collect()] == ["t7", "t8"]
    hist = trials.withColumn("step", F.lit(1))
    assert ex.best_epoch(hist, ["bracket"], "score", "step", ["trial"]).first()["trial"] == "t7"


def test_halving_orders_by_the_whole_score(trials, spark):
    two = trials.unionByName(trials.withColumn("bracket", F.lit("c")))
    kept = ex.successive_halving(two, "bracket", "score", "trial", factor=3)
    assert sorted(r["trial"] for r in kept.where("bracket = 'c' AND round = 1").collect()) == ["t4", "t5", "t6"]


def test_groups_with_nulls_draw_their_own_noise(spark):
    df = spark.createDataFrame([(None, "a", [0.0]), ("a", None, [0.0])], "x string, y string, v array<double>")
    rows = dpagg.noisy_sum(df, "v", 1.0, 1.0, ["x", "y"], "s").collect()
    assert len({r["noisy_sum"] for r in rows}) == 2 and "sum" not in rows[0].asDict()


def test_one_class_group_has_no_auc(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("b", 1, 0.9), ("b", 0, 0.1)], "g string, label int, p double")
    got = {r["g"]: r["roc_auc"] for r in evaluate.exact_auc(df, "label", "p", by=["g"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_noise_streams_differ():
    draws = [train.noise_stream("grid-0.5-0.8-1.0").normal(), train.noise_stream("grid-0.5-0.8-1.1").normal(),
             train.noise_stream("grid-0.5-0.8-1.1", 2).normal()]
    assert len(set(draws)) == 3 and train.noise_stream("a").normal() == train.noise_stream("a").normal()


def test_batch_above_rows_accounts_the_steps_run(spark):
    whole = acc.rdp_epsilon(100, 100, 5, 1.0, 1e-2)
    assert acc.rdp_epsilon(100, 256, 5, 1.0, 1e-2) == pytest.approx(whole)
    assert acc.gdp_mu(100, 256, 5, 1.0) == pytest.approx(acc.gdp_mu(100, 100, 5, 1.0))
    df = spark.createDataFrame([(1.0, 100, 256, 5, 1e-2)], "noise_multiplier double, n long, batch_size int, epochs int, delta double")
    assert acc.add_rdp_epsilon(df).first()["epsilon"] == pytest.approx(whole, rel=1e-6)
    cfg = dict(noise_multiplier=1.0, l2_norm_clip=1.0, batch_size=64, epochs=1, delta=1e-5)
    assert train.epsilon_schedule(train.FitConfig(microbatches=8, **cfg), 1000)[0] \
        == pytest.approx(train.epsilon_schedule(train.FitConfig(**(cfg | {"noise_multiplier": 0.5})), 1000)[0])


def test_blend_clamps_either_class(spark):
    pair = spark.createDataFrame([(0.5, 50.0, 1.0, 1.0), (50.0, 0.5, 1.0, 1.0), (1.0, 1.2, 1.0, 1.0)],
                                 "orig0 double, orig1 double, post0 double, post1 double")
    got = np.array([tuple(r) for r in weights.blended_weights(pair).collect()])
    assert got == pytest.approx(np.array([[0.75, 2.25], [2.25, 0.75], [1.0, 1.1]]))


def test_wide_category_positions(spark):
    from dpframe.operators import prepare
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    index = prepare.category_index(df.where("v <> 'c' OR v IS NULL"), "v")
    got = sorted(((r["v"], r["position"]) for r in prepare.onehot_position(df, "v", index).collect()), key=str)
    assert got == sorted([("b", 1), ("a", 0), (None, None), ("c", None), ("a", 0)], key=str)
    assert prepare.category_index(df.limit(0), "v").count() == 0
