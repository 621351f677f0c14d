"""Golden privacy budgets from recorded runs (tolerance 1e-8)."""

import pytest

from dpframe.functions.accountant import gdp_epsilon, gdp_mu, rdp_epsilon

GOLDEN = [
    ("gdp", 0.8, 17840, 1e-6, 1, 0.9813882215409355),
    ("gdp", 0.8, 17840, 1e-6, 2, 1.427410874905076),
    ("gdp", 0.8, 17840, 1e-6, 5, 2.3541081892502924),
    ("rdp", 0.8, 17840, 1 / 17840, 1, 2.697284866728885),
    ("rdp", 0.8, 17840, 1 / 17840, 5, 3.746858246031678),
    ("rdp", 1.2, 17840, 1 / 17840, 5, 1.491762904347858),
    ("rdp", 1.1, 17840, 1e-6, 1, 1.7240288462143087),
    ("rdp", 1.1, 17840, 1e-6, 5, 2.2694784239798564),
    ("rdp", 1.1, 4000, 1e-6, 5, 5.000092626595765),
]


@pytest.mark.parametrize("kind,sigma,n,delta,epochs,expected", GOLDEN)
def test_golden_epsilon(kind, sigma, n, delta, epochs, expected):
    if kind == "gdp":
        got = gdp_epsilon(gdp_mu(n, 256, epochs, sigma), delta)
    else:
        got = rdp_epsilon(n, 256, epochs, sigma, delta)
    assert got == pytest.approx(expected, abs=1e-8)


def test_budget_stop_at_epoch_5():
    from dpframe.operators.train import FitConfig, epsilon_schedule
    eps = epsilon_schedule(FitConfig(noise_multiplier=1.1, l2_norm_clip=1.0, batch_size=256, epochs=6,
                                     delta=1e-6), 4000)
    over = [i + 1 for i, e in enumerate(eps) if e > 5.0]
    assert over[0] == 5


def test_zero_noise_zero_epsilon():
    from dpframe.operators.train import FitConfig, epsilon_schedule
    assert epsilon_schedule(FitConfig(noise_multiplier=0.0, epochs=3), 1000) == [0.0, 0.0, 0.0]


def test_epsilon_columns(spark):
    from dpframe.functions import accountant as acc
    df = spark.createDataFrame([(0.8, 17840, 256, 5, 1 / 17840), (0.0, 17840, 256, 5, 1e-5)],
                               "noise_multiplier double, n long, batch_size long, epochs long, delta double")
    rows = {r["noise_multiplier"]: r["epsilon"] for r in acc.add_rdp_epsilon(df).collect()}
    assert rows[0.8] == pytest.approx(3.746858246031678, abs=1e-8)
    assert rows[0.0] == 0.0
    df2 = spark.createDataFrame([(0.8, 17840, 256, 5, 1e-6)],
                                "noise_multiplier double, n long, batch_size long, epochs long, delta double")
    assert acc.add_gdp_epsilon(df2).first()["epsilon"] == pytest.approx(2.3541081892502924, abs=1e-8)


def test_composition_of_unlike_mechanisms(spark):
    """One mechanism costs what A2 says, copies cost as many epochs, unlike ones less than the sum; no noise is counted apart."""
    import numpy as np

    from dpframe.functions import accountant as acc
    rows = [("one", 1.1, 17840, 256, 5.0), ("two", 1.1, 17840, 256, 2.0), ("two", 1.1, 17840, 256, 3.0),
            ("mix", 0.8, 17840, 256, 1.0), ("mix", 1.5, 10000, 128, 4.0), ("mix", 0.0, 10000, 128, 4.0), ("bare", 0.0, 100, 10, 1.0),
            (None, 1.2, 17840, 256, 5.0)]
    df = spark.createDataFrame(rows, "g string, noise_multiplier double, n int, batch_size int, epochs double")
    got = {r["g"]: (r["mechanisms"], r["unprotected"], r["epsilon"]) for r in acc.compose(df, ["g"], 1e-6).collect()}
    assert got["one"] == (1, 0, pytest.approx(2.2694784239798564, abs=1e-8)) and got["two"] == (2, 0, pytest.approx(got["one"][2], abs=1e-12))
    curve = sum(e * n / b * acc.rdp_subsampled_gaussian(b / n, s) for _, s, n, b, e in rows[3:5])
    want = float(np.min(curve - np.log(1e-6) / (np.asarray(acc.RDP_ORDERS) - 1)))
    assert got["mix"] == (2, 1, pytest.approx(want, abs=1e-12))
    assert want < sum(acc.rdp_epsilon(n, b, e, s, 1e-6) for _, s, n, b, e in rows[3:5])
    assert got["bare"] == (0, 1, 0.0) and got[None][0] == 1
    whole = acc.compose(df, [], 1e-6).first()
    assert whole["mechanisms"] == 6 and whole["epsilon"] > got["mix"][2]
