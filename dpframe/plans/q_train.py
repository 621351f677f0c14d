"""Queries for training (D8–D12, D14): private and non-private fits on lineitem.

Training input: the prepared lineitem (scaler/encoder fitted on train),
train part balanced by exact downsampling. Fits return their history as a
long table (run, epoch, step, metric, value), rows-only checks. Four steps
over two epochs (noisy SGD, momentum and Adam, non-private momentum and Adam,
weighted rows, a small net with microbatches, a run cut and resumed) and four
full-batch steps are checked exactly against SQL, which repeats batches,
microbatches and noise by hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpframe.operators import prepare, sample, train
from dpframe.plans.datasets import SEED, labelled_lineitem, reuse
from dpframe.plans.q_flagship import BALANCE_SEED, balanced_sql, prepared_lineitem, prepared_sql
from dpframe.plans.registry import register, rounded
from dpframe.session import checkpoint_dir

TRAIN_NUMERIC = ["l_extendedprice", "l_tax"]          # the label's own inputs are left out
TRAIN_CATEGORICAL = ["l_returnflag", "l_linestatus"]
FIT_SEED = 2024                                        # fixed for reproducible queries


def training_sets(spark: SparkSession, sf_dir: str):
    """(balanced train, test) with features from price, tax, flag and status (prepared once per session)."""
    return reuse(spark, ("training_sets", sf_dir), lambda: _training_sets(spark, sf_dir))


def _training_sets(spark: SparkSession, sf_dir: str):
    # kept like the other prepared table: both sets, and every pass that chooses the balanced rows, are read from it
    prep = reuse(spark, ("training_prepared", sf_dir), lambda: prepare.prepare_features(
        labelled_lineitem(spark, sf_dir), "label", F.col("key"), TRAIN_NUMERIC, TRAIN_CATEGORICAL,
        fit_on="train", test_size=0.2, seed=SEED, stratify=True))
    tr = prep.df.where("is_test = 0")
    te = prep.df.where("is_test = 1")
    bal = sample.downsample(tr, F.col("key"), "label", BALANCE_SEED)
    return bal, te


def _history(spark, res: train.FitResult, run: str) -> DataFrame:
    return rounded(train.history_frame(spark, res, run))


def _fit_query(cfg: train.FitConfig, run: str, evaluate: bool = True):
    def q(spark, sf_dir):
        bal, te = training_sets(spark, sf_dir)
        res = train.fit(bal, cfg, evaluate_on=te if evaluate else None)
        return _history(spark, res, run).where(F.col("key") != "epoch_seconds")
    return q


register("d8_dp_sgd_fit")(_fit_query(train.FitConfig(
    model="logistic", optimizer="sgd", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8,
    batch_size=256, epochs=15, accountant="rdp", seed=FIT_SEED), "dp_sgd"))

register("d9_dp_gaussian_fit")(_fit_query(train.FitConfig(
    model="logistic", optimizer="sgd", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8,
    batch_size=256, epochs=5, accountant="gdp", delta=1e-6, seed=FIT_SEED), "dp_gaussian"))

register("d10_dp_adam_fit")(_fit_query(train.FitConfig(
    model="logistic", optimizer="adam", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8,
    batch_size=256, epochs=5, seed=FIT_SEED), "dp_adam"))

register("d11_nonprivate_fit")(_fit_query(train.FitConfig(
    model="logistic", optimizer="momentum", learning_rate=0.05, l2_norm_clip=None, noise_multiplier=0.0,
    batch_size=256, epochs=30, l2_reg=1e-4, seed=FIT_SEED), "sgd_momentum"))

register("d11_full_batch_fit")(_fit_query(train.FitConfig(
    model="logistic", optimizer="sgd", learning_rate=0.25, l2_norm_clip=None, noise_multiplier=0.0,
    full_batch=True, epochs=30, l2_reg=1e-4, seed=FIT_SEED), "full_batch_gd"))

register("d11_nonprivate_adam_fit")(_fit_query(train.FitConfig(
    model="mlp", hidden=(128, 64), optimizer="adam", learning_rate=0.001, l2_norm_clip=None, noise_multiplier=0.0,
    batch_size=256, epochs=5, l2_reg=1e-4, seed=FIT_SEED), "adam_net"))

register("d12_mlp_dp_fit")(_fit_query(train.FitConfig(
    model="mlp", hidden=(128, 64), optimizer="sgd", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8,
    batch_size=256, epochs=5, microbatches=32, seed=FIT_SEED), "dp_mlp"))

register("d14_epoch_loop_with_budget")(_fit_query(train.FitConfig(
    model="logistic", optimizer="sgd", learning_rate=0.25, l2_norm_clip=1.1, noise_multiplier=1.1,
    batch_size=256, epochs=8, delta=1e-6, budget=5.0, seed=FIT_SEED), "dp_sgd_budget"))


# ------------------------------------------------------------------ exact one-step check

STEP_LR, STEP_CLIP, STEP_SEED = 0.25, 0.8, "step-check"


@register("d8_zero_noise_step", f"""
WITH {prepared_sql()},
train AS (SELECT * FROM prep WHERE is_test = 0),
bal AS {balanced_sql('train', BALANCE_SEED)},
n AS (SELECT count(*) AS n FROM bal),
b AS (SELECT bal.* FROM bal, n
      WHERE floor(ln(1.0 - CAST(('0x' || substr(md5(key || '|e1|1|{STEP_SEED}'), 1, 13))::BIGINT AS DOUBLE)
                                 / {float(1 << 52)!r}) / ln(1.0 - least(1.0, 256.0 / n.n))) = 0),
g AS (SELECT *, (0.5 - label) AS r,
             abs(0.5 - label) * sqrt(f0*f0 + f1*f1 + f2*f2 + f3*f3 + f4*f4 + f5*f5 + f6*f6 + f7*f7 + f8*f8 + 1.0) AS nrm FROM b),
c AS (SELECT *, r * CASE WHEN nrm > {STEP_CLIP!r} THEN {STEP_CLIP!r} / nrm ELSE 1.0 END AS rc FROM g)
SELECT pos, round(-{STEP_LR!r} * s / 256.0, 9) AS value FROM (
  {' UNION ALL '.join(f"SELECT {i} AS pos, sum(rc * f{i}) AS s FROM c" for i in range(9))}
  UNION ALL SELECT 9 AS pos, sum(rc) AS s FROM c) x""")
def d8_zero_noise_step(spark, sf_dir):
    """D8 with noise 0: parameters after one clipped step from zero (Poisson batch, step 0)."""
    prep = prepared_lineitem(spark, sf_dir).df
    bal = sample.downsample(prep.where("is_test = 0"), F.col("key"), "label", BALANCE_SEED)
    cfg = train.FitConfig(model="logistic", optimizer="sgd", learning_rate=STEP_LR, l2_norm_clip=STEP_CLIP,
                          noise_multiplier=0.0, batch_size=256, seed=STEP_SEED)
    return _parameters(spark, train.run_steps(bal, cfg, epochs=1, steps_per_epoch=1))


def _parameters(spark, params) -> DataFrame:
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(params)], "pos int, value double"))


# ------------------------------------------------------------------ exact steps with noise

WIDTH = 9                    # features of the prepared lineitem
STEP_EPOCHS, EPOCH_STEPS = 2, 2


def _draw_sql(step: int, i: int) -> str:
    """Standard normal of coordinate ``i`` at ``step`` (see ``train.step_noise``)."""
    h = f"md5('{STEP_SEED}||{step}|{i // 2}')"
    u1, u2 = (f"(CAST(('0x' || substr({h}, {at}, 13))::BIGINT AS DOUBLE) / {float(1 << 52)!r})" for at in (1, 14))
    return f"sqrt(-2.0 * ln(greatest({u1}, {2.0 ** -53!r}))) * {'sin' if i % 2 else 'cos'}({6.283185307179586!r} * {u2})"


def _update_sql(cfg: train.FitConfig, k: int, size: int) -> str:
    """Parameters (and moments) after step ``k`` from the gradient columns g0, g1, ... beside the old ones."""
    cols = []
    for i in range(size):
        if cfg.optimizer == "adam":
            m, v = f"({train.ADAM_B1!r} * m{i} + (1 - {train.ADAM_B1!r}) * g{i})", f"({train.ADAM_B2!r} * v{i} + (1 - {train.ADAM_B2!r}) * g{i} * g{i})"
            move = (f"({m} / (1 - pow({train.ADAM_B1!r}::DOUBLE, {k + 1}))) / "
                    f"(sqrt({v} / (1 - pow({train.ADAM_B2!r}::DOUBLE, {k + 1}))) + {train.ADAM_EPS!r}::DOUBLE)")
        else:
            m, v = (f"({train.MOMENTUM!r} * m{i} + g{i})", "0.0") if cfg.optimizer == "momentum" else ("0.0", "0.0")
            move = m if cfg.optimizer == "momentum" else f"g{i}"
        cols += [f"CAST(w{i} - {cfg.learning_rate!r} * {move} AS DOUBLE) AS w{i}", f"CAST({m} AS DOUBLE) AS m{i}", f"CAST({v} AS DOUBLE) AS v{i}"]
    return ", ".join(cols)


def _member_sql(cfg: train.FitConfig) -> str:
    """CTEs of the balanced rows ``bal`` and of ``member`` (key, step): who takes part in which step."""
    head = f"""{prepared_sql()},
train AS (SELECT * FROM prep WHERE is_test = 0),
bal AS MATERIALIZED {balanced_sql('train', BALANCE_SEED)}"""
    if cfg.full_batch:
        return head + f", member AS MATERIALIZED (SELECT key, s.step FROM bal, range({STEP_EPOCHS * EPOCH_STEPS}) s(step))"
    epochs = ", ".join(f"({e})" for e in range(1, STEP_EPOCHS + 1))
    draws = ", ".join(f"({j})" for j in range(1, EPOCH_STEPS + 1))
    return head + f""",
n AS (SELECT count(*) AS n FROM bal),
gaps AS (SELECT key, e, j, CASE WHEN n <= {cfg.batch_size} THEN 0 ELSE floor(ln(1.0 - CAST(('0x' || substr(
    md5(key || '|e' || e || '|' || j || '|{STEP_SEED}'), 1, 13))::BIGINT AS DOUBLE) / {float(1 << 52)!r}) / ln(1.0 - {float(cfg.batch_size)!r} / n)) END AS gap
  FROM bal, n, (VALUES {epochs}) ep(e), (VALUES {draws}) dr(j)),
places AS (SELECT key, e, sum(gap + 1) OVER (PARTITION BY key, e ORDER BY j) - 1 AS place FROM gaps),
member AS MATERIALIZED (SELECT key, (e - 1) * {EPOCH_STEPS} + place AS step FROM places WHERE place < {EPOCH_STEPS})"""


def _result_sql(ctes: list[str], cfg: train.FitConfig, size: int) -> str:
    last = STEP_EPOCHS * EPOCH_STEPS
    return f"""WITH {_member_sql(cfg)},
{', '.join(ctes)}
SELECT CAST(pos AS INTEGER) AS pos, round(value, 9) AS value FROM (
  {' UNION ALL '.join(f'SELECT {i} AS pos, w{i} AS value FROM p{last}' for i in range(size))}) x"""


def _steps_sql(cfg: train.FitConfig, weight: str = "1.0") -> str:
    """The first steps of a logistic fit, one block of CTEs a step: batch, clipped sum, noise, update."""
    size, clip = WIDTH + 1, cfg.l2_norm_clip
    ones = [f"f{i}" for i in range(WIDTH)] + ["1.0"]
    norm = " + ".join(f"f{i} * f{i}" for i in range(WIDTH)) + " + 1.0"
    state = ", ".join(f"CAST(0.0 AS DOUBLE) AS {c}{i}" for c in "wmv" for i in range(size))
    ctes = [f"p0 AS (SELECT {state})"]
    for k in range(STEP_EPOCHS * EPOCH_STEPS):
        z = " + ".join(f"w{i} * {x}" for i, x in enumerate(ones))
        factor = "1.0" if clip is None else f"CASE WHEN nrm > {clip!r} THEN {clip!r} / nrm ELSE 1.0 END"
        ctes.append(f"""r{k} AS (SELECT *, abs(r) * sqrt({norm}) AS nrm FROM (
  SELECT bal.*, (1.0 / (1.0 + exp(-({z}))) - label) * {weight} AS r FROM bal JOIN member USING (key) CROSS JOIN p{k} WHERE member.step = {k}) x)""")
        by = "greatest(count(*), 1)" if clip is None else repr(float(cfg.batch_size))
        noise = [f" + {clip * cfg.noise_multiplier!r} * {_draw_sql(k, i)}" if clip and cfg.noise_multiplier else "" for i in range(size)]
        sums = ", ".join(f"(coalesce(sum(r * ({factor}) * {x}), 0.0){noise[i]}) / {by} AS g{i}" for i, x in enumerate(ones))
        ctes.append(f"s{k} AS (SELECT {sums} FROM r{k})")
        reg = f" + {cfg.l2_reg!r} * w{{i}}" if cfg.l2_reg else ""
        grads = ", ".join(f"g{i}{reg.format(i=i)} AS g{i}" for i in range(size))
        ctes.append(f"g{k} AS (SELECT p{k}.*, {grads} FROM p{k} CROSS JOIN s{k})")
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT {_update_sql(cfg, k, size)} FROM g{k})")
    return _result_sql(ctes, cfg, size)


def _net_steps_sql(cfg: train.FitConfig) -> str:
    """The first steps of a two-layer net with microbatches: forward, backward, mean of each microbatch, clip, noise, update."""
    h1, h2, m = *cfg.hidden, cfg.microbatches
    net = train.MLP(WIDTH, cfg.hidden)
    size = net.size
    b1 = WIDTH * h1
    w2, b2 = b1 + h1, b1 + h1 + h1 * h2
    w3, b3 = b2 + h2, b2 + 2 * h2
    start = net.init(train.noise_stream(STEP_SEED, ""))
    state = ", ".join(f"'{v!r}'::DOUBLE AS w{i}, 0.0::DOUBLE AS m{i}, 0.0::DOUBLE AS v{i}" for i, v in enumerate(start.tolist()))
    ctes = [f"p0 AS MATERIALIZED (SELECT {state})"]
    first = ", ".join(f"greatest(0.0, {' + '.join(f'f{i} * w{i * h1 + j}' for i in range(WIDTH))} + w{b1 + j}) AS a{j}" for j in range(h1))
    second = ", ".join(f"greatest(0.0, {' + '.join(f'a{j} * w{w2 + j * h2 + k}' for j in range(h1))} + w{b2 + k}) AS b{k}" for k in range(h2))
    top = f"1.0 / (1.0 + exp(-({' + '.join(f'b{k} * w{w3 + k}' for k in range(h2))} + w{b3}))) - label AS dz"
    down2 = ", ".join(f"CASE WHEN b{k} > 0 THEN dz * w{w3 + k} ELSE 0.0 END AS e{k}" for k in range(h2))
    down1 = ", ".join(f"CASE WHEN a{j} > 0 THEN {' + '.join(f'e{k} * w{w2 + j * h2 + k}' for k in range(h2))} ELSE 0.0 END AS d{j}" for j in range(h1))
    grads = ([f"f{i} * d{j}" for i in range(WIDTH) for j in range(h1)] + [f"d{j}" for j in range(h1)]
             + [f"a{j} * e{k}" for j in range(h1) for k in range(h2)] + [f"e{k}" for k in range(h2)] + [f"b{k} * dz" for k in range(h2)] + ["dz"])
    for k in range(STEP_EPOCHS * EPOCH_STEPS):
        micro = f"floor(CAST(('0x' || substr(md5(key || '|m|{k}|{STEP_SEED}'), 1, 13))::BIGINT AS DOUBLE) / {float(1 << 52)!r} * {m})"
        ctes.append(f"""r{k} AS (SELECT *, {down1} FROM (SELECT *, {down2} FROM (SELECT *, {top} FROM (SELECT *, {second} FROM (
  SELECT bal.*, p{k}.*, {micro} AS mb, {first} FROM bal JOIN member USING (key) CROSS JOIN p{k} WHERE member.step = {k}) x1) x2) x3) x4)""")
        ctes.append(f"u{k} AS (SELECT mb, {', '.join(f'avg({g}) AS q{i}' for i, g in enumerate(grads))} FROM r{k} GROUP BY mb)")
        norm = f"sqrt({' + '.join(f'q{i} * q{i}' for i in range(size))})"
        ctes.append(f"c{k} AS (SELECT *, CASE WHEN {norm} > {cfg.l2_norm_clip!r} THEN {cfg.l2_norm_clip!r} / {norm} ELSE 1.0 END AS fac FROM u{k})")
        sums = ", ".join(f"(coalesce(sum(q{i} * fac), 0.0) + {cfg.l2_norm_clip * cfg.noise_multiplier!r} * {_draw_sql(k, i)}) / {m} AS g{i}" for i in range(size))
        ctes.append(f"g{k} AS (SELECT p{k}.*, s.* FROM p{k} CROSS JOIN (SELECT {sums} FROM c{k}) s)")
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT {_update_sql(cfg, k, size)} FROM g{k})")
    return _result_sql(ctes, cfg, size)


def _steps_query(cfg: train.FitConfig, weight: str | None = None, cut: bool = False):
    def q(spark, sf_dir):
        prep = prepared_lineitem(spark, sf_dir).df
        bal = sample.downsample(prep.where("is_test = 0"), F.col("key"), "label", BALANCE_SEED)
        if weight is not None:
            bal = bal.withColumn("weight", F.expr(weight))
        shape = (STEP_EPOCHS * EPOCH_STEPS, 1) if cfg.full_batch else (STEP_EPOCHS, EPOCH_STEPS)
        if not cut:
            return _parameters(spark, train.run_steps(bal, cfg, *shape))
        state = f"{checkpoint_dir(spark)}/training-{uuid.uuid4().hex}"
        train.run_steps(bal, cfg, 1, EPOCH_STEPS, state=state)                # ends after its first epoch
        return _parameters(spark, train.run_steps(bal, cfg, *shape, state=state))
    return q


for _name, _cfg in {
    "d8_noisy_sgd_steps": train.FitConfig(optimizer="sgd", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8, seed=STEP_SEED),
    "d10_noisy_adam_steps": train.FitConfig(optimizer="adam", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8, seed=STEP_SEED),
    "d8_noisy_momentum_steps": train.FitConfig(optimizer="momentum", learning_rate=0.05, l2_norm_clip=1.2, noise_multiplier=1.1, seed=STEP_SEED),
    "d11_nonprivate_momentum_steps": train.FitConfig(optimizer="momentum", learning_rate=0.05, l2_norm_clip=None, noise_multiplier=0.0,
                                                     l2_reg=1e-4, seed=STEP_SEED),
    "d11_nonprivate_adam_steps": train.FitConfig(optimizer="adam", learning_rate=0.01, l2_norm_clip=None, noise_multiplier=0.0,
                                                 l2_reg=1e-4, seed=STEP_SEED),
    "d11_full_batch_gd_steps": train.FitConfig(optimizer="sgd", learning_rate=0.25, l2_norm_clip=None, noise_multiplier=0.0,
                                               l2_reg=1e-4, full_batch=True, seed=STEP_SEED),
    "d11_full_batch_adam_steps": train.FitConfig(optimizer="adam", learning_rate=0.05, l2_norm_clip=None, noise_multiplier=0.0,
                                                 l2_reg=1e-4, full_batch=True, seed=STEP_SEED),
}.items():
    register(_name, _steps_sql(_cfg))(_steps_query(_cfg))

#: Weight of the rare label's rows, as in the weighted fits.
WEIGHT = "CASE WHEN label = 1 THEN 3.0 ELSE 0.5 END"
_weighted = train.FitConfig(optimizer="momentum", learning_rate=0.05, l2_norm_clip=0.8, noise_multiplier=0.8, seed=STEP_SEED)
register("d8_weighted_steps", _steps_sql(_weighted, WEIGHT))(_steps_query(_weighted, f"double({WEIGHT})"))

_resumed = train.FitConfig(optimizer="adam", learning_rate=0.25, l2_norm_clip=0.8, noise_multiplier=0.8, seed=STEP_SEED)
register("d14_resumed_steps", _steps_sql(_resumed))(_steps_query(_resumed, cut=True))

_net = train.FitConfig(model="mlp", hidden=(3, 2), optimizer="sgd", learning_rate=0.25, l2_norm_clip=0.3, noise_multiplier=0.8,
                       batch_size=256, microbatches=32, seed=STEP_SEED)
register("d12_net_microbatch_steps", _net_steps_sql(_net))(_steps_query(_net))
