"""Findings of round 4: whole tables, and training that moves packed rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpframe.operators import train


def test_search_state_covers_every_customer(spark, tmp_path):
    """All customers' orders, whatever their keys, those without a customer in one file."""
    from dpframe.plans import catalog
    rows = [(c, 100 * i + c, s) for c in range(1, 24) for i, s in enumerate("FOPFFO")] + [(None, 7, "O"), (None, 9, "F")]
    spark.createDataFrame(rows, "o_custkey bigint, o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["s5_search_state"](spark, str(tmp_path)).collect()
    assert sorted((r["search"] or 0, int(r["trial_id"])) for r in got) == sorted((c or 0, o) for c, o, _ in rows)
    one = sorted((r["round"], r["position"], r["trial_id"], r["past_id"], r["run_times"], r["ended"]) for r in got if r["search"] == 3)
    assert one == [(0, 0, "3", None, 2, True), (0, 1, "103", None, 1, False), (0, 2, "203", None, 1, True), (0, 3, "303", None, 2, True),
                   (1, 0, "403", "303", 2, True), (1, 1, "503", "403", 1, False)]


def test_leaves_of_empty_and_scalar_files(spark, tmp_path):
    """A leaf on any level is handed on to the last one; empty objects and arrays have none."""
    from dpframe.sources import files
    for i, text in enumerate(('{"a": {}, "b": [], "c": null, "d": [1, [[]], [{"e": "{x}"}]]}', '"text"', "[]", "[[2]]")):
        (tmp_path / f"{i}.json").write_text(text)
    got = files.search_state_leaves(spark, str(tmp_path)).select(F.substring(F.element_at(F.split("file", "/"), -1), 1, 1), "path", "value").collect()
    assert sorted(map(tuple, got)) == [("0", "$.c", None), ("0", "$.d[0]", "1"), ("0", "$.d[2][0].e", "{x}"), ("1", "$", "text"), ("3", "$[0][0]", "2")]


def _one_by_one(keys, trials, epoch):
    """The draws of a row, one md5 after another."""
    out = {}
    for t, q, steps, epochs, seed in trials:
        out[t] = []
        for r, k in enumerate(keys):
            pos, j = -1, 0
            while epoch <= epochs:
                j += 1
                u = (int(hashlib.md5(f"{k}|e{epoch}|{j}|{seed}".encode()).hexdigest()[:13], 16)) / 2.0 ** 52
                pos += 1 + math.floor(math.log(1.0 - u) / (math.log1p(-q) if q < 1 else -math.inf))
                if pos >= steps:
                    break
                out[t].append((r, pos))
    return {t: sorted(v) for t, v in out.items() if v}


@pytest.mark.parametrize("side_by_side", [1 << 16, 300])
def test_draws_side_by_side_are_those_one_by_one(monkeypatch, side_by_side):
    """Keys of one to three md5 blocks and of any letters, seeds of two lengths, rate 1, many rows and few of a length."""
    monkeypatch.setattr(train, "HASHED", side_by_side)
    keys = [f"{i}-7" for i in range(1200)] + [f"é{i:03d}" + "x" * n for n in (40, 47, 52, 60, 110) for i in range(300)] + ["", "k", "y" * 500]
    trials = [(0, 0.01, 100, 2, "a"), (1, 0.3, 7, 2, "b"), (2, 1.0, 3, 2, "longer seed"), (3, 0.02, 60, 1, "c")]
    for epoch, members in ((1, 4), (12, 0), (2, 3)):
        got = {t: sorted(zip(r.tolist(), s.tolist())) for t, r, s in train._joined(keys, trials, epoch)}
        assert got == _one_by_one(keys, trials, epoch) and len(got) == members


def test_batches_go_to_blocks_packed_and_from_any_partitions(spark):
    """Records shuffled are blocks of arrays, not rows; results are the same from however many partitions."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"k{i}", [float(v) for v in rng.normal(size=3)], int(rng.random() < 0.4), 1.0 + i % 3) for i in range(800)],
                               "key string, features array<float>, label int, weight double")
    cfgs = [train.FitConfig(learning_rate=0.2, batch_size=8, epochs=2, seed=f"p{i}") for i in range(3)]
    held = train._held(df.select("key", "features", "label", "weight"), "key", 5)
    descents = [train._Descent(c, train.Logistic(3), c.seed, i) for i, c in enumerate(cfgs)]
    sent = train._Blocks(held, [(i, 0.01, 100, 2, c.seed) for i, c in enumerate(cfgs)], descents, 1).rows.collect()
    assert len(sent) <= 5 * 3 and sum(len(p[1]) for p in sent) > 1800 and all(p[2].dtype == np.float32 for p in sent)
    one = train.fit_grid(df, cfgs)
    many = train.fit_grid(df.repartition(11), cfgs)
    assert [r.steps for r in one] == [200] * 3 and all((a.params == b.params).all() for a, b in zip(one, many))
    alone = train.fit(df, train.FitConfig(**{**cfgs[0].__dict__, "noise_multiplier": 0.0}))
    grid = train.fit_grid(df, [train.FitConfig(**{**c.__dict__, "noise_multiplier": 0.0}) for c in cfgs])
    assert (alone.params == grid[0].params).all()


def test_noise_of_many_steps_is_that_of_each():
    assert (train.steps_noise("s", 4, range(3, 40), 9) == np.stack([train.step_noise("s", 4, k, 9) for k in range(3, 40)])).all()


def test_rows_are_sent_narrow_without_loss():
    for values, kind in (([0, 1, 1], np.int8), ([0.5, 300], np.float32), ([0.1], np.float64), ([1, np.nan], np.float64), ([1e300], np.float64)):
        x = np.array(values, np.float64)
        with np.errstate(all="ignore"):
            got = train._narrow(x)
        assert got.dtype == kind and np.array_equal(got.astype(np.float64), x, equal_nan=True)


def test_a_block_is_sorted_by_step_then_place_and_empty_steps_stay():
    """Packed rows of three places in any order; steps without rows, and a block without any."""
    part = lambda place, at, x, y: (place, np.array(at, np.uint8), np.array(x, np.float32).reshape(-1, 1), [np.array(y, np.int8)])
    parts = [part((1, 0), [0, 3], [5, 6], [1, 0]), part((0, 1), [3, 3], [3, 4], [1, 1]), part((0, 0), [3], [1], [0])]
    got = [(X[:, 0].tolist(), y.tolist(), w.tolist(), sq.tolist()) for X, y, w, _, sq in train._batches(iter(parts), 5, 1, False)]
    none = ([], [], [], [])
    assert got == [([5], [1], [1], [26]), none, none, ([1, 3, 4, 6], [0, 1, 1, 0], [1] * 4, [2, 10, 17, 37]), none]
    assert [len(b[1]) for b in train._batches(iter([]), 3, 2, False)] == [0, 0, 0]


def test_trials_that_share_a_task_train_as_alone(spark, monkeypatch):
    """More trials than three a core, of different batches and epochs, in blocks of a few steps."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"k{i}", [float(v) for v in rng.normal(size=2)], int(rng.random() < 0.5)) for i in range(120)],
                               "key string, features array<double>, label int")
    cfgs = [train.FitConfig(learning_rate=0.1, batch_size=4 + 4 * (i % 3), epochs=1 + i % 2, seed=f"t{i}") for i in range(3 * spark.sparkContext.defaultParallelism + 2)]
    monkeypatch.setattr(train, "BLOCK_ROWS", 60)
    shared = train.fit_grid(df, cfgs)
    monkeypatch.setattr(train, "TRIALS_PER_TASK", 1)
    alone = train.fit_grid(df, cfgs)
    assert [r.steps for r in shared] == [c.epochs * (120 // c.batch_size) for c in cfgs]
    assert all((a.params == b.params).all() for a, b in zip(shared, alone))
