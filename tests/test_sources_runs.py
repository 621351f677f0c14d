"""Run-store layouts, de-duplication and durations (golden values from recorded runs)."""

import pytest
from pyspark.sql import functions as F

from dpframe.operators import experiments as ex, runs
from dpframe.sources import files

STAMPS = [1760047138136, 1760047173026, 1760047207074, 1760047241870, 1760047276495]
ACC5 = 0.7708116769790649


def _write(tmp, rel, text):
    p = tmp / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_reference_layout_scan_dedupe_duration(spark, tmp_path):
    acc = "".join(f"{STAMPS[i]} {0.7 + i / 100 if i < 4 else ACC5} {i + 1}\n" * 2 for i in range(5))
    _write(tmp_path, "1/abc123/metrics/accuracy", acc)
    _write(tmp_path, "1/abc123/metrics/epsilon", "".join(f"{t} {i} {i + 1}\n" for i, t in enumerate(STAMPS)))
    _write(tmp_path, "1/abc123/params/noise_multiplier", "0.8")
    m = files.read_metrics(spark, f"{tmp_path}/1/*/metrics")
    assert m.where("key = 'accuracy'").count() == 10
    hist = m.withColumn("ts", F.timestamp_millis("ts_ms")).withColumn("event_id", F.col("ts_ms"))
    d = runs.dedupe(hist).where("key = 'accuracy'")
    assert d.count() == 5
    assert d.where("step = 5").first()["value"] == ACC5
    dur = runs.epoch_durations(runs.dedupe(hist).where("key = 'epsilon'")).orderBy("step").collect()
    assert [round(r["seconds"], 3) for r in dur] == [34.890, 34.048, 34.796, 34.625]
    p = files.read_params(spark, f"{tmp_path}/1/*/params").first()
    assert (p["run_id"], p["key"], p["value"]) == ("abc123", "noise_multiplier", "0.8")


def test_grid_sizes_and_sensitivity(spark):
    assert ex.grid(spark, ex.DP_GRID).count() == 81
    assert ex.grid(spark, ex.NONPRIVATE_GRID).count() == 216
    assert ex.sensitivity_grid(spark).count() == 15


def test_successive_halving_sizes(spark):
    rows = [(f"t{i:02d}", "2", float(i)) for i in range(12)] + [(f"u{i}", "1", float(i)) for i in range(6)] + \
           [(f"v{i}", "0", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "trial string, bracket string, score double")
    sh = ex.successive_halving(df, "bracket", "score", "trial")
    got = {(r[0], r[1]): r[2] for r in sh.groupBy("bracket", "round").count().collect()}
    assert got == {("0", 0): 4, ("1", 0): 6, ("1", 1): 2, ("2", 0): 12, ("2", 1): 4, ("2", 2): 2}
    top = sorted(r[0] for r in sh.where("bracket = '2' AND round = 2").select("trial").collect())
    assert top == ["t10", "t11"]


def test_reduce_lr_on_plateau(spark):
    vals = [1.0, 0.9, 0.95, 0.96, 0.97, 0.98, 0.99, 1.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run_id int, step int, value double")
    lr = [r["learning_rate"] for r in ex.reduce_lr_on_plateau(df, ["run_id"], patience=3, lr0=1e-3)
          .orderBy("step").collect()]
    assert lr == pytest.approx([1e-3] * 5 + [5e-4] * 3)


def plain_rates(values, lr0=1e-3, factor=0.5, patience=3, min_lr=1e-6, min_delta=1e-4):
    best, wait, lr, out = float("inf"), 0, lr0, []
    for v in values:
        out.append(lr)
        if v is not None and v == v and v < best - min_delta:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience:
                lr, wait = min(lr, max(lr * factor, min_lr)), 0
    return out


def test_plateau_of_long_runs_equals_a_plain_fold_and_is_spread(spark):
    """Runs cut into many ranges: falling, noisy, flat and rising series, nulls, NaN, drops smaller than the least one."""
    import numpy as np
    rng = np.random.default_rng(4)
    n = 400
    series = {
        "fall": np.linspace(1, 0, n), "tiny": 1 - np.arange(n) * 3e-5, "noise": rng.random(n),
        "walk": 1 + np.cumsum(rng.normal(size=n)) * 1e-4, "flat": np.ones(n), "rise": np.linspace(0, 1, n),
        "late": np.concatenate([[np.nan] * 9, 1 - np.sqrt(np.arange(n - 9)) * 2e-4]), "inf": np.where(rng.random(n) < 0.1, np.inf, rng.random(n)),
    }
    rows = [(k, i, None if i % 50 == 7 else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [(None, i, 1.0 - i * 1e-3) for i in range(6)]
    df = spark.createDataFrame(rows, "run_id string, step int, value double").repartition(5)
    got = {}
    for r in ex.reduce_lr_on_plateau(df, ["run_id"], patience=3, chunks=23).orderBy("step").collect():
        got.setdefault(r["run_id"], []).append(r["learning_rate"])
    for k in [*series, None]:
        assert got[k] == pytest.approx(plain_rates([r[2] for r in rows if r[0] == k]), rel=1e-12), k
    one = spark.range(6000).selectExpr("'r' run_id", "cast(id as int) step", "cast(id % 97 as double) value")
    from dpframe.operators.runs import _ranges
    sizes = [r[1] for r in _ranges(one, ["run_id"], ["step"], 8).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2000


def test_halving_with_a_score_per_round(spark):
    """The best of each round by that round's score go on; a trial without the next score does not."""
    rows = [("b", f"t{i}", 0, float(i)) for i in range(9)] + [("b", "t8", 1, 1.0), ("b", "t7", 1, 5.0), ("b", "t6", 1, None),
                                                             ("b", "t0", 1, 99.0), ("b", "t7", 2, 2.0), ("b", "t8", 2, 9.0)]
    df = spark.createDataFrame(rows, "bracket string, trial string, r int, score double")
    got = sorted((r["round"], r["trial"]) for r in ex.halving_rounds(df, "bracket", "trial", "r", "score", 3).collect())
    assert got == [(0, f"t{i}") for i in range(9)] + [(1, "t7"), (1, "t8"), (2, "t7")]


def test_reduce_lr_on_plateau_of_many_runs(spark):
    df = spark.createDataFrame([(r, k, i, 1.0 if i else 2.0) for r in range(7) for k in "ab" for i in range(9)]
                               + [(None, "a", i, None) for i in range(5)],
                               "run_id int, key string, step int, value double").repartition(5)
    got = {}
    for r in ex.reduce_lr_on_plateau(df, ["run_id", "key"], patience=3, lr0=1e-3).orderBy("step").collect():
        got.setdefault((r["run_id"], r["key"]), []).append(r["learning_rate"])
    assert len(got) == 15 and got.pop((None, "a")) == pytest.approx([1e-3] * 3 + [5e-4] * 2)
    assert all(v == pytest.approx([1e-3] * 5 + [5e-4] * 3 + [2.5e-4]) for v in got.values())


def test_hot_series_lies_in_many_chunks(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).alias("run_id"),
                                  F.lit(1).alias("step"), F.col("id").alias("event_id"))
    rows = runs._ranges(df, ["run_id"], ["step", "event_id"], 30).groupBy("run_id", "_chunk").count().collect()
    hot = [r["count"] for r in rows if r["run_id"] == 0]
    assert sum(hot) >= 2000 and len(hot) >= 8 and max(hot) <= 600


def test_series_scan_keeps_null_series(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(20)] + [(1, 0, 5.0)], "run_id int, step int, value double")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = runs.series_scan(df, ["run_id"], ["step", "ts"], chunks=4)
    assert [r["_sum_incl"] for r in got.where("run_id IS NULL").orderBy("step").collect()] == [i * (i + 1) / 2 for i in range(20)]
    assert got.where("run_id = 1").first()["_n"] == 1


def test_frontier_matches_brute_force(spark):
    import random
    rnd = random.Random(11)
    rows = [(i, float(rnd.randint(0, 30)), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id int, epsilon double, auprc double")
    got = sorted(r["run_id"] for r in runs.frontier(df, buckets=4).collect())
    order = sorted(rows, key=lambda r: (r[1], -r[2], r[0]))
    best, want = None, []
    for rid, _, u in order:
        if best is None or u > best:
            want.append(rid)
        best = u if best is None else max(best, u)
    assert got == sorted(want)


def test_series_scan_matches_ordered_scan(spark):
    import datetime as dt
    import random
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        run = 0 if i % 3 else rnd.randint(1, 5)            # run 0 holds two thirds of the rows
        rows.append((run, "k", rnd.randint(0, 9), base + dt.timedelta(seconds=rnd.randint(0, 30 * 86400)),
                     float(rnd.randint(0, 1000)), i))
    df = spark.createDataFrame(rows, "run_id int, key string, step int, ts timestamp_ntz, value double, event_id int")
    got = {(r["run_id"], r["event_id"]): (r["_i"], r["_n"], r["_min_before"], r["_sum_incl"])
           for r in runs.series_scan(df, ["run_id", "key"], ["step", "ts", "event_id"]).collect()}
    for run in {r[0] for r in rows}:
        series = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[3], r[5]))
        lo, tot = None, 0.0
        for i, r in enumerate(series, 1):
            tot += r[4]
            assert got[(run, r[5])] == (i, len(series), lo, pytest.approx(tot))
            lo = r[4] if lo is None else min(lo, r[4])


def test_search_state_of_unknown_shape(spark, tmp_path):
    """A tuner's state as it writes it, one with missing and foreign keys, and text that is no JSON."""
    import json

    from dpframe.sources import files
    first = {"ongoing_trials": {}, "start_order": ["0000", "0001"], "end_order": ["0000"], "run_times": {"0000": 1, "0001": 2}, "seed": 7,
             "hyperparameters": {"space": [{"class_name": "Int", "config": {"name": "units", "default": None, "min_value": 32}}]},
             "display": {"trial_start": {"0000": "2025-01-01T00:00:00"}, "trial_number": {"0000": 1, "0001": 2}},
             "brackets": [{"bracket_num": 1, "rounds": [[{"past_id": None, "id": "0000"}, {"past_id": None, "id": "0001"}], [{"past_id": "0001", "id": "0002"}]]},
                          {"bracket_num": 0, "rounds": [[]]}], "current_bracket": 0}
    other = {"brackets": [{"rounds": [[{"id": "a", "score": [1, {"x": 2.5}]}]], "bracket_num": "3"}], "run_times": ["not a map"]}
    for name, text in (("a.json", json.dumps(first)), ("b.json", json.dumps(other)), ("c.json", "{broken")):
        (tmp_path / name).write_text(text)
    name = F.element_at(F.split("file", "/"), -1)
    flat = files.read_search_state(spark, str(tmp_path)).withColumn("file", name)
    got = sorted(tuple(r) for r in flat.where("file = 'a.json'").collect())
    assert got == [("a.json", 1, 0, 0, "0000", None, 1, "2025-01-01T00:00:00", True, 1), ("a.json", 1, 0, 1, "0001", None, 2, None, False, 2),
                   ("a.json", 1, 1, 0, "0002", "0001", None, None, False, None)]
    odd = flat.where("file = 'b.json'").collect()
    assert [(r["bracket"], r["trial_id"], r["run_times"], r["ended"]) for r in odd] == [(3, "a", None, None)]
    leaves = {(r["file"], r["path"]): r["value"] for r in files.search_state_leaves(spark, str(tmp_path)).withColumn("file", name).collect()}
    assert leaves["b.json", "$.brackets[0].rounds[0][0].score[1].x"] == "2.5" and leaves["a.json", "$.hyperparameters.space[0].config.name"] == "units"
    assert not [f for f, _ in leaves if f == "c.json"]


def test_stores_of_many_runs_are_few_files(spark, tmp_path):
    """Files written do not grow with the runs; odd names come back; plain and packed files of one root are read together."""
    n = 400
    base = spark.range(n).select(F.concat(F.lit("r/%+ "), F.col("id").cast("string")).alias("run_id"), F.lit("a+b c/é").alias("key"), F.col("id"))
    files.write_params(base.withColumn("value", F.expr("'x' || id || ' \n y'")), f"{tmp_path}/s/params")
    files.write_metrics(base.selectExpr("run_id", "key", "int(id) AS step", "1000 + id AS ts_ms", "id / 2 AS value"), f"{tmp_path}/s/metrics")
    files.write_metrics(base.selectExpr("run_id", "key", "int(id) AS step", "1000 + id AS ts_ms", "id / 2 AS value"), f"{tmp_path}/s/metrics")
    files.write_run_meta(base.selectExpr("run_id", "'name: ' || id AS run_name", "3 AS status"), f"{tmp_path}/s/meta")
    files.append_parquet(base, f"{tmp_path}/s/table", [], run="run_id", buckets=8)
    assert len([p for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")]) < 80
    p = {r["run_id"]: (r["key"], r["value"]) for r in files.read_params(spark, f"{tmp_path}/s/params").collect()}
    assert p == {f"r/%+ {i}": ("a+b c/é", f"x{i} \n y") for i in range(n)}
    m = files.read_metrics(spark, f"{tmp_path}/s/metrics")
    assert m.count() == 2 * n and m.where("run_id = 'r/%+ 7' AND ts_ms = 1007 AND value = 3.5 AND step = 7").count() == 2
    meta = files.read_run_meta(spark, f"{tmp_path}/s/meta").where("run_name = 'name: 5' AND status = 3").collect()
    assert [r["run_id"] for r in meta] == ["r/%+ 5"]
    table = spark.read.parquet(f"{tmp_path}/s/table")
    assert table.count() == n and table.where(F.col("run_bucket") == files.run_bucket("run_id", 8)).count() == n
    _write(tmp_path, "s/params/1/abc/params/lr", "0.5\n")
    assert files.read_params(spark, f"{tmp_path}/s/params").count() == n + 1
    files.write_params(base.limit(3).withColumn("value", F.lit("v")), f"{tmp_path}/s/params")
    assert files.read_params(spark, f"{tmp_path}/s/params").count() == 3


def test_plateau_works_on_whole_ranges_not_on_single_runs(spark, monkeypatch):
    """No Python call for every run, and runs that go over several Arrow batches stay whole."""
    import pandas as pd
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def never(*a, **k):
        raise AssertionError("a Python call for every run")
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", never)
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    vals = [1.0, 0.9, 0.95, 0.96, 0.97, 0.98, 0.99, 1.0]
    df = spark.createDataFrame([(r, i, v) for r in range(40) for i, v in enumerate(vals)], "run_id int, step int, value double")
    try:
        spark.conf.set(key, "5")
        got = ex.reduce_lr_on_plateau(df, ["run_id"], patience=3, lr0=1e-3, chunks=3).orderBy("run_id", "step").collect()
    finally:
        spark.conf.set(key, old)
    assert [r["learning_rate"] for r in got] == pytest.approx(([1e-3] * 5 + [5e-4] * 3) * 40)
    frames = [pd.DataFrame({"g": list(t), "h": 0}) for t in ("aab", "bb", "b", "ccd", "", "e")]
    seen = [(pdf["g"].iloc[a], b - a) for pdf, at in ex._whole_groups(iter(frames), ["g", "h"]) for a, b in zip(at, at[1:])]
    assert seen == [("a", 2), ("b", 4), ("c", 2), ("d", 1), ("e", 1)]
