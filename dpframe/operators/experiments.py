"""Experiment tables: grids, search spaces, selection, sensitivity.

Trials are rows. Selection over trials uses windows partitioned by run or
bracket, or ranks found in ranges (:func:`dpframe.operators.runs.positions`)
when a group can be large (successive halving keeps a fraction of a
bracket, so a bracket holding a third of all trials never lands in one
window task).
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dpframe.keys import group_key, uniform_int

# Grids of the reference runs (fixed values).
DP_GRID = {
    "l2_norm_clip": [0.5, 1.0, 1.5],
    "noise_multiplier": [0.8, 1.0, 1.1],
    "learning_rate": [0.01, 0.1, 0.25],
    "threshold": [0.2],
    "epochs": [15, 25, 30],
}
NONPRIVATE_GRID = {
    "l2_reg": [0.0, 1e-6, 1e-5, 1e-4, 1e-3, 5e-3],
    "learning_rate": [1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2],
    "epochs": [30, 40, 50, 60, 80, 100],
}
SENSITIVITY_BASE = {"l2_norm_clip": 1.2, "noise_multiplier": 1.2, "learning_rate": 0.25,
                    "epochs": 5, "pred_threshold": 0.2}
SENSITIVITY_VALUES = {
    "l2_norm_clip": [0.8, 1.2, 1.6],
    "noise_multiplier": [0.8, 1.2, 1.6],
    "learning_rate": [0.1, 0.25, 0.5],
    "epochs": [3, 5, 7],
    "pred_threshold": [0.1, 0.2, 0.3],
}
SEARCH_SPACE = [  # (name, kind, spec)
    ("units1", "int", (32, 512, 32)),
    ("units2", "int", (32, 256, 32)),
    ("learning_rate", "choice", [0.01, 0.05, 0.1, 0.25]),
]


def grid(spark: SparkSession, values: Mapping[str, list]) -> DataFrame:
    """H1: cross product of value lists, one row per combination, with ``trial`` 1..N.

    The grid is configuration (a product of short literal lists), so it is
    enumerated once, in lexicographic order of the sorted lists, into a
    single one-partition frame; chaining cross joins of parallelised lists
    would multiply their partitions.
    """
    names = list(values)
    lists = [sorted(float(v) for v in values[n]) for n in names]
    rows = [tuple(c) + (i + 1,) for i, c in enumerate(itertools.product(*lists))]
    schema = ", ".join(f"`{n}` double" for n in names) + ", trial int"
    return spark.createDataFrame(rows, schema).coalesce(1)


def sample_space(trials: DataFrame, trial_key: Column, space=SEARCH_SPACE, seed=42) -> DataFrame:
    """H2: draw every hyperparameter of each trial from its space by hash.

    ``Int(min, max, step)`` draws uniformly from ``sequence(min, max, step)``;
    ``Choice(values)`` draws one of the values.
    """
    out = trials
    for name, kind, spec in space:
        txt = F.concat(trial_key.cast("string"), F.lit(f"|{name}|{seed}"))
        if kind == "int":
            lo, hi, st = spec
            n = (hi - lo) // st + 1
            out = out.withColumn(name, (F.lit(lo) + uniform_int(txt, F.lit(n)) * F.lit(st)).cast("int"))
        else:
            arr = F.array(*[F.lit(float(v)) for v in spec])
            out = out.withColumn(name, F.element_at(arr, (uniform_int(txt, F.lit(len(spec))) + 1).cast("int")))
    return out


def _with_value(df: DataFrame, value: str) -> DataFrame:
    """Rows of trials that recorded a number: failed trials (null or NaN) never win."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def best_trial(results: DataFrame, loss: str, trial: str, by: list[str] | None = None) -> DataFrame:
    """H4: trial with the lowest loss; the earlier trial wins ties (strict improvement)."""
    by = by or []
    rest = [c for c in results.columns if c not in by]
    results = _with_value(results, loss)
    g = results.groupBy(*by) if by else results
    return g.agg(F.min_by(F.struct(*rest), F.struct(F.col(loss), F.col(trial))).alias("best")).select(*by, "best.*")


def best_epoch(history: DataFrame, run: list[str], value: str = "value", step: str = "step",
               tiebreak: list[str] = ()) -> DataFrame:
    """H5: per run, the step with the lowest value (first on ties).

    A ``min_by`` aggregate (map-side combinable), so a run with a huge
    history is reduced in partial aggregates, never sorted in one task.
    """
    rest = [c for c in history.columns if c not in run]
    order = F.struct(F.col(value), F.col(step), *[F.col(c) for c in tiebreak])
    return _with_value(history, value).groupBy(*run).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*run, "_b.*")


def early_stopping(history: DataFrame, run: list[str], value: str = "value", step: str = "step",
                   patience: int = 5, mode: str = "min", ts: str = "ts") -> DataFrame:
    """H6: per run, the epoch where training stops and the restored best epoch.

    Epoch index = position in (step, ts) order. An epoch improves when it
    beats the best so far (strictly). Training stops at the first epoch with
    ``patience`` epochs since the last improvement; otherwise at the last.
    Built on series scans (running minimum, then running maximum of
    the improvement index) and per-run aggregates, so no window spans a run.
    """
    from dpframe.operators.runs import series_scan

    sign = 1.0 if mode == "min" else -1.0
    h = history.withColumn("_v", F.col(value) * F.lit(sign))
    d = series_scan(h, run, [step, ts], "_v", ts=ts)
    imp = F.col("_min_before").isNull() | (F.col("_v") < F.col("_min_before"))
    d = d.withColumn("_imp_i", F.when(imp, F.col("_i"))).drop("_n", "_min_before", "_sum_incl", "_prev_ts")
    d = series_scan(d, run, [step, ts], "_v", ts=ts, running_max="_imp_i")
    trig = F.col("_i") - F.col("_max_incl") >= F.lit(patience)
    agg = d.groupBy(*run).agg(F.coalesce(F.min(F.when(trig, F.col("_i"))), F.max("_i")).alias("stop_epoch"),
                              F.max("_i").alias("epochs_seen"))
    best = (d.join(agg, run).where(F.col("_i") <= F.col("stop_epoch"))
            .groupBy(*run, "stop_epoch", "epochs_seen")
            .agg(F.min_by(F.struct(F.col("_i").alias("best_epoch"), F.col(value).alias("best_value")),
                          F.struct(F.col("_v"), F.col("_i"))).alias("b")))
    return best.select(*run, "stop_epoch", "epochs_seen", "b.best_epoch", "b.best_value")


def _chain(values: np.ndarray, min_delta: float):
    """Records of a piece of a series for the plateau rule: (places, values, next record of the chain or -1, last of the chain).

    Whatever the best value before, the first improvement of a piece is a
    strict minimum of what came before it in the piece (a record). From a
    record r the next improvement is the first value below v_r - min_delta:
    a record again. So the records and their chains say all about the piece.
    """
    low = np.minimum.accumulate(np.where(np.isnan(values), np.inf, values))
    place = np.flatnonzero(low < np.concatenate([[np.inf], low[:-1]]))
    v = low[place]
    after = np.searchsorted(-v, -(v - min_delta), side="right")         # values fall: first one below
    nxt = np.where(after < len(v), after, -1)
    last = np.arange(len(v))
    for r in range(len(v) - 1, -1, -1):
        if nxt[r] >= 0:
            last[r] = last[nxt[r]]
    return place, v, nxt, last


def _whole_groups(it, names: list[str]):
    """Frames of whole groups, with the borders of these, from the batches of a partition sorted by ``names``.

    Many short groups come in one frame; a group over several batches is held until it ends.
    """
    held: list[pd.DataFrame] = []

    def cuts(pdf):
        change = np.zeros(max(len(pdf) - 1, 0), bool)
        for c in names:
            v = pdf[c].to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    def out(frames):
        pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        return pdf, [0, *cuts(pdf).tolist(), len(pdf)]

    for pdf in it:
        if not len(pdf):
            continue
        if held and any(held[-1][c].iloc[-1] != pdf[c].iloc[0] for c in names):
            yield out(held)
            held = []
        at = cuts(pdf)
        if len(at):
            yield out([*held, pdf.iloc[:at[-1]]])
            held = []
            pdf = pdf.iloc[at[-1]:]
        held.append(pdf)
    if held:
        yield out(held)


def reduce_lr_on_plateau(history: DataFrame, run: list[str], value: str = "value", step: str = "step",
                         lr0: float = 1e-3, factor: float = 0.5, patience: int = 3, min_lr: float = 1e-6,
                         min_delta: float = 1e-4, chunks: int | None = None) -> DataFrame:
    """H7: learning rate per epoch under halving-after-plateau (min mode).

    An epoch improves if its value lies more than ``min_delta`` below that of
    the last improvement; every ``patience`` epochs without one lower the
    rate. Each improvement depends on the one before, so a run is cut into
    ranges that are worked on in parallel: (1) a range sends its chains of
    possible improvements, as the steps of the function from the best value
    before it to that after it; (2) these few numbers are combined along each
    run, giving every range its best value; (3) a range marks its improvements
    and counts the lowerings between them, and running sums over the ranges
    give the rates. No task holds more of a run than one range.
    A null or NaN value is an epoch without improvement.
    """
    from dpframe.operators.runs import _ranges

    names = ["_run", "_chunk"]
    d = history.select(*run, F.col(step).cast("int").alias(step), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"), group_key(run).alias("_run"))
    d = _ranges(d, ["_run"], [step, "_v"], chunks)

    def pieces(it):
        for pdf, at in _whole_groups(it, names):
            values, entries, exits = pdf["_v"].to_numpy(float), [], []
            for a, b in zip(at, at[1:]):
                _, best, _, last = _chain(values[a:b], min_delta)
                end = best[last]
                new = np.ones(len(best), bool)
                new[1:] = end[1:] != end[:-1]          # entries next to each other mostly end alike
                entries.append(best[np.append(new[1:], True)] if len(best) else [])
                exits.append(end[new] if len(best) else [])
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[at[:-1]] for c in names}, "entry": entries, "exit": exits})

    # a partition is a range, with many runs or a part of one
    summaries = d.sortWithinPartitions(*names, step, "_v").mapInPandas(pieces, "_run string, _chunk int, entry array<double>, exit array<double>")

    def along(it):                                     # one row a range
        for pdf, at in _whole_groups(it, ["_run"]):
            entries, exits, bests = pdf["entry"].to_numpy(), pdf["exit"].to_numpy(), []
            for a, b in zip(at, at[1:]):
                best = np.inf
                for k in range(a, b):
                    bests.append(best)
                    # entered at the first record below the best value less min_delta: in the first step whose last record is below it
                    first = int(np.searchsorted(-entries[k], -(best - min_delta), side="right")) if best < np.inf else 0
                    best = float(exits[k][first]) if first < len(entries[k]) else best
            yield pd.DataFrame({"_r": pdf["_run"].to_numpy(), "_c": pdf["_chunk"].to_numpy(), "_best": bests})

    before = summaries.repartition("_run").sortWithinPartitions(*names).mapInPandas(along, "_r string, _c int, _best double")
    given = d.join(before, (F.col("_run") == F.col("_r")) & (F.col("_chunk") == F.col("_c"))).drop("_r", "_c")
    fields = ("_at", "_since", "_lowered", "_first", "_last", "_inside", "_rows")
    out = T.StructType([d.schema[c] for c in [*run, step, *names]] + [T.StructField(c, T.LongType()) for c in fields])

    def mark(it):
        """Per row: its place, the last improvement before it in the range, and the lowerings in the gaps closed before it."""
        for pdf, borders in _whole_groups(it, names):
            values, given_best, found = pdf["_v"].to_numpy(float), pdf["_best"].to_numpy(float), []
            for a, b in zip(borders, borders[1:]):
                best, rows = given_best[a], b - a
                place, v, nxt, _ = _chain(values[a:b], min_delta)
                r = int(np.searchsorted(-v, -(best - min_delta), side="right")) if best < np.inf else 0
                hits = []
                while 0 <= r < len(v):
                    hits.append(place[r])
                    r = nxt[r]
                hits = np.array(hits, np.int64) + 1    # places from 1
                at = np.arange(1, rows + 1)
                closed = np.concatenate([[0], np.cumsum((np.diff(hits) - 1) // patience)]) if len(hits) else np.zeros(1, np.int64)
                seen = np.searchsorted(hits, at)       # improvements before the row
                since = np.where(seen > 0, hits[np.maximum(seen, 1) - 1] if len(hits) else 0, 0)
                first, last = (hits[0], hits[-1]) if len(hits) else (0, 0)
                found.append(np.column_stack([at, since, closed[np.maximum(seen, 1) - 1]] + [np.full(rows, x) for x in (first, last, closed[-1], rows)]))
            res = pdf[[*run, step, *names]].reset_index(drop=True)
            res[list(fields)] = np.concatenate(found).astype(np.int64)
            yield res

    rows = given.repartition(*names).sortWithinPartitions(*names, step, "_v").mapInPandas(mark, out).checkpoint()
    w = Window.partitionBy("_run").orderBy("_chunk")                              # one row a range
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*names).agg(*[F.max(c).alias(c) for c in ("_first", "_last", "_inside", "_rows")])
    parts = parts.withColumn("_off", F.coalesce(F.sum("_rows").over(prev), F.lit(0)))
    parts = parts.withColumn("_before", F.coalesce(F.max(F.when(F.col("_last") > 0, F.col("_off") + F.col("_last"))).over(prev), F.lit(0)))
    gap = F.when(F.col("_first") > 0, F.floor((F.col("_off") + F.col("_first") - F.col("_before") - 1) / patience)).otherwise(F.lit(0))
    parts = parts.withColumn("_gap", gap).withColumn("_done", F.coalesce(F.sum(F.col("_gap") + F.col("_inside")).over(prev), F.lit(0)))
    parts = parts.select(F.col("_run").alias("_r"), F.col("_chunk").alias("_c"), "_off", "_before", "_gap", "_done")
    j = rows.join(parts, (F.col("_run") == F.col("_r")) & (F.col("_chunk") == F.col("_c")))
    since = F.when(F.col("_since") > 0, F.col("_off") + F.col("_since")).otherwise(F.col("_before"))
    closed = F.col("_done") + F.when(F.col("_since") > 0, F.col("_gap") + F.col("_lowered")).otherwise(F.lit(0))
    lowered = closed + F.floor((F.col("_off") + F.col("_at") - 1 - since) / patience)
    rate = F.least(F.lit(float(lr0)), F.greatest(F.lit(float(lr0)) * F.pow(F.lit(float(factor)), lowered), F.lit(float(min_lr))))
    return j.select(*run, step, rate.alias("learning_rate"))


def top_results(results: DataFrame, loss: str, trial: str, k: int = 15) -> DataFrame:
    """H8: the k best trials by loss (a top-k report; the limit is the feature)."""
    return _with_value(results, loss).orderBy(F.col(loss), F.col(trial)).limit(k)


def sensitivity_grid(spark: SparkSession, base=SENSITIVITY_BASE, values=SENSITIVITY_VALUES) -> DataFrame:
    """One-at-a-time design: base row x exploded map<param, array<value>>."""
    base_df = spark.createDataFrame([tuple(float(v) for v in base.values())],
                                    ", ".join(f"`{k}` double" for k in base)).coalesce(1)
    m = F.create_map(*[x for k, vs in values.items()
                       for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in vs]))])
    e = base_df.select("*", F.explode(m).alias("hyperparameter", "_vals")) \
        .select("*", F.explode("_vals").alias("value")).drop("_vals")
    for k in base:
        e = e.withColumn(k, F.when(F.col("hyperparameter") == k, F.col("value")).otherwise(F.col(k)))
    return e


def _scored(trials: DataFrame, score: str) -> DataFrame:
    return trials.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def successive_halving(trials: DataFrame, bracket: str, score: str, key: str, factor: int = 3) -> DataFrame:
    """Rounds of successive halving inside each bracket, by one final score.

    Round r keeps the best ceil(n_b / factor^r) trials of bracket b (score
    descending, ties by the trial key; trials without a score take no part);
    bracket b (0-based, in sorted order) runs rounds 0..b. Trials are ranked
    once, in ranges of (bracket, score, key), so no bracket is sorted in one
    task, and every round is a bound on the rank.
    Output: the columns of ``trials`` and ``round`` for every trial promoted
    into each round.
    """
    from dpframe.operators.runs import positions

    d = _scored(trials, score).withColumn("_down", -F.col(score).cast("double"))
    order = d.select(bracket).distinct().withColumn("_last", F.dense_rank().over(Window.orderBy(bracket)) - 1)   # one row a bracket
    d = positions(d, [bracket], ["_down", key]).join(order, bracket)
    rounds = d.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))))
    keep = F.col("_i") <= F.ceil(F.col("_n") / F.pow(F.lit(float(factor)), F.col("round")))
    return rounds.where(keep).drop("_down", "_last", "_i", "_n")


def halving_rounds(scores: DataFrame, bracket: str, trial: str, round_: str, score: str, rounds: int, factor: int = 3) -> DataFrame:
    """H12 with a score per round: (bracket, round, trial, score) of the trials that run each round.

    ``scores`` has one row per bracket, trial and round it has a score for. All trials with a
    score for round 0 run it; round r + 1 is run by the best
    ceil(n_0 / factor^(r + 1)) of round r by their scores there (ties by the
    trial), as far as they have a score for it.
    """
    from dpframe.operators.runs import positions

    rows = _scored(scores.select(bracket, trial, F.col(round_).cast("int").alias("round"), F.col(score).cast("double").alias("score")), "score")
    first = rows.where("round = 0").groupBy(bracket).agg(F.count(F.lit(1)).alias("_all"))
    now = rows.where("round = 0")
    out = now
    for r in range(1, rounds):
        ranked = positions(now.withColumn("_down", -F.col("score")), [bracket], ["_down", trial]).join(first, bracket)
        kept = ranked.where(F.col("_i") <= F.ceil(F.col("_all") / F.lit(float(factor ** r)))).select(bracket, trial)
        now = rows.where(F.col("round") == r).join(kept, [bracket, trial], "left_semi")
        out = out.unionByName(now)
    return out


def best_overall(results: DataFrame, score: str, trial: str) -> DataFrame:
    """The trial with the highest score (lowest trial key on ties)."""
    order = F.struct(-F.col(score).cast("double"), F.col(trial))
    return _with_value(results, score).agg(F.min_by(F.struct(*results.columns), order).alias("b")).select("b.*")
