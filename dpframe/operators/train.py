"""Private and non-private training of binary classifiers.

The driver holds only the parameter vector (size d, bounded). A step needs the
parameters of the step before, so steps run one after another. Those of small
batches are run in blocks: a block is the rows of some consecutive steps (about
``BLOCK_ROWS``), one task works on it and hands the parameters on to the next
block, which lies on any executor. So an epoch is few jobs, not one a step, and
trials train side by side. Rows go to their blocks as packed arrays, never one by
one. A batch over ``SPREAD_FROM`` rows is one job a step,
summed over several tasks:

1. batch membership: Poisson sampling at rate q, decided per (row, step)
   by a hash, so a retried task selects the same rows; the schedule of one
   epoch is held at a time, the next one is drawn while this one trains;
2. per-example gradient and L2 clip inside the row projection (logistic
   model: pure SQL; MLP: numpy in ``mapInPandas`` with weights broadcast);
   with microbatches the gradient sums and row counts of each microbatch are
   merged over all partitions before its mean is clipped;
3. a partial (per-partition) vector sum, then one d-vector to the driver;
4. Gaussian noise N(0, (C sigma)^2) added once to that sum on the driver,
   drawn from (secret seed, trial, step, coordinate),
   division by the expected batch size (or the number of microbatches),
   optimizer update (SGD, momentum, Adam).

Non-private training (D11) is the same loop with no clipping and no noise;
``full_batch`` makes every epoch one step over all rows. With a ``state``
folder the parameters, optimizer moments, step and spent budget are appended
as a table after every epoch, and a run that was cut goes on from there.
"""

from __future__ import annotations

import itertools
import math
import hashlib
import pickle
import secrets
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dpframe.functions import vec
from dpframe.functions.accountant import gdp_epsilon, gdp_mu, rdp_epsilon
from dpframe.keys import uniform01

OPTIMIZERS = ("sgd", "momentum", "adam")
ADAM_B1, ADAM_B2, ADAM_EPS = 0.9, 0.999, 1e-8     # fixed values
MOMENTUM = 0.9                                     # fixed value
ROWS_PER_TASK = 64           # batch rows from which on a step is spread over one more task
SPREAD_FROM = 16_384         # batch rows from which on a step is a job of its own, over several tasks
BLOCK_ROWS = 262_144         # rows (about) of the consecutive steps of smaller batches that one task works on
BLOCK_VALUES = 4_194_304     # features of those rows, at most (about)
DRAW_ROWS = 100_000          # rows of a task that draws batches
DRAW_MEMBERS = 2_000_000     # rows (about) that such a task puts into the batches of all trials
HASHED = 65_536              # texts hashed side by side
TRIALS_PER_TASK = 8          # trials whose blocks one task works on, at most
NOISE_VALUES = 65_536        # noise values (about) drawn side by side


@dataclass
class FitConfig:
    model: str = "logistic"            # "logistic" or "mlp"
    hidden: tuple = (128, 64)
    optimizer: str = "sgd"             # "sgd", "momentum", "adam"
    learning_rate: float = 0.25
    l2_norm_clip: float | None = 0.8   # None: no clipping (non-private)
    noise_multiplier: float = 0.8      # 0: no noise
    batch_size: int = 256
    epochs: int = 5
    microbatches: int | None = None    # None: per-example clipping
    l2_reg: float = 0.0
    accountant: str = "rdp"            # "rdp" or "gdp"
    delta: float | None = None         # None: 1/n
    budget: float | None = None        # stop after the first epoch whose epsilon exceeds it
    seed: int | str | None = None      # None: fresh entropy (a known seed voids privacy)
    full_batch: bool = False           # every epoch is one step over all rows (batch_size is ignored)
    step_engine: str = "numpy"         # logistic model only: "numpy" (mapInPandas) or "sql"

    def validate(self):
        if self.optimizer not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {self.optimizer!r}")
        if self.full_batch and self.microbatches is not None:
            raise ValueError("microbatches split Poisson batches, not the full batch")
        if self.microbatches is not None and self.batch_size % self.microbatches != 0:
            raise ValueError("batch_size must be a multiple of microbatches")
        if self.model not in ("logistic", "mlp"):
            raise ValueError(f"unknown model {self.model!r}")


@dataclass
class FitResult:
    params: np.ndarray
    history: list = field(default_factory=list)   # dict rows: epoch, step, metric, value
    epsilon: list = field(default_factory=list)   # per epoch
    steps: int = 0
    stopped_epoch: int | None = None


# ------------------------------------------------------------------ models

class Logistic:
    def __init__(self, d: int):
        self.d = d
        self.size = d + 1

    def init(self, rng) -> np.ndarray:
        return np.zeros(self.size)

    def score(self, x: Column, params) -> Column:
        return vec.logistic_score(x, params[:-1].tolist(), float(params[-1]))

    def predict_np(self, params, X):
        return 1.0 / (1.0 + np.exp(-(X @ params[:-1] + params[-1])))

    def clipped_sum(self, p, X, y, w, clip, sq=None):
        """Sum of per-example clipped gradients (p - y) w [x, 1]; ``sq``: |x|^2 + 1 of the rows, if known."""
        r = (self.predict_np(p, X) - y) * w
        if clip is None:
            f = np.ones(len(X))
        else:
            nrm = np.abs(r) * np.sqrt((X * X).sum(1) + 1.0 if sq is None else sq)
            f = np.where(nrm > clip, clip / np.maximum(nrm, 1e-300), 1.0)
        rf = r * f
        return np.concatenate([X.T @ rf, [rf.sum()]])

    def gradient_sum(self, p, X, y, w):
        """Sum of the gradients, none of them clipped."""
        return self.clipped_sum(p, X, y, w, None)


class MLP:
    """Two ReLU hidden layers and a sigmoid output."""

    def __init__(self, d: int, hidden=(128, 64)):
        self.d, (self.h1, self.h2) = d, hidden
        self.shapes = [(d, self.h1), (self.h1,), (self.h1, self.h2), (self.h2,), (self.h2,), (1,)]
        self.size = int(sum(np.prod(s) for s in self.shapes))

    def init(self, rng) -> np.ndarray:
        parts = []
        for s in self.shapes:
            if len(s) == 2:
                lim = math.sqrt(6.0 / (s[0] + s[1]))
                parts.append(rng.uniform(-lim, lim, size=s).ravel())
            elif s == (self.h2,) and len(parts) == 4:
                lim = math.sqrt(6.0 / (self.h2 + 1))
                parts.append(rng.uniform(-lim, lim, size=s))
            else:
                parts.append(np.zeros(s))
        return np.concatenate(parts)

    def unpack(self, p):
        out, i = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(p[i:i + n].reshape(s))
            i += n
        return out

    def forward(self, p, X):
        W1, b1, W2, b2, w3, b3 = self.unpack(p)
        h1 = np.maximum(X @ W1 + b1, 0.0)
        h2 = np.maximum(h1 @ W2 + b2, 0.0)
        z = h2 @ w3 + b3[0]
        return h1, h2, 1.0 / (1.0 + np.exp(-z))

    def predict_np(self, p, X):
        return self.forward(p, X)[2]

    def clipped_sum(self, p, X, y, w, clip, sq=None):
        """Sum of per-example gradients clipped to ``clip``; ``sq``: |x|^2 + 1 of the rows, if known.

        Per-example norms use ||x g^T|| = ||x|| ||g||, so clipping costs one
        backward pass: the clipped sum is X^T (f * delta) per layer.
        """
        W1, b1, W2, b2, w3, b3 = self.unpack(p)
        h1, h2, prob = self.forward(p, X)
        dz = (prob - y) * w
        dh2 = dz[:, None] * w3[None, :] * (h2 > 0)
        dh1 = (dh2 @ W2.T) * (h1 > 0)
        if clip is None:
            f = np.ones(len(X))
        else:
            sq = ((X * X).sum(1) + 1.0 if sq is None else sq) * (dh1 * dh1).sum(1) \
                + ((h1 * h1).sum(1) + 1.0) * (dh2 * dh2).sum(1) \
                + ((h2 * h2).sum(1) + 1.0) * dz * dz
            nrm = np.sqrt(sq)
            f = np.where(nrm > clip, clip / np.maximum(nrm, 1e-300), 1.0)
        parts = [X.T @ (f[:, None] * dh1), (f[:, None] * dh1).sum(0), h1.T @ (f[:, None] * dh2),
                 (f[:, None] * dh2).sum(0), h2.T @ (f * dz), np.array([(f * dz).sum()])]
        return np.concatenate([q.ravel() for q in parts])

    def gradient_sum(self, p, X, y, w):
        """Sum of the gradients, none of them clipped."""
        return self.clipped_sum(p, X, y, w, None)


def make_model(cfg: FitConfig, d: int):
    return Logistic(d) if cfg.model == "logistic" else MLP(d, cfg.hidden)


# ------------------------------------------------------------------ steps

SCHEDULE_DRAWS = 8     # geometric draws per row and round (more rounds for the rare rest)


def poisson_schedule(data: DataFrame, key: str, q: float, steps_per_epoch: int, epochs: int, seed,
                     draws: int = SCHEDULE_DRAWS) -> DataFrame:
    """Exact Poisson subsampling for every step of every epoch (one trial); see :func:`poisson_schedules`."""
    trials = [(0, float(q), int(steps_per_epoch), int(epochs), str(seed))]
    out, held = poisson_schedules(data, key, trials, draws)
    return out.drop("_trial", "_local")


def poisson_schedules(data: DataFrame, key: str, trials: list[tuple], draws: int = SCHEDULE_DRAWS, epoch: int | None = None):
    """Exact Poisson subsampling schedules for several trials at once, O(rows) per epoch.

    ``trials``: (trial id, rate q, steps per epoch S, epochs, seed); with
    ``epoch`` only that epoch of the trials that reach it. Instead
    of testing each (row, step) pair, each row draws the gaps between the
    steps it joins: G_j = floor(ln(1 - u_j) / ln(1 - q)) with u_j =
    md5-uniform(key | e<epoch> | j | seed), positions p_j = p_{j-1} + 1 + G_j,
    kept while p_j < S -- the same law as an independent Bernoulli(q) per
    step. Rows still inside their epoch after ``draws`` draws get further
    rounds (a few percent of rows, then almost none), so no membership is
    ever cut off. Returns (schedule with input columns + ``_trial``,
    ``epoch``, ``_local`` step of the epoch, global ``step``; the per-round states it keeps, to release
    once the schedule is written).
    """
    spark = data.sparkSession
    tt = spark.createDataFrame(
        [(int(t), float(q), (math.log1p(-q) if q < 1.0 else float("-inf")), int(S), int(E), str(sd))
         for t, q, S, E, sd in trials if epoch is None or epoch <= E],
        "_trial int, _q double, _lq double, _S long, _E int, _seed string")
    e = (data.crossJoin(F.broadcast(tt))
         .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_E"))) if epoch is None else F.lit(epoch)))
    cols = [c for c in data.columns] + ["_trial", "epoch"]
    state = e.withColumn("_pos", F.lit(-1).cast("long"))
    out = None
    held = []
    j0 = 1
    while True:
        def fold(acc, j):
            u = uniform01(F.concat(F.col(key), F.lit("|e"), F.col("epoch").cast("string"), F.lit("|"),
                                   j.cast("string"), F.lit("|"), F.col("_seed")))
            gap = F.floor(F.log(F.lit(1.0) - u) / F.col("_lq"))
            pos = acc["pos"] + F.lit(1) + F.coalesce(gap, F.lit(0)).cast("long")
            keep = F.when(pos < F.col("_S"), F.concat(acc["out"], F.array(pos))).otherwise(acc["out"])
            return F.when(acc["pos"] < F.col("_S"), F.struct(pos.alias("pos"), keep.alias("out"))).otherwise(acc)

        init = F.struct(F.col("_pos").alias("pos"), F.array().cast("array<bigint>").alias("out"))
        st = state.withColumn("_st", F.aggregate(F.sequence(F.lit(j0), F.lit(j0 + draws - 1)), init, fold))
        st = st.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(st)
        got = (st.select(*cols, "_S", F.explode("_st.out").alias("_local"))
               .withColumn("step", ((F.col("epoch") - 1) * F.col("_S") + F.col("_local")).cast("long"))
               .drop("_S"))
        out = got if out is None else out.unionByName(got)
        rest = st.where(F.col("_st.pos") < F.col("_S")).withColumn("_pos", F.col("_st.pos")).drop("_st")
        if rest.limit(1).count() == 0:
            break
        state = rest
        j0 += draws
    return out, held


_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_MD5_TURNED = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _md5(words: list, n: int) -> list[np.ndarray]:
    """md5 of ``n`` padded messages side by side, as four 32-bit words; ``words``: theirs in order, an array of ``n`` or a number that all share."""
    state = [np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:                                    # d ^ (b & (c ^ d))
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
            elif i < 32:                                  # c ^ (d & (b ^ c))
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
            elif i < 48:
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            else:                                         # c ^ (b | ~d)
                np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
            w, k = words[at + _MD5_WORD[i]], _MD5_ADDED[i]
            a += f
            if isinstance(w, int):
                a += np.uint32((k + w) & 0xFFFFFFFF)
            else:
                a += w
                a += np.uint32(k)
            np.left_shift(a, np.uint32(_MD5_TURNED[i]), out=t)
            a >>= np.uint32(32 - _MD5_TURNED[i])
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return state


def _by_length(texts: list[bytes]) -> list[tuple]:
    """Texts of one length together: (length, their places, their 32-bit words, one row a word)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = []
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        raw = np.zeros((len(at), -(-n // 4) * 4), np.uint8)
        raw[:, :n] = np.frombuffer(b"".join([texts[i] for i in at]), np.uint8).reshape(len(at), n)
        out.append((n, at, np.ascontiguousarray(raw.view("<u4").T)))
    return out


def _uniforms(length: int, heads: np.ndarray, row: np.ndarray, tails: list[bytes], of: np.ndarray) -> np.ndarray:
    """Uniforms in [0, 1) from the md5 (52 bits) of texts ``row`` of one length (:func:`_by_length`), each with its end ``tails[of]``; all ends are as long."""
    if len(row) < 256:
        got = [hashlib.md5(heads[:, r].tobytes()[:length] + tails[t]).digest()[:7] for r, t in zip(row, of)]
        return np.array([int.from_bytes(h, "big") >> 4 for h in got], np.float64) / 2.0 ** 52
    size = length + len(tails[0])
    room = ((size + 8) // 64 + 1) * 64
    ends = np.frombuffer(b"".join([bytes(length) + t + b"\x80" + bytes(room - size - 9) + (8 * size).to_bytes(8, "little") for t in tails]), "<u4")
    words = []
    for i, col in enumerate(ends.reshape(len(tails), -1).T):
        w = int(col[0]) if (col == col[0]).all() else col[of]
        words.append(w if i >= len(heads) else heads[i][row] | (np.uint32(w) if isinstance(w, int) else w))
    a, b = (x.byteswap().astype(np.uint64) for x in _md5(words, len(row))[:2])
    return ((a << np.uint64(20)) | (b >> np.uint64(12))).astype(np.float64) / 2.0 ** 52


def _joined(keys: list[str], trials: list[tuple], epoch: int):
    """Who joins which steps of ``epoch``: (trial, rows, steps of the epoch) for every trial that reaches it.

    The draws of :func:`poisson_schedules`, each row's until it has left the
    epoch, so there are no further rounds and nothing is kept meanwhile; the
    rows (and, of few rows, several trials) are drawn side by side.
    ``trials`` as there.
    """
    groups = _by_length([k.encode() for k in keys])
    todo = [(t, math.log1p(-q) if q < 1.0 else float("-inf"), int(S), f"|{seed}".encode()) for t, q, S, E, seed in trials if epoch <= E]
    for _, alike in itertools.groupby(todo, key=lambda t: len(t[3])):
        alike, at_once = list(alike), max(1, DRAW_MEMBERS // max(1, len(keys)))
        for some in (alike[i:i + at_once] for i in range(0, len(alike), at_once)):
            lq, steps = np.array([t[1] for t in some]), np.array([t[2] for t in some])
            found = [(np.empty(0, np.int64),) * 3]
            for length, places, heads in groups:
                tall = max(1, HASHED // len(places))                           # trials, and rows, drawn side by side
                for first, low in itertools.product(range(0, len(places), HASHED), range(0, len(some), tall)):
                    rows, of = np.arange(first, min(first + HASHED, len(places))), np.arange(low, min(low + tall, len(some)))
                    of, row = np.repeat(of, len(rows)), np.tile(rows, len(of))
                    pos, j = np.full(len(of), -1), 0
                    while len(of):
                        j += 1
                        u = _uniforms(length, heads, row, [f"|e{epoch}|{j}".encode() + t[3] for t in some], of)
                        pos = pos + 1 + np.floor(np.log(1.0 - u) / lq[of]).astype(np.int64)
                        inside = np.flatnonzero(pos < steps[of])
                        of, row, pos = of[inside], row[inside], pos[inside]
                        found.append((of, places[row], pos))
            of, row, pos = (np.concatenate(x) for x in zip(*found))
            order, cuts = np.argsort(of.astype(np.min_scalar_type(len(some))), kind="stable"), np.cumsum(np.bincount(of, minlength=len(some)))[:-1]
            for t, r, p in zip(some, np.split(row[order], cuts), np.split(pos[order], cuts)):
                yield t[0], r, p


def _memberships(key: str, trials: list[tuple], epoch: int) -> Column:
    """The steps of ``epoch`` that a row joins (:func:`_joined`), one a row (explode): struct of trial and step of the epoch."""

    @F.pandas_udf("array<bigint>")
    def draw(keys: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(keys))]
        for trial, rows, steps in _joined([str(k) for k in keys], trials, epoch):
            for r, s in zip(rows.tolist(), steps.tolist()):
                out[r].append(int(trial) << 40 | s)
        return pd.Series(out)

    return F.explode(F.transform(draw(F.col(key).cast("string")), lambda c: F.struct(
        F.shiftright(c, 40).cast("int").alias("trial"), c.bitwiseAND(F.lit((1 << 40) - 1).cast("long")).alias("local"))))


def _micro_id(key: Column, step: int | Column, m: int, seed) -> Column:
    """Microbatch 0 to m - 1 of a row in a step, by its md5 uniform."""
    step = step if isinstance(step, Column) else F.lit(int(step))
    return F.floor(uniform01(F.concat(key, F.lit("|m|"), step.cast("string"), F.lit(f"|{seed}"))) * F.lit(m)).cast("int")


def _micro_ids(keys: list[str], rows: np.ndarray, steps: np.ndarray, m: int, seed) -> np.ndarray:
    """:func:`_micro_id` of rows and their steps, inside a task."""
    got = [hashlib.md5(f"{keys[r]}|m|{s}|{seed}".encode()).digest()[:7] for r, s in zip(rows.tolist(), steps.tolist())]
    return np.floor(np.array([int.from_bytes(h, "big") >> 4 for h in got], np.float64) / 2.0 ** 52 * m)


def _logistic_step(batch: DataFrame, model: Logistic, params, cfg: FitConfig, micro_col: str | None, parts: int):
    """The same in one SQL job."""
    x, y = F.col("features"), F.col("label")
    p = model.score(x, params)
    wcol = F.col("weight") if "weight" in batch.columns else None
    g = vec.logistic_grad(x, y, p, wcol)
    loss = vec.bce(y, p) * (wcol if wcol is not None else F.lit(1.0))
    if micro_col is None:
        gc = vec.clip_l2(g, cfg.l2_norm_clip) if cfg.l2_norm_clip is not None else g
        agg = batch.select(gc.alias("g"), loss.alias("l")).agg(
            Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("l").alias("l"), F.count(F.lit(1)).alias("n"))
    else:
        per = batch.select(F.col(micro_col).alias("_m"), g.alias("g"), loss.alias("l")).groupBy("_m").agg(
            Summarizer.mean(array_to_vector("g")).alias("g"), F.sum("l").alias("l"), F.count(F.lit(1)).alias("n"))
        gm = vector_to_array("g")
        gc = vec.clip_l2(gm, cfg.l2_norm_clip) if cfg.l2_norm_clip is not None else gm
        agg = per.select(gc.alias("g"), "l", "n").agg(
            Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("l").alias("l"), F.sum("n").alias("n"))
    r = agg.select(vector_to_array("g").alias("g"), "l", "n").first()
    if r is None or r["g"] is None:
        return np.zeros(model.size), 0.0, 0
    return np.asarray(r["g"]), float(r["l"] or 0.0), int(r["n"] or 0)


COLLECT_PARTIALS_UP_TO = 64


def _batch_arrays(pdf: pd.DataFrame):
    X = np.stack(pdf["features"].to_numpy()).astype(np.float64)
    w = pdf["weight"].to_numpy().astype(np.float64) if "weight" in pdf else np.ones(len(X))
    return X, pdf["label"].to_numpy().astype(np.float64), w


def _loss_sum(prob, y, w) -> float:
    pr = np.clip(prob, 1e-7, 1 - 1e-7)
    return float((-(y * np.log(pr) + (1 - y) * np.log(1 - pr)) * w).sum())


def _reduced(partial: DataFrame, size: int, parts: int):
    """(Vector sum, loss sum, rows) of partial rows (g, l, n), one a partition.

    Up to 64 partials come to the driver (at most 64 x d values); more are
    first summed in Spark, in groups of about the square root of their number.
    """
    if parts > COLLECT_PARTIALS_UP_TO:
        partial = (partial.groupBy(F.pmod(F.spark_partition_id(), F.lit(min(math.isqrt(parts), COLLECT_PARTIALS_UP_TO))))
                   .agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("l").alias("l"), F.sum("n").alias("n"))
                   .select(vector_to_array("g").alias("g"), "l", "n"))
    rows = partial.collect()
    g = np.sum([np.asarray(r["g"]) for r in rows], axis=0) if rows else np.zeros(size)
    return g, float(sum(r["l"] for r in rows)), int(sum(r["n"] for r in rows))


def _numpy_step(batch: DataFrame, model, params, cfg: FitConfig, micro_col: str | None, parts: int):
    """One job: numpy gradients per partition (weights broadcast), then summed: (clipped sum, loss sum, rows).

    Without microbatches a partition with rows emits one clipped partial sum.
    With them it emits the plain gradient sum and rows of every microbatch it
    meets; these are added up by microbatch over all partitions, and only the
    whole microbatch's mean is clipped, so the result does not depend on how
    rows are dealt over partitions and Arrow batches.
    """
    bc = batch.sparkSession.sparkContext.broadcast(params)
    clip = cfg.l2_norm_clip
    cols = ["features", "label"] + (["weight"] if "weight" in batch.columns else [])

    def part(it):
        p = bc.value
        acc, loss, n = np.zeros(model.size), 0.0, 0
        for pdf in it:
            if len(pdf):
                X, y, w = _batch_arrays(pdf)
                acc += model.clipped_sum(p, X, y, w, clip)
                loss += _loss_sum(model.predict_np(p, X), y, w)
                n += len(y)
        if n:
            yield pd.DataFrame({"g": [acc], "l": [loss], "n": [n]})

    def by_microbatch(it):
        p, sums = bc.value, {}
        for pdf in it:
            if not len(pdf):
                continue
            X, y, w = _batch_arrays(pdf)
            prob = model.predict_np(p, X)
            micro = pdf[micro_col].to_numpy()
            for m in np.unique(micro):
                sel = micro == m
                g, loss, n = sums.get(m, (0.0, 0.0, 0))
                sums[m] = (g + model.gradient_sum(p, X[sel], y[sel], w[sel]), loss + _loss_sum(prob[sel], y[sel], w[sel]), n + int(sel.sum()))
        if sums:
            yield pd.DataFrame([(m, *v) for m, v in sums.items()], columns=["m", "g", "l", "n"])

    def clip_means(it):
        acc, loss, n = np.zeros(model.size), 0.0, 0
        for pdf in it:
            for g, l, k in zip(pdf["g"], pdf["l"], pdf["n"]):
                mean = np.asarray(g) / k
                norm = np.linalg.norm(mean)
                acc += mean if clip is None or norm <= clip else mean * (clip / norm)
                loss, n = loss + l, n + k
        if n:
            yield pd.DataFrame({"g": [acc], "l": [loss], "n": [n]})

    if micro_col is None:
        partial = batch.select(*cols).mapInPandas(part, "g array<double>, l double, n long")
    else:
        merged = (batch.select(*cols, micro_col).mapInPandas(by_microbatch, "m int, g array<double>, l double, n long")
                  .groupBy("m").agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("l").alias("l"), F.sum("n").alias("n")))
        partial = merged.select(vector_to_array("g").alias("g"), "l", "n").mapInPandas(clip_means, "g array<double>, l double, n long")
        parts = min(parts, cfg.microbatches)
    out = _reduced(partial, model.size, parts)
    bc.destroy()
    return out


class _Optimizer:
    def __init__(self, kind: str, lr: float, size: int):
        self.kind, self.lr, self.t = kind, lr, 0
        self.m = np.zeros(size)
        self.v = np.zeros(size)

    def update(self, params, g):
        self.t += 1
        if self.kind == "sgd":
            return params - self.lr * g
        if self.kind == "momentum":
            self.m = MOMENTUM * self.m + g
            return params - self.lr * self.m
        self.m = ADAM_B1 * self.m + (1 - ADAM_B1) * g
        self.v = ADAM_B2 * self.v + (1 - ADAM_B2) * g * g
        mh = self.m / (1 - ADAM_B1 ** self.t)
        vh = self.v / (1 - ADAM_B2 ** self.t)
        return params - self.lr * mh / (np.sqrt(vh) + ADAM_EPS)


def _collect_eval(res: "FitResult", pending) -> None:
    """Wait for a background evaluation and record its metrics under its epoch."""
    if pending is None:
        return
    epoch, step, fut = pending
    for k, v in fut.result().items():
        res.history.append({"epoch": epoch, "step": step, "metric": k, "value": float(v)})


def _by_step(sched: DataFrame, parts: int, key: str) -> DataFrame:
    """The schedule in ``parts`` parts by hash of the key, each sorted by step.

    Every part holds its share of every step, so ``parts`` tasks compute a
    step's gradient; inside a part the rows of a step lie together.
    """
    return sched.repartition(parts, F.xxhash64(key)).sortWithinPartitions("step")


class _Schedule:
    """The schedule of one epoch, written to the shared checkpoint folder, kept, and removed when done.

    The written table cuts the lineage (a lost executor re-reads it instead
    of drawing again), a step's ``step = s`` filter is pushed to the scan,
    and the kept copy has a plain scan plan, so per-step planning stays cheap.
    """

    def __init__(self, df: DataFrame, held: list[DataFrame]):
        from dpframe.session import checkpoint_dir
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/schedule-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        for h in held:
            h.unpersist()
        self.rows = self.spark.read.schema(df.schema).parquet(self.path).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()

    def remove(self) -> None:
        from dpframe.session import remove_folder
        self.rows.unpersist()
        remove_folder(self.spark, self.path)


def _parts(data: DataFrame, batch: int) -> int:
    """Tasks of a step: one for every ``ROWS_PER_TASK`` rows of the batch, at most four a core."""
    return max(1, min(4 * data.sparkSession.sparkContext.defaultParallelism, -(-batch // ROWS_PER_TASK)))


def noise_stream(seed, trial: int | str = "") -> np.random.Generator:
    """Random stream of one trial: 256 bits from the whole seed text and the trial, so no two trials share draws."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{trial}".encode()).digest(), "little"))


def step_noise(seed, trial: int | str, step: int, size: int) -> np.ndarray:
    """``size`` standard normals of one step: Box-Muller on md5(seed|trial|step|pair), 52 bits a uniform.

    The draws depend on nothing but these four, so SQL can repeat them, and
    no two trials or steps share any. The seed is secret: 256 random bits
    unless given.
    """
    return steps_noise(seed, trial, range(step, step + 1), size)[0]


def steps_noise(seed, trial: int | str, steps: range, size: int) -> np.ndarray:
    """:func:`step_noise` of each of ``steps``, one row a step."""
    pairs = -(-size // 2)
    h = np.frombuffer(b"".join([hashlib.md5(f"{seed}|{trial}|{step}|{j}".encode()).digest() for step in steps for j in range(pairs)]), ">u8").astype(np.uint64)
    top, low = h.reshape(len(steps), pairs, 2).transpose(2, 0, 1)   # 52 bits from the first, the next 52 across both
    u1 = np.maximum((top >> np.uint64(12)).astype(np.float64) / 2.0 ** 52, 2.0 ** -53)
    u2 = (((top & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))).astype(np.float64) / 2.0 ** 52
    r = np.sqrt(-2.0 * np.log(u1))
    return np.stack([r * np.cos(2 * math.pi * u2), r * np.sin(2 * math.pi * u2)], axis=2).reshape(len(steps), 2 * pairs)[:, :size]


class _Descent:
    """Parameters and optimizer state of one trial; the noise is added here, once a step."""

    def __init__(self, cfg: FitConfig, model, seed, trial: int | str = ""):
        self.cfg, self.model, self.seed, self.trial = cfg, model, seed, trial
        self.params = model.init(noise_stream(seed, trial))
        self.opt = _Optimizer(cfg.optimizer, cfg.learning_rate, model.size)
        self.sigma = (cfg.l2_norm_clip or 0.0) * cfg.noise_multiplier

    def apply(self, gsum: np.ndarray, rows: int, step: int, noise: np.ndarray | None = None) -> None:
        """One update from the summed gradients of a batch of ``rows`` rows; ``noise``: the step's, if drawn already."""
        cfg = self.cfg
        if self.sigma > 0:
            gsum = gsum + self.sigma * (step_noise(self.seed, self.trial, step, len(gsum)) if noise is None else noise)
        g = gsum / (max(rows, 1) if cfg.l2_norm_clip is None or cfg.full_batch else cfg.microbatches or cfg.batch_size)
        if cfg.l2_reg:
            g = g + cfg.l2_reg * self.params
        self.params = self.opt.update(self.params, g)

    def step(self, batch: DataFrame, step: int, key: str, parts: int) -> tuple[float, int]:
        """Gradient job of one step's batch and its update: (loss sum, rows)."""
        cfg = self.cfg
        micro = None
        if cfg.microbatches:
            batch = batch.withColumn("_micro", _micro_id(F.col(key), step, cfg.microbatches, self.seed))
            micro = "_micro"
        run = _logistic_step if cfg.model == "logistic" and cfg.step_engine == "sql" else _numpy_step
        gsum, lsum, rows = run(batch, self.model, self.params, cfg, micro, parts)
        self.apply(gsum, rows, step)
        return lsum, rows


    def train_block(self, batches, steps: range) -> list[tuple[int, float, int]]:
        """Steps ``steps`` one after another, ``batches`` giving (X, y, w, microbatch, |x|^2 + 1) of each: [(step, loss sum, rows)].

        Runs inside a task. The losses of private runs are not computed.
        """
        cfg, out = self.cfg, []
        at_once = max(1, NOISE_VALUES // self.model.size)
        noise = (z for i in range(0, len(steps), at_once) for z in steps_noise(self.seed, self.trial, steps[i:i + at_once], self.model.size)) \
            if self.sigma > 0 else itertools.repeat(None)
        for step, z, (X, y, w, micro, sq) in zip(steps, noise, batches):
            loss = _loss_sum(self.model.predict_np(self.params, X), y, w) if len(y) and self.sigma == 0 else 0.0
            if not len(y):
                g = np.zeros(self.model.size)
            elif not cfg.microbatches:
                g = self.model.clipped_sum(self.params, X, y, w, cfg.l2_norm_clip, sq)
            else:
                g = np.zeros(self.model.size)
                for m in np.unique(micro):
                    mine = micro == m
                    mean = self.model.gradient_sum(self.params, X[mine], y[mine], w[mine]) / mine.sum()
                    norm = np.linalg.norm(mean)
                    g += mean if cfg.l2_norm_clip is None or norm <= cfg.l2_norm_clip else mean * (cfg.l2_norm_clip / norm)
            self.apply(g, len(y), step, z)
            out.append((step, loss, len(y)))
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same values in the narrowest of a few types that holds them all."""
    return next((y for kind in (np.int8, np.float32) if np.array_equal(y := x.astype(kind), x)), x)


def _pack(it):
    """Rows as pickled arrays, one row an Arrow batch: keys, features (of their own type), and label and weight."""
    for pdf in it:
        if len(pdf):
            with np.errstate(invalid="ignore"):
                rest = [_narrow(pdf[c].to_numpy(np.float64)) for c in ("label", "weight") if c in pdf]
            part = [str(k) for k in pdf["key"]], np.stack(pdf["features"].to_numpy()), rest
            yield pd.DataFrame({"part": [pickle.dumps(part)]})


def _held(data: DataFrame, key: str, parts: int):
    """RDD of the rows in order of their keys, packed (:func:`_pack`); where they lie does not depend on ``parts``."""
    rows = data.repartitionByRange(parts, key).sortWithinPartitions(key)
    packed = rows.withColumn("key", F.col(key).cast("string")).mapInPandas(_pack, "part binary")
    return packed.rdd.map(lambda r: pickle.loads(r["part"])).persist(StorageLevel.MEMORY_AND_DISK)


class _Blocks:
    """One epoch of some trials: their batches dealt by (block of consecutive steps, group of trials).

    Partition ``block * groups + group`` holds the rows of a block of a few
    trials (of one, unless there are many more trials than cores) in shuffle
    files, packed: (place of the rows in ``held``, steps of the block, features,
    label, weight and microbatch, trial); a job reads one block of every trial.
    """

    def __init__(self, held, drawn: list[tuple], descents: list["_Descent"], epoch: int):
        self.epoch, self.micro = epoch, bool(descents[0].cfg.microbatches)
        self.per = per = max(1, min(TRIALS_PER_TASK, -(-len(descents) // (3 * held.context.defaultParallelism))))
        self.groups = groups = -(-len(descents) // per)
        self.steps = {t: S for t, _, S, E, _ in drawn if epoch <= E}
        self.sizes = [max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, d.model.d)) // d.cfg.batch_size) for d in descents]
        sizes, m, seed = self.sizes, descents[0].cfg.microbatches, descents[0].seed

        def deal(index, it):
            for piece, (keys, X, rest) in enumerate(it):
                bits = len(keys).bit_length()
                for trial, row, at in _joined(keys, drawn, epoch):
                    both = np.sort(at << bits | row)                           # in order of steps, then of keys
                    row, at = both & ((1 << bits) - 1), both >> bits
                    x, r = X[row], [c[row] for c in rest]
                    if m:
                        r.append(_micro_ids(keys, row, at + (epoch - 1) * drawn[0][2], m, seed))
                    block = at // sizes[trial]
                    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        if b > a:
                            local = (at[a:b] - block[a] * sizes[trial]).astype(np.min_scalar_type(sizes[trial]))
                            yield int(block[a]) * groups + trial // per, ((index, piece), local, x[a:b], [c[a:b] for c in r], trial)

        # numPartitions may be raised, never lowered: the number of a partition is its key
        self.rows = held.mapPartitionsWithIndex(deal).partitionBy(max(self.blocks().values()) * groups, lambda k: k).values()
        self.rows.context.runJob(self.rows, lambda it: [], [0])                # the draws, and one task that reads nothing

    def blocks(self) -> dict[int, int]:
        """Blocks of each trial that runs this epoch."""
        return {t: -(-S // self.sizes[t]) for t, S in self.steps.items()}

    def train(self, descents: list["_Descent"]) -> dict[int, list]:
        """Train the epoch, one job for the next block of every trial: {trial: [(step, loss sum, rows)]}."""
        per, groups, sizes, steps, epoch, micro = self.per, self.groups, self.sizes, self.steps, self.epoch, self.micro
        blocks, done = self.blocks(), {t: [] for t in self.steps}
        for block in range(max(blocks.values())):
            now = {t: descents[t] for t, k in blocks.items() if block < k}

            def run(index, it):
                group = {t: [] for t in now if t // per == index % groups}
                for p in it:
                    group[p[4]].append(p)
                for t in list(group):
                    start, stop = block * sizes[t], min((block + 1) * sizes[t], steps[t])
                    batches = _batches(group.pop(t), stop - start, now[t].model.d, micro)
                    yield t, now[t], now[t].train_block(batches, range((epoch - 1) * steps[t] + start, (epoch - 1) * steps[t] + stop))

            sc = self.rows.context
            for t, after, losses in sc.runJob(self.rows.mapPartitionsWithIndex(run), list, sorted({block * groups + t // per for t in now})):
                descents[t].params, descents[t].opt = after.params, after.opt
                done[t] += losses
        self.rows._jrdd.rdd().cleanShuffleDependencies(False)                  # an epoch's files go when it is trained
        return done


def _batches(it, steps: int, d: int, micro: bool):
    """(X, y, w, microbatch, |x|^2 + 1) of each of the ``steps`` of a block from its packed rows; a step without rows gives empty ones."""
    parts = sorted(it, key=lambda p: p[0]) or [(None, np.empty(0, np.int64), np.empty((0, d)), [np.empty(0)])]
    at = np.concatenate([p[1] for p in parts])
    order = np.argsort(at, kind="stable")
    X = np.concatenate([p[2] for p in parts])[order].astype(np.float64)
    rest = [np.concatenate(c)[order].astype(np.float64) for c in zip(*(p[3] for p in parts))]
    y, w = rest[0], rest[1] if len(rest) > 1 + micro else np.ones(len(order))
    sq = (X * X).sum(1) + 1.0
    cuts = np.searchsorted(at[order], np.arange(steps + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield X[a:b], y[a:b], w[a:b], rest[-1][a:b], sq[a:b]


def epsilon_schedule(cfg: FitConfig, n: int) -> list[float]:
    """A5: epsilon after each epoch (data-independent, known before training).

    With microbatches a changed row can move its microbatch's clipped mean by
    twice the clip norm, so the noise counts half.
    """
    if cfg.noise_multiplier <= 0 or cfg.l2_norm_clip is None:
        return [0.0] * cfg.epochs
    delta = cfg.delta if cfg.delta is not None else 1.0 / n
    out = []
    batch = n if cfg.full_batch else cfg.batch_size
    noise = cfg.noise_multiplier / 2 if cfg.microbatches else cfg.noise_multiplier
    for e in range(1, cfg.epochs + 1):
        if cfg.accountant == "gdp":
            out.append(gdp_epsilon(gdp_mu(n, batch, e, noise), delta))
        else:
            out.append(rdp_epsilon(n, batch, e, noise, delta))
    return out


# ------------------------------------------------------------------ durable state

STATE_SCHEMA = ("run string, epoch int, step long, params array<double>, m array<double>, v array<double>, updates long, "
                "epsilon double, history array<struct<epoch: int, step: long, metric: string, value: double>>")


class TrainingState:
    """Table of a run's state after each epoch, in a folder that outlives the driver.

    One row an epoch: parameters, optimizer moments, steps, spent budget and
    the epoch's metrics. Rows are only appended. A run is known by its
    configuration (without the number of epochs and the budget, so it may be
    prolonged), the data's size and, if one was given, the seed. A fresh
    secret seed is never stored: a run that goes on without one draws its
    further noise and batches anew, which is as private.
    """

    def __init__(self, spark, path: str, cfg: FitConfig, d: int, n: int):
        known = repr(sorted((k, v) for k, v in cfg.__dict__.items() if k not in ("epochs", "budget"))) + f"|{d}|{n}"
        self.spark, self.path, self.run = spark, path, hashlib.sha256(known.encode()).hexdigest()

    def load(self):
        """Rows of the run's epochs in order (none: not begun); an epoch written twice counts once."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(STATE_SCHEMA).parquet(self.path).where(F.col("run") == self.run).dropDuplicates(["epoch"])
        return rows.orderBy("epoch").collect()          # one row of d values an epoch

    def append(self, epoch: int, step: int, descent: "_Descent", epsilon: float, history: list[dict]) -> None:
        o = descent.opt
        row = (self.run, epoch, step, descent.params.tolist(), o.m.tolist(), o.v.tolist(), o.t, float(epsilon),
               [(h["epoch"], h["step"], h["metric"], float(h["value"])) for h in history])
        self.spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def _resume(saved, descent: "_Descent", res: FitResult) -> tuple[int, int]:
    """Set parameters, moments and history to the last saved epoch: (that epoch, steps run)."""
    if not saved:
        return 0, 0
    last = saved[-1]
    descent.params = np.array(last["params"])
    descent.opt.m, descent.opt.v, descent.opt.t = np.array(last["m"]), np.array(last["v"]), int(last["updates"])
    res.history = [h.asDict() for r in saved for h in r["history"]]
    return int(last["epoch"]), int(last["step"])


# ------------------------------------------------------------------ the loop

def _input(train: DataFrame, key: str):
    """(key, features, label[, weight]) rows, features and rows."""
    data = train.select(*[key, "features", "label"] + (["weight"] if "weight" in train.columns else []))
    first = data.agg(F.max(F.size("features")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return data, int(first["d"]), int(first["n"])


def _spread(cfg: FitConfig) -> bool:
    """Whether every step is a job of its own, spread over several tasks."""
    return cfg.full_batch or cfg.batch_size > SPREAD_FROM or (cfg.model == "logistic" and cfg.step_engine == "sql")


def _block_epochs(data: DataFrame, descents: list["_Descent"], key: str, n: int, steps: list[int], first: int, last: list[int]):
    """Train the trials' epochs ``first`` to ``last`` of ``steps`` Poisson batches each, side by side and in blocks; yields (epoch, {trial: [(step, loss sum, rows)]}).

    The rows are dealt once. One epoch's batches are held, and the next are
    drawn in the background meanwhile.
    """
    parts = max(data.sparkSession.sparkContext.defaultParallelism, -(-n // DRAW_ROWS), -(-n * len(descents) // DRAW_MEMBERS))
    held = _held(data, key, parts)
    drawn = [(t, min(1.0, d.cfg.batch_size / n), steps[t], last[t], d.seed) for t, d in enumerate(descents)]
    with ThreadPoolExecutor(max_workers=1) as pool:
        draw = lambda epoch: _Blocks(held, drawn, descents, epoch)
        coming = pool.submit(draw, first)
        for epoch in range(first, max(last) + 1):
            now = coming.result()
            if epoch < max(last):
                coming = pool.submit(draw, epoch + 1)
            yield epoch, now.train(descents)
    held.unpersist()


def _epochs(data: DataFrame, descent: "_Descent", key: str, n: int, steps: int, first: int, last: int):
    """Train epochs ``first`` to ``last`` of ``steps`` Poisson batches (or of the full batch) each; yields (epoch, [(step, loss sum, rows)]).

    The rows are dealt once. One epoch's schedule is held, and the next is
    drawn in the background meanwhile.
    """
    cfg = descent.cfg
    if first > last:
        return
    if not _spread(cfg):
        yield from ((epoch, done[0]) for epoch, done in _block_epochs(data, [descent], key, n, [steps], first, [last]))
        return
    parts = _parts(data, n if cfg.full_batch else cfg.batch_size)
    held = data.repartition(parts, F.xxhash64(key)).persist(StorageLevel.MEMORY_AND_DISK)
    q = min(1.0, cfg.batch_size / n)

    def draw(epoch: int) -> _Schedule:
        sched, states = poisson_schedules(held, key, [(0, q, steps, last, str(descent.seed))], epoch=epoch)
        return _Schedule(_by_step(sched.drop("_trial", "_local", "epoch"), parts, key), states)

    if cfg.full_batch:
        for epoch in range(first, last + 1):
            yield epoch, [(epoch - 1, *descent.step(held, epoch - 1, key, parts))]
    else:
        with ThreadPoolExecutor(max_workers=1) as pool:
            coming = pool.submit(draw, first)
            for epoch in range(first, last + 1):
                sched = coming.result()
                if epoch < last:
                    coming = pool.submit(draw, epoch + 1)
                done = []
                for step in range((epoch - 1) * steps, epoch * steps):
                    done.append((step, *descent.step(sched.rows.where(F.col("step") == step), step, key, parts)))
                sched.remove()
                yield epoch, done
    held.unpersist()


def fit(train: DataFrame, cfg: FitConfig, evaluate_on: DataFrame | None = None, eval_every: int = 1, threshold: float = 0.5,
        key: str = "key", state: str | None = None) -> FitResult:
    """Train on ``train(key, features, label[, weight])``.

    Returns the parameters, a history and epsilon per epoch. With
    ``evaluate_on`` the model is scored after each epoch (loss, AUROC/AUPRC on
    200 thresholds, accuracy at ``threshold``). Batch losses are exact values
    of private rows, so only runs without noise report them. ``state`` names a
    folder for :class:`TrainingState`: epochs found there are not run again.
    """
    from dpframe.operators import evaluate as ev

    cfg.validate()
    seed = cfg.seed if cfg.seed is not None else secrets.token_hex(32)
    data, d, n = _input(train, key)
    ev_data = None
    if evaluate_on is not None:
        ev_data = evaluate_on.select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    model = make_model(cfg, d)
    descent = _Descent(cfg, model, seed)
    steps = 1 if cfg.full_batch else max(1, n // cfg.batch_size)
    eps = epsilon_schedule(cfg, n)
    over = [i + 1 for i, e in enumerate(eps) if cfg.budget is not None and e > cfg.budget]
    stop = over[0] if over else cfg.epochs
    res = FitResult(params=descent.params, epsilon=eps[:stop], stopped_epoch=stop if stop < cfg.epochs else None)
    saved = TrainingState(data.sparkSession, state, cfg, d, n) if state else None
    done, total = _resume([r for r in saved.load() if r["epoch"] <= stop] if saved else [], descent, res)
    private = descent.sigma > 0
    pool = ThreadPoolExecutor(max_workers=1)
    pending = None
    began = time.time()
    for epoch, losses in _epochs(data, descent, key, n, steps, done + 1, stop):
        at = len(res.history)
        for step, loss, rows in losses:
            total += 1
            if not private:
                res.history.append({"epoch": epoch, "step": step, "metric": "batch_loss", "value": loss / max(rows, 1)})
        res.history.append({"epoch": epoch, "step": total, "metric": "epsilon", "value": eps[epoch - 1]})
        if ev_data is not None and (epoch % eval_every == 0 or epoch == stop):
            # A snapshot of this epoch's parameters is evaluated in the background while the next
            # epoch trains (one evaluation in flight); a saved epoch waits for its metrics.
            _collect_eval(res, pending)
            snap = descent.params.copy()
            pending = (epoch, total, pool.submit(
                lambda p=snap: ev.epoch_metrics(score(ev_data, model, p), threshold)))
            if saved:
                _collect_eval(res, pending)
                pending = None
        res.history.append({"epoch": epoch, "step": total, "metric": "epoch_seconds", "value": time.time() - began})
        if saved:
            saved.append(epoch, total, descent, eps[epoch - 1], res.history[at:])
        began = time.time()
    _collect_eval(res, pending)
    pool.shutdown()
    if ev_data is not None:
        ev_data.unpersist()
    res.params, res.steps = descent.params, total
    res.model = model  # type: ignore[attr-defined]
    return res


def run_steps(train: DataFrame, cfg: FitConfig, epochs: int, steps_per_epoch: int, key: str = "key", state: str | None = None) -> np.ndarray:
    """Parameters after ``epochs`` x ``steps_per_epoch`` steps of the loop in :func:`fit`.

    For checks against SQL: the number of steps is given, so nothing is
    accounted or evaluated, and the result must not be released.
    """
    cfg.validate()
    seed = cfg.seed if cfg.seed is not None else secrets.token_hex(32)
    data, d, n = _input(train, key)
    descent = _Descent(cfg, make_model(cfg, d), seed)
    saved = TrainingState(data.sparkSession, state, cfg, d, n) if state else None
    done, _ = _resume(saved.load() if saved else [], descent, FitResult(params=descent.params))
    for epoch, _ in _epochs(data, descent, key, n, steps_per_epoch, done + 1, epochs):
        if saved:
            saved.append(epoch, epoch * steps_per_epoch, descent, 0.0, [])
    return descent.params


def score(df: DataFrame, model, params) -> DataFrame:
    """Add ``score`` (P(y=1)). Logistic: SQL; MLP: pandas UDF with broadcast weights."""
    if isinstance(model, Logistic):
        return df.withColumn("score", model.score(F.col("features"), params))
    bc = df.sparkSession.sparkContext.broadcast(params)

    @F.pandas_udf(T.DoubleType())
    def _score(feats: pd.Series) -> pd.Series:
        X = np.stack(feats.to_numpy()).astype(np.float64)
        return pd.Series(model.predict_np(bc.value, X))

    return df.withColumn("score", _score(F.col("features")))


def history_frame(spark, res: FitResult, run_id: str) -> DataFrame:
    """Training history as a long metrics table (run_id, key, step, epoch, value)."""
    rows = [(run_id, h["metric"], int(h["step"]), int(h["epoch"]), float(h["value"])) for h in res.history]
    return spark.createDataFrame(rows, "run_id string, key string, step int, epoch int, value double")


# ------------------------------------------------------------------ H3: many trials at once

def _epoch_batches(held: DataFrame, key: str, trials: list[tuple], epoch: int, parts: int) -> _Schedule:
    """Rows (features, label[, weight], at) of one epoch; ``at`` maps a step of the epoch to the trials whose batch holds the row.

    Only keys go through the draws and their grouping: a row's features are
    there once, whatever the number of trials, and a step needs no shuffle.
    """
    drawn, states = poisson_schedules(held.select(key), key, trials, epoch=epoch)
    at = (drawn.groupBy(key, "_local").agg(F.collect_list("_trial").alias("t"))            # at most the trials
          .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_local", "t"))).alias("at")))
    return _Schedule(held.join(at, key).drop(key).repartition(parts), states)


def fit_grid(train: DataFrame, configs: list[FitConfig], key: str = "key") -> list[FitResult]:
    """H3: train every (logistic) trial together over one cached input (key, features, label[, weight]).

    The next block of steps of all trials is one job, a task a trial. Where a
    batch is over ``SPREAD_FROM`` rows, each step is one job for all
    still-running trials: rows in no batch are dropped by a filter on the
    row's schedule, and one ``mapInPandas`` pass emits per partition a
    (trials x d) partial gradient block; noise and updates happen per trial
    on the driver. Trials that have finished their steps drop out. Keys must
    be unique.
    """
    for c in configs:
        c.validate()
        if c.model != "logistic":
            raise ValueError("fit_grid trains logistic trials; use fit() for the MLP")
        if c.microbatches is not None or c.full_batch:
            raise ValueError("fit_grid clips per example of Poisson batches; use fit() for microbatches and full batches")
    data, d, n = _input(train, key)
    model = Logistic(d)
    seeds = [c.seed if c.seed is not None else secrets.token_hex(32) for c in configs]
    trials = [_Descent(c, model, s, i) for i, (c, s) in enumerate(zip(configs, seeds))]
    spe = [max(1, n // c.batch_size) for c in configs]
    spent = [epsilon_schedule(c, n) for c in configs]
    stops = [next((i + 1 for i, e in enumerate(eps) if c.budget is not None and e > c.budget), c.epochs) for c, eps in zip(configs, spent)]
    results = [FitResult(params=trials[i].params, epsilon=spent[i][:stops[i]]) for i in range(len(configs))]
    if not any(_spread(c) for c in configs):
        for _, done in _block_epochs(data, trials, key, n, spe, 1, stops):
            for i, losses in done.items():
                results[i].steps += len(losses)
        return _with_params(results, trials, model)
    # the trials share the rows: a step's work is that of all their batches
    parts = _parts(data, sum(c.batch_size for c in configs))
    held = data.repartition(parts, F.xxhash64(key)).persist(StorageLevel.MEMORY_AND_DISK)
    drawn = [(i, min(1.0, c.batch_size / n), spe[i], stops[i], seeds[i]) for i, c in enumerate(configs)]
    sc = data.sparkSession.sparkContext
    cols = ["features", "label"] + (["weight"] if "weight" in data.columns else [])

    def run(rows: DataFrame, local: int, active: list[int]):
        slot = np.full(len(configs), -1)
        slot[active] = np.arange(len(active))
        bc = sc.broadcast(np.stack([trials[i].params for i in active]))
        clips = [configs[i].l2_norm_clip for i in active]

        def part(it):
            acc, cnt = np.zeros((len(active), model.size)), np.zeros(len(active))
            for pdf in it:
                if not len(pdf):
                    continue
                X, y, w = _batch_arrays(pdf)
                size = pdf["t"].map(len).to_numpy()
                row, j = np.repeat(np.arange(len(X)), size), slot[np.concatenate(pdf["t"].to_numpy())]
                for k in np.unique(j):
                    m = row[j == k]
                    acc[k] += model.clipped_sum(bc.value[k], X[m], y[m], w[m], clips[k])
                    cnt[k] += len(m)
            if cnt.any():
                yield pd.DataFrame({"g": [acc.ravel()], "n": [cnt]})

        # a block of (trials x d) values a partition, of which there are at most four a core
        got = rows.select(*cols, F.element_at("at", F.lit(local).cast("long")).alias("t")).where("t is not null") \
            .mapInPandas(part, "g array<double>, n array<double>").collect()
        bc.destroy()
        G, N = np.zeros((len(active), model.size)), np.zeros(len(active))
        for r in got:
            G += np.asarray(r["g"]).reshape(G.shape)
            N += np.asarray(r["n"])
        return G, N

    with ThreadPoolExecutor(max_workers=1) as pool:
        draw = lambda e: _epoch_batches(held, key, drawn, e, parts)
        coming = pool.submit(draw, 1)
        for epoch in range(1, max(stops) + 1):
            sched = coming.result()
            if epoch < max(stops):
                coming = pool.submit(draw, epoch + 1)
            running = [i for i in range(len(configs)) if epoch <= stops[i]]
            for local in range(max(spe[i] for i in running)):
                active = [i for i in running if local < spe[i]]
                G, N = run(sched.rows, local, active)
                for j, i in enumerate(active):
                    trials[i].apply(G[j], int(N[j]), (epoch - 1) * spe[i] + local)
                    results[i].steps += 1
            sched.remove()
    held.unpersist()
    return _with_params(results, trials, model)


def _with_params(results: list[FitResult], trials: list[_Descent], model) -> list[FitResult]:
    for r, t in zip(results, trials):
        r.params = t.params
        r.model = model  # type: ignore[attr-defined]
    return results
