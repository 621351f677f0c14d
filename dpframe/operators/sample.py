"""Splitting, sampling and batching (T1–T11) with exact sizes.

Two primitives carry everything:

* :func:`mark_first` marks, per group, the ``n`` rows with the smallest
  order token (md5 of key and seed). It is a *radix select*: histograms of
  successive 4-hex-digit hash prefixes find the boundary bucket, only the
  tokens of that bucket are ever ordered, and the result is a plain filter
  ``token <= threshold``. No row is shuffled; only per-bucket counts
  (map-side combined) move. A hot group (a third of all rows) is just more
  rows in the same histogram. Where a key is repeated at the boundary, its
  rows are told apart by a second select on a hash of the whole row, and rows
  equal in all columns by counting them, so that exactly ``n`` are marked.
* :func:`hash_rank` gives every row its exact 1-based rank in token order.
  Rows are spread over 65,536 hash buckets per group; a broadcast table of
  bucket offsets (size bounded by groups x 65,536) plus a window inside each
  bucket gives the rank. No window ever runs over a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpframe.keys import GROUP, TOKEN, group_key, order_token, uniform_int

HEX_PER_LEVEL = 4              # widest radix level: 65,536 buckets
FIRST_LEVEL_HEX = 2            # level 0: 256 buckets (partial aggregation stays tiny)
FINISH_ROWS = 100_000          # boundary sets up to this size are ordered directly
MAX_LITERAL_GROUPS = 100_000   # thresholds are shipped as a map literal
RANK_BUCKET_ROWS = 50_000      # target rows per window partition in hash_rank
MAX_BROADCAST_ROWS = 1 << 19   # bucket-offset table broadcast only below this many rows


def _width_for(rows: int, target: int) -> int:
    """Hex digits so that rows / 16^w is about ``target`` (1..HEX_PER_LEVEL)."""
    w = 1
    while w < HEX_PER_LEVEL and rows / (16 ** w) > target:
        w += 1
    return w


def _group_sizes(df: DataFrame) -> dict[str, int]:
    return {r[0]: r[1] for r in df.groupBy(GROUP).count().collect()}


MD5_HEX = 32


class Cut(NamedTuple):
    """Boundary of a group: its token, how many of the rows with it are wanted, and how many there are."""

    token: str
    need: int
    ties: int


def _thresholds(df: DataFrame, wanted, totals: dict | None = None, check=None) -> dict[str, Cut | None | bool]:
    """Per group, the :class:`Cut` at the ``wanted``-th smallest row (radix select); None: all rows, False: no row.

    ``wanted`` is a mapping group -> n, an int, or a function of the group
    size column (e.g. ``lambda total: ceil(f * total)``). Each level is one
    job: a histogram of the next 4 hex digits under the current prefix, a
    window over that bounded histogram to find the boundary bucket, and a
    collect of one row per group. Level 0 also yields the group sizes. The
    later levels read only the tokens of the boundary buckets (about one row
    in 256), kept after one more pass, so all rows are hashed twice, whatever
    the number of levels.
    """
    if callable(wanted):
        want0 = wanted
    elif isinstance(wanted, Mapping):
        m = F.create_map(*[x for g, n in wanted.items() for x in (F.lit(g), F.lit(int(n)))])
        want0 = lambda total: F.coalesce(F.element_at(m, F.col(GROUP)), F.lit(0))
    else:
        want0 = lambda total: F.lit(int(wanted))
    out: dict[str, Cut | None | bool] = {}
    state = {}
    level0 = _level(df, 0, None, want0, FIRST_LEVEL_HEX)
    if totals is not None:
        totals.update({g: total for g, total, _, _ in level0})
        if check is not None:
            check(totals)
    for g, total, want, bnd in level0:
        if want <= 0:
            out[g] = False
        elif want >= total:
            out[g] = None
        else:
            state[g] = (bnd[0], bnd[1], bnd[2])
    near = _within(df, state).select(GROUP, TOKEN).persist(StorageLevel.MEMORY_AND_DISK) if state else None
    while state:
        # beyond the md5 digits only rows of one md5 are left, however many: few tokens
        small = {g: s for g, s in state.items() if s[2] <= FINISH_ROWS or len(s[0]) >= MD5_HEX}
        big = {g: s for g, s in state.items() if g not in small}
        if small:
            out.update(_finish(near, small))
        if not big:
            break
        plen = len(next(iter(big.values()))[0])
        rank = F.create_map(*[x for g, s in big.items() for x in (F.lit(g), F.lit(int(s[1])))])
        width = _width_for(max(s[2] for s in big.values()), FINISH_ROWS // 4)
        rows = _level(near, plen, big, lambda total: F.element_at(rank, F.col(GROUP)), width)
        state = {g: (big[g][0] + bnd[0], bnd[1], bnd[2]) for g, _, _, bnd in rows}
    if near is not None:
        near.unpersist()
    return out


def _within(df: DataFrame, groups: Mapping[str, tuple]) -> DataFrame:
    """The rows whose token begins with their group's prefix (one length for all groups)."""
    plen = len(next(iter(groups.values()))[0])
    return df.where(F.concat(F.col(GROUP), F.lit("#"), F.substring(TOKEN, 1, plen)).isin([f"{g}#{s[0]}" for g, s in groups.items()]))


def _level(df: DataFrame, plen: int, active: Mapping | None, want_fn, width: int = HEX_PER_LEVEL):
    """One radix level: (group, total, want, (bucket, rank in bucket, bucket size))."""
    sel = df
    if active is not None:
        sel = _within(df, active)
    nxt = F.substring(TOKEN, plen + 1, width)
    hist = sel.groupBy(GROUP, nxt.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(GROUP)
    h = (hist.withColumn("_cum", F.sum("_c").over(wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_tot", F.sum("_c").over(wg)))
    h = h.withColumn("_want", want_fn(F.col("_tot")).cast("long"))
    hit = F.when(F.col("_cum") >= F.col("_want"),
                 F.struct(F.col("_b"), (F.col("_want") - F.col("_cum") + F.col("_c")).alias("r"), F.col("_c")))
    rows = h.groupBy(GROUP).agg(F.max("_tot"), F.max("_want"), F.min(hit)).collect()
    return [(r[0], r[1], r[2], tuple(r[3]) if r[3] is not None else None) for r in rows]


def _finish(df: DataFrame, groups: Mapping[str, tuple]) -> dict[str, Cut]:
    """Count the (bounded) boundary tokens in order and read off the wanted one."""
    out = {}
    for plen in {len(p) for p, _, _ in groups.values()}:
        mine = {g: s for g, s in groups.items() if len(s[0]) == plen}
        rank_map = F.create_map(*[x for g, (_, r, _) in mine.items() for x in (F.lit(g), F.lit(int(r)))])
        sub = _within(df, mine)
        upto = Window.partitionBy(GROUP).orderBy(TOKEN).rowsBetween(Window.unboundedPreceding, 0)
        want = F.element_at(rank_map, F.col(GROUP))
        rows = (sub.groupBy(GROUP, TOKEN).agg(F.count(F.lit(1)).alias("_c")).withColumn("_cum", F.sum("_c").over(upto))
                .where((F.col("_cum") >= want) & (F.col("_cum") - F.col("_c") < want))
                .select(GROUP, TOKEN, want - F.col("_cum") + F.col("_c"), "_c").collect())
        out.update({r[0]: Cut(r[1], int(r[2]), int(r[3])) for r in rows})
    return out


def _by_group(cuts: Mapping, value) -> Column:
    return F.element_at(F.create_map(*[x for g, c in cuts.items() for x in (F.lit(g), F.lit(value(c)))]), F.col(GROUP))


def _keep_expr(thr: Mapping[str, Cut | None | bool]) -> Column:
    """Rows up to the boundary; of a boundary token with more rows than wanted, none."""
    if len(thr) > MAX_LITERAL_GROUPS:
        raise ValueError("too many groups for literal thresholds; use split_by or hash_rank")
    keep_all = [g for g, t in thr.items() if t is None]
    cond = F.col(GROUP).isin(keep_all) if keep_all else F.lit(False)
    whole = {g: t for g, t in thr.items() if t and t.need == t.ties}
    over = {g: t for g, t in thr.items() if t and t.need < t.ties}
    if whole:
        cond = cond | (F.col(TOKEN) <= _by_group(whole, lambda t: t.token))
    if over:
        cond = cond | (F.col(TOKEN) < _by_group(over, lambda t: t.token))
    return F.coalesce(cond, F.lit(False))


ROW_SEED = "whole row"


def _mark(df: DataFrame, thr: Mapping[str, Cut | None | bool], flag: str) -> DataFrame:
    """``df`` with ``flag``: the row is one of the wanted; exact also where a token is repeated at the boundary."""
    over = {g: t for g, t in thr.items() if t and t.need < t.ties}
    if not over:
        return df.withColumn(flag, _keep_expr(thr))
    tied = F.coalesce(F.col(TOKEN) == _by_group(over, lambda t: t.token), F.lit(False))
    rest = df.where(~tied).withColumn(flag, _keep_expr(thr))
    cols = [c for c in df.columns if c != TOKEN]
    ties = df.where(tied)
    # rows of one key: a second select on a hash of the whole row
    text = F.concat_ws("\u0001", *[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in cols if c != GROUP])
    rows = ties.withColumn("_token", F.col(TOKEN)).withColumn(TOKEN, F.md5(F.concat(text, F.lit(f"-{ROW_SEED}"))))
    second = _thresholds(rows, {g: t.need for g, t in over.items()})
    equal = {g: t for g, t in second.items() if t and t.need < t.ties}
    if not equal:
        return rest.unionByName(rows.withColumn(flag, _keep_expr(second)).withColumn(TOKEN, F.col("_token")).drop("_token"))
    # rows equal in every column are interchangeable: count them and mark as many as wanted
    same = F.coalesce(F.col(TOKEN) == _by_group(equal, lambda t: t.token), F.lit(False))
    parts = rows.where(~same).withColumn(flag, _keep_expr(second)).withColumn(TOKEN, F.col("_token")).drop("_token")
    copies = (rows.where(same).withColumn(TOKEN, F.col("_token")).drop("_token").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
              .withColumn(flag, F.col("_i") <= _by_group(equal, lambda t: t.need)).drop("_c", "_i"))
    return rest.unionByName(parts).unionByName(copies)


def prepare(df: DataFrame, key: Column, seed, by: list[str] | None = None) -> DataFrame:
    """Add the order token and group key columns used by every sampler."""
    return df.withColumn(TOKEN, order_token(key, seed)).withColumn(GROUP, group_key(by))


def _wanted(n, fraction, rounding: str):
    if fraction is None:
        return n
    rnd = F.ceil if rounding == "ceil" else F.floor
    return lambda total: rnd(F.lit(float(fraction)) * total.cast("double"))


def mark_first(df: DataFrame, n: int | Mapping | None = None, *, fraction=None, rounding: str = "ceil", flag: str = "_first") -> DataFrame:
    """``df`` with the boolean ``flag``: the row is among the first ``n`` of its group in token order.

    ``df`` must carry the token and group columns (see :func:`prepare`).
    ``n`` is an int (same for every group), a mapping group -> n, or None
    with ``fraction`` (n = ceil/floor(fraction * group size), in double
    arithmetic like the reference). Exactly ``n`` rows are marked, also when
    keys or whole rows are repeated.
    """
    return _mark(df, _thresholds(df, _wanted(n, fraction, rounding)), flag)


def select_first(df: DataFrame, n: int | Mapping | None = None, *, fraction=None, rounding: str = "ceil") -> DataFrame:
    """The rows that :func:`mark_first` marks, without the flag."""
    return mark_first(df, n, fraction=fraction, rounding=rounding).where("_first").drop("_first")


def hash_rank(df: DataFrame, sizes: Mapping[str, int] | None = None, rank_col: str = "rn",
              size_col: str | None = None) -> DataFrame:
    """Exact 1-based rank of each row within its group, in token order.

    Rows are spread over 16^w hash buckets per group (w chosen so a bucket
    holds about RANK_BUCKET_ROWS rows); bucket offsets come from a bounded
    histogram (groups x 16^w rows, broadcast only below MAX_BROADCAST_ROWS),
    and the rank inside a bucket from a window partitioned by (group, bucket).
    ``size_col`` also adds the group's number of rows.
    """
    if sizes is not None and all(sizes.values()):
        largest, groups = max(sizes.values(), default=1), len(sizes)
    else:
        largest, groups = df.groupBy(GROUP).agg(F.count(F.lit(1)).alias("_c")) \
            .agg(F.coalesce(F.max("_c"), F.lit(1)), F.count(F.lit(1))).first()
    width = _width_for(largest, RANK_BUCKET_ROWS)
    d = df.withColumn("_b", F.substring(TOKEN, 1, width))
    hist = d.groupBy(GROUP, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(GROUP).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    size = [F.sum("_c").over(Window.partitionBy(GROUP)).alias(size_col)] if size_col else []
    offs = hist.select(GROUP, "_b", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"), *size)
    if groups * 16 ** width <= MAX_BROADCAST_ROWS:
        offs = F.broadcast(offs)
    w = Window.partitionBy(GROUP, "_b").orderBy(TOKEN)
    return (d.join(offs, [GROUP, "_b"])
            .withColumn(rank_col, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
            .drop("_b", "_off"))


# ---------------------------------------------------------------- T operators

def split(df: DataFrame, key: Column, test_size: float = 0.2, seed=42,
          stratify: str | None = None) -> DataFrame:
    """Exact split; test = the ceil(f*n) first rows (per class if stratified).

    Adds ``is_test`` (int 0/1).
    """
    by = [stratify] if stratify else None
    d = prepare(df, key, seed, by)
    marked = mark_first(d, fraction=test_size, rounding="ceil")
    return marked.withColumn("is_test", F.col("_first").cast("int")).drop(TOKEN, GROUP, "_first")


def split_by(df: DataFrame, key: Column, by: list[str], test_size: float = 0.2, seed=42) -> DataFrame:
    """T2 for any number of groups: per group, test = the ceil(f * size) first rows in token order.

    Same rows as :func:`split` with ``stratify``, but nothing per group
    reaches the driver or the plan: ranks and group sizes are joined.
    Adds ``is_test`` (int 0/1).
    """
    ranked = hash_rank(prepare(df, key, seed, by), None, "_rank", "_size")
    test = F.col("_rank") <= F.ceil(F.lit(float(test_size)) * F.col("_size").cast("double"))
    return ranked.withColumn("is_test", test.cast("int")).drop(TOKEN, GROUP, "_rank", "_size")


def validation_tail(df: DataFrame, key: Column, fraction: float = 0.2, seed=42) -> DataFrame:
    """validation = the last ``fraction`` of the shuffled set (rank > floor((1-f) n)).

    Adds ``is_val`` (int 0/1).
    """
    d = prepare(df, key, seed, None)
    marked = mark_first(d, fraction=1.0 - fraction, rounding="floor")
    return marked.withColumn("is_val", (~F.col("_first")).cast("int")).drop(TOKEN, GROUP, "_first")


def downsample(df: DataFrame, key: Column, label: str = "label", seed=42,
               n: int | None = None, classes=None) -> DataFrame:
    """Exact-n sample per class without replacement, then union.

    ``n=None`` (T4): every class is cut to the minority count. ``n`` given
    (T5): exactly ``n`` from each class; raises when a class is short.
    ``classes`` names the classes there must be: one without rows is short
    (T5) or leaves nothing (T4).
    """
    d = prepare(df, key, seed, [label])
    known = {str(c): 0 for c in classes or ()}
    if n is None:
        want = lambda total: F.min(total).over(Window.partitionBy(F.lit(1)))  # noqa: E731  (classes x 256 counts)
        if known and set(known) - {r[0] for r in d.select(GROUP).distinct().collect()}:
            return df.limit(0)
        check = None
    else:
        want = int(n)

        def check(totals):
            short = {g: t for g, t in (known | totals).items() if t < n}
            if short:
                raise ValueError(f"classes {short} have fewer than {n} rows")
    thr = _thresholds(d, want, totals={}, check=check)
    return _mark(d, thr, "_first").where("_first").drop(TOKEN, GROUP, "_first")


def oversample(df: DataFrame, key: Column, label: str = "label", seed=42,
               targets: Mapping | None = None) -> DataFrame:
    """Exactly ``targets[class]`` rows per class, by resampling.

    A class that holds enough rows gives the first of them in token order,
    without replacement. A smaller class is drawn with replacement: draw j
    picks the row whose 0-based rank (token order) is
    ``md5(j || '-' || seed || '-' || class) mod size``; duplicates are kept.
    Only the smaller classes are ranked. Classes without a target are left out.
    """
    d = prepare(df, key, seed, [label])
    sizes = _group_sizes(d)
    wanted = {str(g): int(t) for g, t in (targets or {}).items()}
    empty = [g for g in wanted if not sizes.get(g)]
    if empty:
        raise ValueError(f"classes {empty} are empty")
    large = {g: t for g, t in wanted.items() if sizes[g] >= t}
    small = {g: t for g, t in wanted.items() if sizes[g] < t}
    out = df.limit(0)
    if large:
        out = select_first(d.where(F.col(GROUP).isin(list(large))), large).select(df.columns)
    if small:
        ranked = hash_rank(d.where(F.col(GROUP).isin(list(small))), {g: sizes[g] for g in small})
        draws = None
        for g, t in small.items():
            text = F.concat(F.col("id").cast("string"), F.lit(f"-{seed}-{g}"))
            part = df.sparkSession.range(t).select(F.lit(g).alias(GROUP), (uniform_int(text, F.lit(sizes[g])) + 1).alias("rn"))
            draws = part if draws is None else draws.unionByName(part)
        out = out.unionByName(ranked.join(draws, [GROUP, "rn"]).select(df.columns))
    return out


def shuffle_order(df: DataFrame, key: Column, seed=42, rank_col: str = "pos") -> DataFrame:
    """Seeded shuffle as an explicit 1-based position column (no sort of the output)."""
    d = prepare(df, key, seed, None)
    return hash_rank(d, None, rank_col).drop(TOKEN, GROUP)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def assign_batches(df: DataFrame, key: Column, batch_size: int, epochs: int = 1, seed=42,
                   microbatches: int | None = None, drop_remainder: bool = False) -> DataFrame:
    """Per epoch a full reshuffle, then fixed batches of ``batch_size``.

    Adds ``epoch``, ``step = floor((rank-1)/batch)`` and, when
    ``microbatches`` is given, ``microbatch = (rank-1) mod m`` inside the
    batch. ``drop_remainder`` drops the last partial batch (steps = n // b).
    """
    if microbatches is not None and batch_size % microbatches != 0:
        raise ValueError("batch_size must be a multiple of microbatches")
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(int(epochs)))))
    ekey = F.concat(key, F.lit("-e"), F.col("epoch").cast("string"))
    d = e.withColumn(TOKEN, order_token(ekey, seed)).withColumn(GROUP, F.col("epoch").cast("string"))
    n = df.count()
    sizes = {str(i): n for i in range(1, int(epochs) + 1)}
    r = hash_rank(d, sizes, "_rank")
    out = r.withColumn("step", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("int"))
    if microbatches is not None:
        out = out.withColumn("microbatch", F.pmod(F.col("_rank") - 1, F.lit(microbatches)).cast("int"))
    if drop_remainder:
        out = out.where(F.col("step") < F.lit(n // batch_size))
    return out.drop(TOKEN, GROUP, "_rank")
