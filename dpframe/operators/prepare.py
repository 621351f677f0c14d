"""Projections, predicates, encoding and scaling.

Fitting (category lists, means and standard deviations) is one aggregate
job whose small result is collected, like a Spark ML estimator; applying
it is a projection of literal-parameterised column expressions that stays
inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from dpframe.operators import sample
from dpframe.session import ensure_checkpoint_dir

MAX_CATEGORIES = 10_000


# ------------------------------------------------------------------- P ops

def split_target(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Move the target into an int ``label`` column, keep the rest as features."""
    return df.withColumn(label, F.col(target).cast("int")).drop(target) if target != label else df


def columns_by_kind(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """Numeric and categorical (string) feature columns, schema order.

    Booleans, dates and timestamps are neither (the reference's selector
    drops them); pass them explicitly if wanted.
    """
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
    return num, cat


def to_float_array(cols: list[Column | str], dtype: str = "float") -> Column:
    """Assemble columns into one ``array<float>`` feature vector."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast(dtype) for c in cols])


def concat_blocks(*arrays: Column) -> Column:
    """Concatenate array blocks (numeric block first)."""
    return F.concat(*arrays)


def pick_positions(arr: Column, positions: list[int]) -> Column:
    """Keep array positions (0-based) in the given order."""
    return F.array(*[arr.getItem(int(i)) for i in positions])


def nan_to_zero(c: Column) -> Column:
    """NaN (and null) -> 0."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))


def label_rows(df: DataFrame, label: str, value: int) -> DataFrame:
    """Rows of one class."""
    return df.where(F.col(label) == F.lit(value))


# ------------------------------------------------------------------- E ops

def onehot_fit(df: DataFrame, cols: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """E1 fit: sorted distinct non-null values per column, one aggregate job.

    For domains up to ``max_categories`` values, which become that many
    columns; beyond it use :func:`category_index` and :func:`onehot_position`.
    """
    if not cols:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
    cats = {c: list(row[c]) for c in cols}
    wide = {c: len(v) for c, v in cats.items() if len(v) > max_categories}
    if wide:
        raise ValueError(f"categorical domain too wide for one-hot arrays: {wide}")
    return cats


def onehot_columns(categories: dict[str, list[str]], drop_first: bool = False) -> list[tuple[str, Column]]:
    """One indicator per category named ``col_value``.

    Unseen values and nulls map to all zeros. ``drop_first`` drops the
    alphabetically first category (dummy coding).
    """
    out = []
    for c, vals in categories.items():
        for v in (vals[1:] if drop_first else vals):
            out.append((f"{c}_{v}", F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))))
    return out


def category_index(df: DataFrame, column: str) -> DataFrame:
    """E1 fit for a domain of any width: (value, position), positions 0.. in ascending order of the values.

    The distinct values are range-partitioned and written; a position is the
    number of values in the ranges before plus the place inside the range,
    so neither the driver nor one task holds the domain.
    """
    ensure_checkpoint_dir(df.sparkSession)
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    ranged = values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row a range
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("value")) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_part") \
        .select("value", (F.col("_start") + F.col("_place")).cast("long").alias("position"))


def onehot_position(df: DataFrame, column: str, index: DataFrame, out: str = "position") -> DataFrame:
    """E1 for wide domains: the position of each row's one; null (all zeros) for unseen values and nulls."""
    side = index.select(F.col("value").alias("_value"), F.col("position").alias(out))
    return df.join(side, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")


def label_onehot(label: Column, k: int) -> Column:
    """Integer label -> k-wide 0/1 array."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def argmax(arr: Column) -> Column:
    """E4 decode: 0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def scaler_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """E5 fit: mean and *population* std per column in one pass."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def scale_column(x: Column, mean: float, std: float) -> Column:
    """E5 apply: (x - mean) / std; a constant column (std 0) maps to 0."""
    if std is None or std == 0.0 or mean is None:
        return (x.cast("double") - F.lit(mean if mean is not None else 0.0)).cast("double")
    return (x.cast("double") - F.lit(mean)) / F.lit(std)


def scale_columns(stats: dict[str, tuple[float, float]], exprs: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    exprs = exprs or {}
    return [(c, scale_column(exprs.get(c, F.col(c)), m, s)) for c, (m, s) in stats.items()]


def fit_encoder_and_scaler(df: DataFrame, categorical: list[str], numeric: list[str],
                           max_categories: int = MAX_CATEGORIES):
    """E1 + E5 fit in one aggregation job: sorted categories and (mean, population std)."""
    aggs = [F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"c_{c}") for c in categorical]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    if not aggs:
        return {}, {}
    row = df.agg(*aggs).first()
    cats = {c: list(row[f"c_{c}"]) for c in categorical}
    wide = {c: len(v) for c, v in cats.items() if len(v) > max_categories}
    if wide:
        raise ValueError(f"categorical domain too wide for one-hot arrays: {wide}")
    return cats, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in numeric}


@dataclass
class Prepared:
    """A prepared table plus the fitted state needed to apply it to new rows."""
    df: DataFrame
    feature_names: list[str]
    categories: dict[str, list[str]] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)


def prepare_features(df: DataFrame, label: str, key: Column, numeric: list[str] | None = None,
                     categorical: list[str] | None = None, *, fit_on: str = "train",
                     test_size: float = 0.2, seed=42, stratify: bool = True,
                     drop_first: bool = False, scale_dummies: bool = False,
                     keep: tuple[str, ...] = ()) -> Prepared:
    """E1–E7 + T1/T2: encode, scale and split into ``features``/``label``/``is_test``.

    ``fit_on="train"`` fits encoder and scaler on the training rows only
    (E6); ``fit_on="all"`` fits on every row before the split (E7 and the
    DP scripts). ``scale_dummies`` also standardises indicator columns.
    """
    if numeric is None or categorical is None:
        n2, c2 = columns_by_kind(df, exclude=(label,))
        numeric = n2 if numeric is None else numeric
        categorical = c2 if categorical is None else categorical
    base = df.select(*numeric, *categorical, F.col(label).cast("int").alias("label"),
                     key.alias("key"), *keep)
    splitted = sample.split(base, F.col("key"), test_size=test_size, seed=seed,
                            stratify="label" if stratify else None)
    fit_rows = splitted.where(F.col("is_test") == 0) if fit_on == "train" else splitted
    if scale_dummies:
        cats = onehot_fit(fit_rows, categorical)
        dummies = onehot_columns(cats, drop_first=drop_first)
        with_d = fit_rows.select(*numeric, *[e.alias(n) for n, e in dummies])
        stats = scaler_fit(with_d, numeric + [n for n, _ in dummies])
        dexpr = dict(dummies)
        cols = scale_columns(stats, dexpr)
    else:
        cats, stats = fit_encoder_and_scaler(fit_rows, categorical, numeric)
        dummies = onehot_columns(cats, drop_first=drop_first)
        cols = scale_columns(stats) + dummies
    names = [n for n, _ in cols]
    out = splitted.select("key", "label", "is_test", *keep,
                          to_float_array([e for _, e in cols]).alias("features"))
    return Prepared(out, names, cats, stats)
