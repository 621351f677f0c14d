"""Best-fit-decreasing packing of token pieces into fixed-size sequences (op6).

Best fit decreasing only looks at lengths, and lengths are integers up to
the sequence size. So the packing is planned once, globally, over the
histogram of piece lengths (at most ``size`` rows, whatever the corpus
size): bins with equal remaining capacity are handled as one run, and a
segment tree over remaining capacities finds the tightest open capacity in
logarithmic time. The plan is a bounded table (a bin holds fewer than 91
distinct lengths when the size is 4096, since 1 + 2 + ... + 91 > 4096);
every piece then finds its place from its rank among pieces of its length,
in Spark.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from dpframe.llm.common import written
from dpframe.llm.tokens import DEFAULT_TOKENIZER, ID_BYTES, encoder

SIZE = 4096
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Least number of pieces of one length that are ranked together in one task.
RANK_ROWS = 500


class CapacityTree:
    """Segment tree over capacities 0..n: which of them have an open run of bins."""

    def __init__(self, n: int):
        self.leaves = 1
        while self.leaves <= n:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        while i and self.open[i] != is_open:
            self.open[i] = is_open
            i //= 2
            if i:
                is_open = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest open capacity of at least ``need``."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        if i <= 1:
            return None
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan_best_fit(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over ``{length: pieces}``.

    Returns runs ``(length, first rank, pieces, per bin, first bin, offset)``
    and the number of bins: piece ``r`` of the run goes to bin
    ``first bin + r // per bin`` at ``offset + (r % per bin) * length``.
    """
    tree = CapacityTree(size)
    runs_by_capacity: dict[int, list[tuple[int, int]]] = {}
    plan = []
    n_bins = 0

    def add(capacity: int, first: int, bins: int) -> None:
        if bins and capacity > 0:
            runs_by_capacity.setdefault(capacity, []).append((first, bins))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per = size // length
                bins = -(-left // per)
                first, n_bins, capacity = n_bins, n_bins + bins, size
            else:
                runs = runs_by_capacity[capacity]
                first, bins = runs.pop()
                if not runs:
                    tree.set(capacity, False)
                per = capacity // length
            placed = min(left, bins * per)
            plan.append((length, rank, placed, per, first, size - capacity))
            full, rest = divmod(placed, per)
            add(capacity - per * length, first, full)
            if rest:
                add(capacity - rest * length, first + full, 1)
            used = full + bool(rest)
            add(capacity, first + used, bins - used)
            rank += placed
            left -= placed
    return plan, n_bins


def token_pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = DEFAULT_TOKENIZER, ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A null text is empty and gives the end id alone. ``ids`` adds the ids
    themselves as an array column.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if ids else "")

    def cut(batches):
        import numpy as np
        import pandas as pd
        enc = encoder(tokenizer)
        step = size * ID_BYTES
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                for key, raw in zip(part["doc_id"], enc.encode(part["text"])):
                    key = None if pd.isna(key) else int(key)
                    for k, a in enumerate(range(0, len(raw), step)):
                        b = raw[a:a + step]
                        row = (key, k, a // ID_BYTES, len(b) // ID_BYTES, zlib.crc32(b))
                        rows.append(row + (np.frombuffer(b, "<u4").astype("int32"),) if ids else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")) \
        .mapInPandas(cut, schema)


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = DEFAULT_TOKENIZER, ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens by best fit decreasing.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids). Only documents longer than ``size`` are
    cut. Null texts give one token; null or repeated doc_ids are packed row
    by row; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, size, tokenizer, ids), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= size rows
    plan, _ = plan_best_fit(hist, size)

    # rank of each piece among those of its length: counts per (length, slice), then a window inside a slice
    most = max(hist.values(), default=0)
    slices = max(1, -(-most // max(RANK_ROWS, math.isqrt(most))))
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    counts = pieces.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_slice").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    ranked = (pieces.withColumn("_r", F.row_number().over(inside) - 1)
              .join(base, ["length", "_slice"])
              .withColumn("_rank", F.col("_base") + F.col("_r")))

    # the plan, one sorted run list per length: bounded by the sequence size, not by the corpus
    per_length: dict[int, list] = {}
    for length, rank, n, per, first, offset in plan:
        per_length.setdefault(length, []).append((rank, n, per, first, offset))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("rank", "n", "per", "first", "offset")])
    plan_df = spark.createDataFrame(
        [(k, v) for k, v in per_length.items()],
        T.StructType([T.StructField("length", T.LongType()), T.StructField("_runs", T.ArrayType(run))]))
    placed = (ranked.join(F.broadcast(plan_df), "length")
              .withColumn("_run", F.filter("_runs", lambda x: (x["rank"] <= F.col("_rank"))
                                           & (F.col("_rank") < x["rank"] + x["n"]))[0])
              .withColumn("_at", F.col("_rank") - F.col("_run.rank")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run.first") + F.floor(F.col("_at") / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + F.col("_at") % F.col("_run.per") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences from ``pack(..., ids=True)``: sequence_id, length, ids, doc_ids (each at most the size)."""
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return g.select("sequence_id", F.flatten("p.ids").alias("ids"), F.size(F.flatten("p.ids")).alias("length"),
                    F.col("p.doc_id").alias("doc_ids"))
