"""Quality rules with adaptive thresholds from mergeable quantile sketches (op5).

Per (language, source) a sketch of each text measure counts its values in
logarithmic bins, sixteen to a factor of two: plain sums, so sketches merge
exactly and a task that runs again changes nothing. A document is rejected
when a measure lies above the group's outer fence (the upper quartile plus
``FENCE`` interquartile ranges) and its median plus ``SLACK``, so that a group
in which nearly all documents measure 0 does not reject the next one for a
single repeat. A group's
limit is averaged with its language's, and that with the limit over all
documents, by their documents and ``PRIOR`` for the wider one, so a small
group leans on its language without a switch. The thresholds are joined back
to filter.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpframe.llm.common import batch_rows, SPACE_CLASS, read, written

WORD = re.compile(f"[^{SPACE_CLASS}]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
MIN_WORDS = 50
#: Distance from the group's median within which a measure is never too high (in units of the measure).
SLACK = {"mean_word": 3.0, "symbol_ratio": 0.05, "dup_line_ratio": 0.25, "repeat_ratio": 0.2}
FENCE, PRIOR = 3.0, 30
#: Texts that a Python worker holds at a time.
BATCH = 1000
#: Bins to a factor of two, and the bin of the value 0.
BINS, ZERO = 16, -100_000


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        if len(count) < len(windows):
            end = 0                      # words before this index are counted
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeat


def word_lines(text: str | None) -> int:
    """Number of lines with a word."""
    return sum(1 for line in (text or "").split("\n") if WORD.search(line))


def measures(text: Column) -> Column:
    """Struct of the five counts and the lines with a word (a pandas UDF, Arrow batches)."""

    @F.pandas_udf(MEASURES)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*measure(t), word_lines(t)) for t in s], columns=[c.split()[0] for c in MEASURES.split(", ")])

    return run(text)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


def _ratios(m: str = "") -> dict[str, Column]:
    n = F.greatest(F.col(f"{m}n_words"), F.lit(1))
    return {"mean_word": F.col(f"{m}word_chars") / n,
            "symbol_ratio": F.col(f"{m}n_symbols") / F.greatest(F.col(f"{m}word_chars"), F.lit(1)),
            "dup_line_ratio": F.col(f"{m}n_dup_lines") / F.greatest(F.col(f"{m}n_lines"), F.lit(1)),
            "repeat_ratio": F.col(f"{m}n_repeat_words") / n}


def sketches(measured: DataFrame) -> DataFrame:
    """(_lang, _source, name, bin, c): documents in each bin of each measure; documents that fail the base rules are left out."""
    use = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), _ratios()[k].cast("double").alias("x")) for k in SLACK]))
    binned = F.when(F.col("v.x") > 0, F.floor(F.log2("v.x") * BINS).cast("int")).otherwise(F.lit(ZERO))
    return use.select("_lang", "_source", pairs.alias("v")).select("_lang", "_source", "v.name", binned.alias("bin")) \
        .groupBy("_lang", "_source", "name", "bin").agg(F.count("*").alias("c"))


def _limits(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, name) -> documents ``n`` and the limit of their sketch."""
    whole = Window.partitionBy(*keys, "name")                                     # the bins of one sketch
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("n", F.sum("c").over(whole)).withColumn("reach", F.sum("c").over(upto) / F.sum("c").over(whole))
    # a bin stands for its upper edge
    edge = F.when(F.col("bin") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS))
    q = at.groupBy(*keys, "name").agg(F.max("n").alias(f"n_{out}"), *[F.min(F.when(F.col("reach") >= x, edge)).alias(f"q{i}")
                                                                      for i, x in enumerate((0.25, 0.5, 0.75))])
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("name"))
    limit = F.greatest(F.col("q2") + FENCE * (F.col("q2") - F.col("q0")), F.col("q1") + slack)
    return q.select(*keys, "name", f"n_{out}", limit.alias(out))


def _lean(n: str, own: str, wider: str) -> Column:
    return (F.col(n) * F.col(own) + PRIOR * F.col(wider)) / (F.col(n) + PRIOR)


def thresholds(measured: DataFrame) -> DataFrame:
    """(_lang, _source) -> limit per measure; ``measured`` has the counts and the key columns."""
    own = written(sketches(measured), "sketches")
    merged = lambda *keys: own.groupBy(*keys, "name", "bin").agg(F.sum("c").alias("c"))
    both = (_limits(own, ["_lang", "_source"], "own").join(_limits(merged("_lang"), ["_lang"], "lang"), ["_lang", "name"])
            .join(_limits(merged(), [], "every"), "name"))
    both = both.withColumn("lang", _lean("n_lang", "lang", "every")).withColumn("limit", _lean("n_own", "own", "lang"))
    return both.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("name") == k, F.col("limit"))).alias("max_" + k) for k in SLACK])


def _with_keys(docs: DataFrame) -> DataFrame:
    """Group keys; a null language or source is a group of its own."""
    none = F.lit("\u0000none")
    return docs.withColumn("_lang", F.coalesce(F.col("lang"), none)).withColumn("_source", F.coalesce(F.col("source"), none))


def _verdict(m: str = "") -> Column:
    ok = ~base_failed(F.col(f"{m}n_words"), F.col(f"{m}n_repeat_words"))
    for k, c in _ratios(m).items():
        ok = ok & F.coalesce(c <= F.col("max_" + k), F.lit(True))
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, the five counts, base_failed, kept.

    Null texts have no words and fail the base rule. Null languages and
    sources form groups of their own; an empty table gives no rows; repeated
    rows are judged alike.
    """
    m = _with_keys(docs.select("doc_id", "lang", "source", "text")).withColumn("_m", measures(F.col("text")))
    with batch_rows(docs.sparkSession, BATCH):
        m = written(m.select("doc_id", "_lang", "_source", "_m.*"), "measures")
    return m.join(thresholds(m), ["_lang", "_source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), _verdict().alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged.

    The documents are written beside their measures, so that texts are measured
    once and never shuffled: the thresholds (one row a group) are joined to them.
    Null texts have no words and go; null languages and sources are groups of
    their own; an empty table stays empty; repeated rows are judged alike.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "lang", "source", measures(F.col("text")).alias("_m"))
    with batch_rows(docs.sparkSession, BATCH):
        keyed = written(_with_keys(rows), "measured")
    limits = written(thresholds(keyed.select("_lang", "_source", "_m.*")), "limits")
    return keyed.join(limits, ["_lang", "_source"], "left").where(_verdict("_m.")).select("row.*")


def op5_query(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents"))
