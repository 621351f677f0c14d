"""Quality limits against a plain version; decontamination beyond the broadcast bound."""

import collections
import math

import numpy as np

from dpframe.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def plain_verdicts(rows):
    """kept of each (doc_id, lang, source, text), from whole histograms in plain Python."""
    def ratios(t):
        n, chars, symbols, dup, repeat = quality.measure(t)
        return (chars / max(n, 1), symbols / max(chars, 1), dup / max(quality.word_lines(t), 1), repeat / max(n, 1)), \
            n < 50 or 100 * repeat > 50 * n

    def limit(counts, slack):
        total, reach, at = counts.total(), 0, {}
        for b in sorted(counts):
            reach += counts[b]
            for q in (0.25, 0.5, 0.75):
                if q not in at and reach / total >= q:
                    at[q] = 0.0 if b is ZERO else 2.0 ** ((b + 1) / 16)
        return max(at[0.75] + 3 * (at[0.75] - at[0.25]), at[0.5] + slack)

    ZERO = -math.inf
    seen = [(r[0], r[1], r[2], *ratios(r[3])) for r in rows]
    good = [s for s in seen if not s[4]]
    limits = {}
    for k in range(4):
        by = collections.defaultdict(collections.Counter)
        for _, lang, source, x, _ in good:
            b = math.floor(math.log2(x[k]) * 16) if x[k] > 0 else ZERO
            for g in ((), (lang,), (lang, source)):
                by[g][b] += 1
        slack = (3.0, 0.05, 0.25, 0.2)[k]
        every = limit(by[()], slack)
        for g in [g for g in by if len(g) == 2]:
            n_own, n_lang = by[g].total(), by[g[:1]].total()
            lang = (n_lang * limit(by[g[:1]], slack) + 30 * every) / (n_lang + 30)
            limits[g, k] = (n_own * limit(by[g], slack) + 30 * lang) / (n_own + 30)
    return {s[0]: not s[4] and all(s[3][k] <= limits[(s[1], s[2]), k] for k in range(4)) for s in seen}


def test_quality_verdicts_equal_plain_histograms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "source", "text").collect()]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert got == plain_verdicts(rows)


def test_limits_follow_each_group_and_do_not_change_between_runs(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 12)).tolist()) for _ in range(4000)]
    rows = []
    for source, marks in (("plain", 0), ("code", 30)):
        for i in range(300):
            words = rng.choice(vocabulary, 120).tolist()
            for j in rng.choice(120, marks, replace=False):
                words[j] = "#$" * 3
            rows.append((len(rows), "en", source, " ".join(words)))
    rows.append((9000, "en", "plain", rows[400][3]))           # as many symbols as code has: too many here
    rows.append((9001, "en", "code", rows[400][3] + " x"))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    first, again = ({r["doc_id"]: r["kept"] for r in quality.judge(df.repartition(k)).collect()} for k in (2, 7))
    assert first == again and not first[9000] and first[9001]
    assert sum(first.values()) >= 0.97 * len(first)
    measured = quality._with_keys(df).withColumn("_m", quality.measures(quality.F.col("text"))).select("_lang", "_source", "_m.*")
    limits = {r["_source"]: r["max_symbol_ratio"] for r in quality.thresholds(measured).collect()}
    assert limits["code"] > 1.5 * limits["plain"] > 0


def test_hits_beyond_the_broadcast_bound_shuffle_no_words(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    short = spark.createDataFrame([(900, "two words"), (901, "a one-off Three"), (902, "")], "item_id long, text string")
    windows = decontaminate.benchmark_windows(bench.select("item_id", "text").union(short))
    plain = decontaminate.hits(docs, windows)
    wide = decontaminate.hits(docs, windows, max_broadcast=0)
    order = ["doc_id", "pos", "length", "win"]
    a, b = (x.select(order).distinct().toPandas().sort_values(order, ignore_index=True) for x in (plain, wide))
    assert len(a) and a.equals(b)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        one = decontaminate.hits(docs, windows.where("length = 13"), max_broadcast=0)
        text = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = text.splitlines()
    by_hash = [lines[i - 1] for i, line in enumerate(lines) if "hashpartitioning(hash#" in line]
    assert len(by_hash) == 2 and all("Input" in line and "_w#" not in line for line in by_hash)
