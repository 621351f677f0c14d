"""URL filtering by list rules and mined association rules (op2, native).

Listed rules (host and path prefix, longest first) decide where one fits.
For the other urls, Spark's FP-growth mines token combinations of labelled
urls; rules that conclude "block" are pruned by support, confidence and
lift, and matched through an inverted index: url tokens meet the index of
rule tokens, and a rule fires when all of its tokens were met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import ascii_lower, read, written

#: Listed rules, as (host, path, verdict): fixed values.
LISTED = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BLOCK = "label=block"
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
MAX_TOKENS = 4
#: Pieces in which the pages of one token set meet its verdict.
SALTS = 32


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    text = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest listed rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host words and suffix, path words, query keys."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    words = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    suffix = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site="), F.array_join(F.slice(labels, -2, 2), ".")))) \
        .otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(ascii_lower(path), "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    keys = F.transform(F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\?([^#]*)", 1), "&"),
                                lambda x: x != ""), lambda x: F.split(x, "=")[0])
    return F.array_distinct(F.concat(
        F.transform(words, lambda x: F.concat(F.lit("host="), x)), suffix,
        F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("query="), x))))


def mine_rules(urls: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (rule_id, tokens, size, confidence) that conclude "block".

    ``urls`` has page_id and tokens, ``labels`` has page_id and a boolean
    ``block``. Support is relative, so the rule set does not grow with the
    corpus, but at least ``MIN_COUNT`` labelled urls must agree.
    """
    known = urls.join(labels.where("page_id IS NOT NULL AND block IS NOT NULL").groupBy("page_id")
                      .agg(F.max("block").alias("block")), "page_id")
    known = known.where(F.size("tokens") > 0).select(
        F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    known = written(known, "baskets")
    n = known.count()
    empty = urls.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, size int, confidence double")
    if n == 0:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, MIN_COUNT / n)),
                     minConfidence=min_confidence).fit(known)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)
                                         & (F.size("antecedent") <= MAX_TOKENS) & (F.col("lift") >= min_lift))
    return written(rules.select(
        F.xxhash64(F.array_join(F.array_sort("antecedent"), "\u0001")).alias("rule_id"),
        F.col("antecedent").alias("tokens"), F.size("antecedent").alias("size"), "confidence"), "rules")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url_key -> number of rules whose tokens are all in the url; no row for urls without one.

    ``urls`` has one row per url_key with its distinct tokens.
    """
    index = rules.select("rule_id", "size", F.explode("tokens").alias("token"))
    met = urls.select("url_key", F.explode("tokens").alias("token")).join(index, "token")
    whole = met.groupBy("url_key", "rule_id", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.groupBy("url_key").agg(F.count("*").alias("rules"))


def judge(pages: DataFrame, labels: DataFrame, rules=LISTED) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict.

    ``labels`` has page_id and a boolean ``block``. Urls are matched once
    each and joined back. A null or schemeless url has empty host and path
    and no tokens, so it is allowed; without labels nothing is mined and
    only listed rules block. Repeated rows are judged alike; extra columns
    are ignored.
    """
    host, path = host_path(F.col("url"))
    base = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url")) \
        .withColumn("host", host).withColumn("path", path)
    base = base.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))
    found = mine_rules(base.select("page_id", "tokens"), labels)
    # the method sees each distinct token set once; a url's own key is a digest of that set
    keyed = base.withColumn("url_key", F.md5(F.array_join(F.array_sort("tokens"), "\u0001")))
    sets = keyed.groupBy("url_key").agg(F.first("tokens").alias("tokens"))
    # a token set that many pages share is joined in SALTS pieces
    keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    blocked = fired(sets, found).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rule, listed = listed_rule(F.col("host"), F.col("path"), rules)
    return keyed.join(blocked, ["url_key", "salt"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(listed, F.when(F.col("rules") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("rules", F.lit(0)).cast("long").alias("mined_rules"))


def page_labels(labels: DataFrame) -> DataFrame:
    """The labels table as page labels: the label's doc_id is the page's id; junk or toxic is block."""
    return labels.select(F.col("doc_id").alias("page_id"),
                         ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("block"))


def op2_query(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"), page_labels(read(spark, sf_dir, "labels")))

