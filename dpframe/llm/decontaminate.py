"""Benchmark decontamination by a hash set of normalised test n-grams (op8, native).

Benchmark windows of ``n`` words become 64-bit hashes; every window of every
document is hashed from its word hashes and looked up in the hash table of
the benchmark windows. A hit is verified against the words themselves, so a
hash collision changes nothing. The benchmark side is broadcast only when
its number of distinct windows (one row each, without items) is at most ``MAX_BROADCAST_WINDOWS``; beyond it the
same join runs shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import normal_words, read, written

WINDOW = 13
#: About 150 bytes a window: at most some 300 MB in an executor's broadcast table at this bound.
MAX_BROADCAST_WINDOWS = 2_000_000


LEVELS = {1: "_h", 2: "_h2", 4: "_h4", 8: "_h8"}


def _doubled(hashes: Column, size: int) -> Column:
    """Hashes of twice ``size`` words from each place on (those that reach over the end are never read)."""
    rest = F.slice(hashes, F.lit(size + 1), F.greatest(F.size(hashes) - size, F.lit(0)))
    return F.zip_with(hashes, rest, lambda a, b: F.xxhash64(a, b))


def _window_hash(at: Column, n: int) -> Column:
    """Hash of ``n`` words from place ``at`` on, put together from the hashes of powers of two of them."""
    parts, done = [], 0
    for size, name in reversed(LEVELS.items()):
        while n - done >= size:
            parts.append(F.get(F.col(name), at + done))
            done += size
    return F.xxhash64(*parts)


def _with_levels(df: DataFrame) -> DataFrame:
    """Adds the columns of :func:`_doublings` of ``_h``, each made from the one before."""
    for size, name, wide in ((1, "_h", "_h2"), (2, "_h2", "_h4"), (4, "_h4", "_h8")):
        df = df.withColumn(wide, _doubled(F.col(name), size))
    return df


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct (item, item_id): ``item`` is the digest of an item's words."""
    return benchmark.select(F.md5(F.array_join(normal_words(F.col("text")), " ")).alias("item"), F.col("item_id").alias("item_id")).distinct()


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (item, length, hash, window): ``n`` words each; a shorter item is one window.

    Items of the same words are one ``item`` (see :func:`benchmark_items`).
    """
    items = benchmark.select(normal_words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = items.groupBy(F.md5(F.array_join("_w", " ")).alias("item")).agg(F.min("_w").alias("_w"))
    items = items.withColumn("_len", F.least(F.size("_w"), F.lit(n)))
    wins = items.select("item", F.col("_len").alias("length"), F.explode(F.expr(
        "transform(sequence(1, size(_w) - _len + 1), i -> slice(_w, i, _len))")).alias("_win"))
    wins = wins.select("item", "length", F.array_join("_win", " ").alias("window"),
                       F.transform("_win", lambda w: F.xxhash64(w)).alias("_h"))
    wins = _with_levels(wins)
    by_length = None
    for k in range(1, n + 1):
        by_length = F.when(F.col("length") == k, _window_hash(F.lit(0), k)) if by_length is None \
            else by_length.when(F.col("length") == k, _window_hash(F.lit(0), k))
    return wins.select("item", "length", by_length.alias("hash"), "window").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a digest of the text: rows alike in both are one document to the lookup."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))


def hits(docs: DataFrame, bench: DataFrame, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Every occurrence of a window of ``bench`` (see :func:`benchmark_windows`): doc_id, _key, pos (0-based word), length, win (digest).

    Above ``max_broadcast`` windows the windows' hashes alone are shuffled, and
    a document's words are joined to its hits afterwards to verify them.
    """
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())     # at most the window's length
    side = written(bench.select("length", "hash", "window").distinct(), "windows")  # one row a window, whatever its items
    small = side.count() <= max_broadcast
    side = F.broadcast(side) if small else side
    words = _keyed(docs).withColumn("_w", normal_words(F.col("text"))).drop("text")
    hashed = _with_levels(words.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))))
    found = None
    for k in lengths:
        hashes = F.transform(F.sequence(F.lit(0), F.size("_h") - k), lambda i: _window_hash(i, k))
        grams = hashed.where(F.size("_h") >= k).select("doc_id", "_key", *(["_w"] if small else []), F.posexplode(hashes).alias("pos", "hash"))
        part = grams.join(side.where(F.col("length") == k), "hash")
        if small:
            part = part.where(_said() == F.col("window"))
        part = part.select("doc_id", "_key", "pos", "length", "window")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _keyed(docs.limit(0)).select("doc_id", "_key", F.lit(0).alias("pos"), F.lit(0).alias("length"), F.lit("").alias("window"))
    elif not small:
        found = found.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "pos", "length", "window").distinct()
        found = words.dropDuplicates(["doc_id", "_key"]).join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))) \
            .where(_said() == F.col("window"))
    return found.select("doc_id", "_key", "pos", "length", F.md5("window").alias("win"))


def _said() -> Column:
    """The words of a document at a hit."""
    return F.array_join(F.slice("_w", F.col("pos") + 1, F.col("length")), " ")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, _key.

    A document word inside any occurrence of a benchmark window is hit.
    Null or wordless texts have no words and are clean; a null item_id
    counts as hit words but names no item; rows alike in doc_id and text
    get the same values; an empty benchmark hits nothing.
    """
    bench = written(benchmark_windows(benchmark, n), "bench")
    found = written(hits(docs, bench).distinct(), "hits")
    # a document meets each text of the benchmark once, and only then the ids that have the text
    named = (found.select("doc_id", "_key", "win").distinct()
             .join(bench.select("item", F.md5("window").alias("win")), "win").select("doc_id", "_key", "item").distinct()
             .join(benchmark_items(benchmark), "item").select("doc_id", "_key", "item_id"))
    both = found.select("doc_id", "_key", F.struct("pos", "length").alias("span")).unionByName(named, allowMissingColumns=True)
    per_doc = both.groupBy("doc_id", "_key").agg(
        F.collect_set("span").alias("_spans"), F.collect_set("item_id").alias("_items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "_spans", lambda s: F.sequence(s["pos"], s["pos"] + s["length"] - 1)))))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), covered.alias("hit_words"),
                             F.array_sort(F.transform("_items", lambda i: i.cast("string"))).alias("_items"))
    base = _keyed(docs).select("doc_id", "_key", F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0))
    n_hit = F.when(F.col("hit_words").isNull(), 0).otherwise(n_hit).cast("long")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "hit_words", "_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents") -> DataFrame:
    """Drop contaminated documents, or cut the hit words out of every document (``remove="spans"``).

    All columns of ``docs`` are kept. Clean documents are returned as they
    are. With "spans" the separator after a removed word goes with it.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    flagged = contamination(docs, benchmark, n).where(F.col("contaminated") if remove == "documents" else F.col("n_hit") > 0)
    flagged = flagged.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("hit_words").alias("_hit")) \
        .dropDuplicates(["_d", "_k"])
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"),
                        F.col("text").alias("_text"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))
    on = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    if remove == "documents":
        return keyed.join(flagged.drop("_hit"), on, "left_anti").select("row.*")
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"         # words before lower-casing
    seps = F.split(F.col("_text"), word, -1)
    words = F.regexp_extract_all(F.col("_text"), F.lit(f"({word})"), 1)
    kept = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.array_contains("_hit", i))
    cut = F.concat(seps[0], F.array_join(F.transform(kept, lambda i: F.concat(words[i], seps[i + 1])), ""))
    text = F.when(F.col("_hit").isNull(), F.col("_text")).otherwise(cut)
    return keyed.join(flagged, on, "left").select("row.*", text.alias("_new")) \
        .select(*[F.col("_new").alias("text") if c == "text" else F.col(c) for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN it USING (rid)
"""

RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_query(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(*RESULT)

