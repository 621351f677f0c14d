"""Near-duplicate classes by BagMinHash signatures (op1).

A document is the multiset of its five-word shingles; a shingle's weight is
its count. BagMinHash draws, for every shingle, Poisson processes over
discretised weights (unit steps, grouped hierarchically into [0,1), [1,2),
[2,4), [4,8), ...). Points above the shingle's weight do not count. The
earliest point in each register is the signature, whose registers agree
with probability equal to the weighted Jaccard similarity. Points later than
the slowest register cannot matter, so a document of n shingles costs about
n + m log m points.

Texts with equal words are one node. Signatures are cut into bands; nodes of
a bucket are compared with the bucket's pivot. Where a bucket still holds
several components, nodes outside the largest try members of it, round by
round, and at last every pair across components that can still reach the
threshold (by a prefix filter on their rarer shingles) is compared.
Every comparison is exact: multiset overlap of the words themselves, 0.8 or
more. Classes are the connected components. A bucket of k near copies costs
about k comparisons, and no large group is gathered into a task: rows of a
hot bucket or pivot carry a salt, and the one row they meet is there once for
each salt. Tables are removed when their last reader is written.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dpframe.llm.common import drop_written, hot_limit, normal_words, read, replicated, salted, written
from dpframe.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5             # at similarity 0.8 a pair shares no band with probability 0.00005
REGISTERS = BANDS * ROWS
#: Pairs across components that are compared at once, per node of a mixed bucket.
SPARSE = 4
#: Documents and words handled in one numpy pass.
PASS_DOCS, PASS_WORDS = 256, 400_000

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * C2
        z = (z ^ (z >> np.uint64(27))) * C3
        return z ^ (z >> np.uint64(31))


def shingle_hashes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every five-word shingle; a document of fewer words is one shingle."""
    n = np.diff(starts)
    words = words.view(np.uint64)
    docs, out = [], []
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            m = len(words) - SHINGLE + 1
            h = np.zeros(m, np.uint64)
            for j in range(SHINGLE):
                h = _mix(h * C1 + words[j:j + m])
            doc = np.repeat(np.arange(len(n)), n)
            whole = doc[:m] == doc[SHINGLE - 1:]
            docs.append(doc[:m][whole])
            out.append(h[whole])
        for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
            h = np.zeros(1, np.uint64)
            for w in words[starts[d]:starts[d + 1]]:
                h = _mix(h * C1 + w)
            docs.append(np.array([d]))
            out.append(h)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs).astype(np.int64), np.concatenate(out)


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """(n_docs, m) earliest point times; rows of documents without elements are infinite.

    ``(doc, element)`` pairs are distinct; weights are positive whole numbers.
    """
    h = np.full(n_docs * m, np.inf)
    slowest = np.full(n_docs, np.inf)
    parts = []
    level, lo = 0, 0
    while True:                              # intervals [lo, lo + width) of the weight axis
        width = max(lo, 1)
        has = weight > lo
        if not has.any():
            break
        with np.errstate(over="ignore"):
            state = _mix(element[has] + C1 * np.uint64(level + 1))
        parts.append((doc[has], state, np.full(has.sum(), float(width)), np.minimum(weight[has] - lo, width) / width))
        lo, level = lo + width, level + 1
    if not parts:
        return h.reshape(n_docs, m)
    d, s, rate, share = (np.concatenate(x) for x in zip(*parts))
    t = np.zeros(len(d))
    k = 0
    while len(d):
        k += 1
        with np.errstate(over="ignore"):
            z = _mix(s + C3 * np.uint64(k))
            z2 = _mix(z ^ C1)
        t = t - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        alive = t < slowest[d]
        if not alive.all():
            d, s, rate, share, t, z2 = d[alive], s[alive], rate[alive], share[alive], t[alive], z2[alive]
        at = d * m + (z2 % np.uint64(m)).astype(np.int64)
        inside = (_mix(z2 ^ C2) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < share
        if inside.all():
            np.minimum.at(h, at, t)
        else:
            np.minimum.at(h, at[inside], t[inside])
        slowest = h.reshape(n_docs, m).max(axis=1)
    return h.reshape(n_docs, m)


def signatures(words: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures of documents given as word hashes and the position where each document starts."""
    n_docs = len(starts) - 1
    doc, h = shingle_hashes(words, starts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(h)))
    return bag_minhash(doc[at], h[at], weight, n_docs, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) 64-bit keys; the band's number is part of its key."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * C1), (len(sig), bands))
        for j in range(rows):
            h = _mix(h * C1 + bits[:, :, j])
    return h.view(np.int64)


def node_key(words: Column, text: Column) -> Column:
    """Digest of the normalised words; of the text where there is no word; null for empty texts."""
    return F.when(F.size(words) > 0, F.md5(F.concat(F.lit("w"), F.array_join(words, " ")))) \
        .when(F.length(text) > 0, F.md5(F.concat(F.lit("t"), text)))


def _nodes(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("raw")) \
        .withColumn("words", normal_words(F.col("text")))
    return base.withColumn("node", F.unhex(node_key(F.col("words"), F.col("text"))))


def _with_bands(nodes: DataFrame) -> DataFrame:
    """doc_id, node, size (shingles), bands, raw (digest of the text) of every document (null bands without words)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(2)
            start = np.asarray(lists.offsets).astype(np.int64)
            words = np.asarray(lists.values).astype(np.int64)
            n = batch.num_rows
            keys = np.zeros((n, BANDS), np.int64)
            a = 0
            while a < n:
                b = min(n, a + PASS_DOCS, max(a + 1, int(np.searchsorted(start, start[a] + PASS_WORDS))))
                keys[a:b] = band_keys(signatures(words[start[a]:start[b]], start[a:b + 1] - start[a]))
                a = b
            none = np.diff(start) == 0
            flat = pa.array(keys.ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), flat,
                                             mask=pa.array(none))
            size = pa.array(np.maximum(np.diff(start) - SHINGLE + 1, 1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, bands, batch.column(3)],
                                             ["doc_id", "node", "size", "bands", "raw"])

    hashed = nodes.select("doc_id", "node", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), "raw")
    return hashed.mapInArrow(run, "doc_id long, node binary, size long, bands array<long>, raw long")


@lru_cache(maxsize=256)
def _bag(text: str) -> Counter:
    w = text.split(" ")
    if len(w) < SHINGLE:
        return Counter([tuple(w)])
    return Counter(zip(*[w[j:] for j in range(SHINGLE)]))


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the five-word shingles of two normalised texts."""
    x, y = _bag(a), _bag(b)
    if len(x) > len(y):
        x, y = y, x
    both = sum(min(c, y[k]) for k, c in x.items() if k in y)
    return both / (x.total() + y.total() - both)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough, with their similarity."""
    def check(batches):
        import pandas as pd
        for pdf in batches:
            sim = [similarity(x, y) for x, y in zip(pdf["ta"], pdf["tb"])]
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sim})
            yield out[out["similarity"] >= threshold]

    # many nodes may meet one pivot b
    each = pairs.groupBy("b").agg(F.count("*").alias("n"))
    limit = hot_limit(pairs.count())
    wide = texts.select(F.col("node").alias("b"), F.col("words").alias("tb")).join(each, "b")
    joined = (salted(pairs, "b", "a", each.where(F.col("n") > limit), limit)
              .join(texts.select(F.col("node").alias("a"), F.col("words").alias("ta")), "a")
              .join(replicated(wide, F.col("n"), limit).drop("n"), ["b", "salt"]))
    return joined.select("a", "b", "ta", "tb").mapInPandas(check, "a binary, b binary, similarity double")


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(node, words as one string) for the wanted nodes; ``need`` has doc_id and raw (digest) of a row to take each from."""
    want = need.select(F.col("raw").alias("_r"), F.col("doc_id").alias("_d")).distinct()
    # the raw texts meet the wanted rows first, so that only theirs are normalised again
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("raw"))
    some = some.join(want, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("raw") == F.col("_r")), "left_semi")
    return _nodes(some.select("doc_id", "text")).select("node", F.array_join("words", " ").alias("words")).dropDuplicates(["node"])


def _host_pivots(placed: DataFrame, turn: int, limit: int) -> DataFrame:
    """One pair (a, b) per node outside its bucket's largest component: the node and a member of that component."""
    host = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("b")) \
        .groupBy("bucket").agg(F.max(F.struct("k", "comp", "b")).alias("h"), F.sum("k").alias("n"))
    host = replicated(host.select("bucket", F.col("h.comp").alias("hc"), F.col("h.b").alias("b"), "n"), F.col("n"), limit).drop("n")
    guests = placed.join(host, ["bucket", "salt"]).where("comp <> hc")
    return guests.groupBy(F.col("node").alias("a")).agg(F.min_by("b", F.xxhash64("node", "b", F.lit(turn))).alias("b"))


def _elements(nodes: DataFrame) -> DataFrame:
    """(node, comp, n, e): the n shingles of every text's words, the k-th occurrence of one being its own element.

    ``nodes`` has node, comp (whole numbers) and words.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(2)
            start = np.asarray(lists.offsets).astype(np.int64)
            doc, h = shingle_hashes(np.asarray(lists.values)[start[0]:start[-1]].astype(np.int64), start - start[0])
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
            with np.errstate(over="ignore"):
                e = _mix(h + C1 * nth.astype(np.uint64)).view(np.int64)
            n = np.bincount(doc, minlength=batch.num_rows)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), out], ["node", "comp", "n", "e"])

    hashed = nodes.select("node", "comp", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.mapInArrow(run, "node long, comp long, n long, e array<long>").select("node", "comp", "n", F.explode("e").alias("e"))


def _across(nodes: DataFrame, texts: DataFrame, apart: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components that can reach the threshold, and few others.

    A pair overlaps only in elements that occur in several components; the
    others are a node's own. Linked nodes have few of their own, and share
    one of the first of their common elements in any order (rare ones first):
    the prefix filter of exact similarity joins, with the short prefix for
    the shorter text. Two texts' own elements together bound their
    similarity. Nodes that were compared with the same pivot are paired by
    what sets them apart from it instead, which keeps groups of near misses
    from being paired.
    """
    ids = _numbered(nodes)
    elements = written(_elements(ids.join(texts, "node").select(F.col("id").alias("node"), F.col("cid").alias("comp"), "words")), "elements")
    several = elements.groupBy("e").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")) \
        .where("x <> y").select("e", "df")
    part = written(elements.join(several, "e"), "part")
    slack = (1 - threshold) / threshold
    may = part.groupBy("node", "n").agg(F.count("*").alias("m")).select("node", "m", (F.col("n") - F.col("m")).alias("own"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "e"))
    # smallest overlap with a text as long or longer, and with any text
    long_need, need = (F.ceil(F.lit(f) * F.col("n") - F.lit(1e-9)) for f in (2 * threshold / (1 + threshold), threshold))
    far = written(apart.select("node", "ref").join(ids.select("node", F.col("id").alias("_i")), "node")
                  .join(ids.select(F.col("node").alias("ref"), F.col("id").alias("_r")), "ref")
                  .select(F.col("_i").alias("node"), F.col("_r").alias("ref")), "far")
    may = may.join(far, "node", "left")
    first = written(part.join(may.where(F.col("own") <= F.col("m") * slack + 1e-9), "node").withColumn("r", rank)
                     .where(F.col("r") <= F.col("m") - need + 1)
                     .select("node", "comp", "n", "e", "m", "own", "ref", (F.col("r") <= F.col("m") - long_need + 1).alias("short")), "prefix")
    drop_written(part)
    # elements of its own that a node can afford beside those of the leanest node it meets
    lean = first.groupBy("e").agg(F.min("own").alias("least"), F.count("*").alias("k")).where("k > 1")
    prefix = written(first.join(lean, "e").where((F.col("own") + F.col("least") <= F.col("m") * slack + 1e-9)
                                                  | (F.col("own") == F.col("least"))).drop("least", "k"), "prefix")
    drop_written(first)
    x = prefix.where("short").select("e", *[F.col(c).alias(c + "_a") for c in ("node", "comp", "n", "m", "own", "ref")])
    y = prefix.select("e", *[F.col(c).alias(c + "_b") for c in ("node", "comp", "n", "m", "own", "ref")])
    on = ((x["e"] == y["e"]) & (F.col("comp_a") != F.col("comp_b")) & (F.col("n_a") <= F.col("n_b"))
          & (F.col("n_a") >= threshold * F.col("n_b"))
          & (F.col("own_a") + F.col("own_b") <= F.least("m_a", "m_b") * slack + 1e-9)
          & F.coalesce(F.col("ref_a") != F.col("ref_b"), F.lit(True)))
    pairs = written(x.join(y, on).select(F.col("node_a").alias("x"), F.col("node_b").alias("y")).distinct(), "pairs")
    drop_written(prefix)
    both = written(pairs.union(_apart_pairs(elements, far, threshold)).distinct(), "pairs")
    for table in (pairs, elements, far):
        drop_written(table)
    named = both.join(ids.select(F.col("id").alias("x"), F.col("node").alias("p")), "x") \
        .join(ids.select(F.col("id").alias("y"), F.col("node").alias("q")), "y")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _numbered(nodes: DataFrame) -> DataFrame:
    """node, id, cid: a whole number for every node, and the least of its component's.

    Numbers are given once and written, so they are the same for all readers.
    """
    ids = written(nodes.withColumn("id", F.monotonically_increasing_id()), "ids")
    each = written(ids.groupBy("comp").agg(F.count("*").alias("n"), F.min("id").alias("cid")), "comps")
    limit = hot_limit(ids.count())
    return written(salted(ids, "comp", "node", each.where(F.col("n") > limit), limit)
                   .join(replicated(each, F.col("n"), limit).drop("n"), ["comp", "salt"]).select("node", "id", "cid"), "ids")


def _apart_pairs(elements: DataFrame, far: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components with the same pivot ``ref`` that can reach the threshold.

    At least one of them is not linked to the pivot. What sets a node apart
    from the pivot is what it has and the pivot has not, and the reverse.
    Linked nodes share at least half of the sum of both distances less ``k``
    times both sizes, so they share one of the first of these elements (rare
    ones first).
    """
    k = (1 - threshold) / (1 + threshold)
    mine = elements.join(far.select("node", "ref"), "node").select("ref", "node", "e")
    pivot = elements.select(F.col("node").alias("ref"), F.col("n").alias("n_ref"), "e")
    theirs = far.select("node", "ref").join(pivot, "ref").select("ref", "node", "e")
    gained = mine.join(theirs, ["ref", "node", "e"], "left_anti").withColumn("lost", F.lit(0))
    lost = theirs.join(mine, ["ref", "node", "e"], "left_anti").withColumn("lost", F.lit(1))
    apart = written(gained.union(lost), "apart")
    often = apart.groupBy("ref", "e", "lost").agg(F.count("*").alias("df")).where("df > 1")
    sizes = elements.select("node", "comp", "n").distinct()
    of_ref = sizes.select(F.col("node").alias("ref"), F.col("n").alias("n_ref"))
    d = apart.groupBy("node").agg(F.count("*").alias("d")).join(sizes, "node")
    own = apart.join(often, ["ref", "e", "lost"]).join(d, "node").join(of_ref, "ref")
    shared = F.count("*").over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "e", "lost"))
    # least number of shared elements: for the one nearer to the pivot, and for the other
    reach = F.lit(k * (1 + 1 / threshold) / 2) * F.col("n")
    short_need = (F.col("d") + F.greatest(F.col("d"), F.lit(k) * (F.lit(threshold) * F.col("n") + F.col("n_ref")))) / 2 - reach
    need = F.col("d") / 2 - reach
    # elements that no other node has come first in the order, and take up d - shared places of the prefix
    ranked = own.withColumn("shared", shared).withColumn("place", F.col("d") - F.col("shared") + rank)
    prefix = written(ranked.where(F.col("place") <= F.floor(F.col("d") - need + F.lit(1e-6)) + 1).select(
        "ref", "e", "lost", "node", "comp", "n", "d", "shared",
        (F.col("place") <= F.floor(F.col("d") - short_need + F.lit(1e-6)) + 1).alias("short")), "prefix")
    cols = ("node", "comp", "n", "d", "shared")
    x = prefix.where("short").select("ref", "e", "lost", *[F.col(c).alias(c + "_a") for c in cols])
    y = prefix.select("ref", "e", "lost", *[F.col(c).alias(c + "_b") for c in cols])
    on = ((x["ref"] == y["ref"]) & (x["e"] == y["e"]) & (x["lost"] == y["lost"]) & (F.col("comp_a") != F.col("comp_b"))
          & (F.col("d_a") <= F.col("d_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
          & (F.col("d_a") + F.col("d_b") - F.lit(k) * (F.col("n_a") + F.col("n_b")) <= 2 * F.least("shared_a", "shared_b") + 1e-6))
    return x.join(y, on).select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))


def _links(docs: DataFrame, reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the distinct texts in ``reps`` (node, doc_id, raw, size, bands)."""
    rows = reps.where("bands IS NOT NULL").select("node", "size", F.explode("bands").alias("bucket"))
    met = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "met")
    limit = hot_limit(reps.where("bands IS NOT NULL").count() * BANDS)
    hot = met.where(F.col("n") > limit)
    found = written(salted(rows, "bucket", "node", hot, limit).join(replicated(met, F.col("n"), limit), ["bucket", "salt"]), "found")
    # the pivot of a bucket is its node with most company over all buckets: the middle of a group of near copies
    company = found.groupBy("node").agg(F.sum("n").alias("company"))
    shared = written(found.join(company, "node").select("bucket", "salt", "node", "size", "company", "n"), "buckets")
    drop_written(met)
    drop_written(found)
    pivots = shared.groupBy("bucket").agg(F.max(F.struct("company", "node", "size")).alias("p"), F.max("n").alias("_n"))
    pivots = replicated(pivots, F.col("_n"), limit).drop("_n")
    close = F.least("size", "p.size") >= F.lit(threshold) * F.greatest("size", "p.size")
    pairs = shared.join(pivots, ["bucket", "salt"]).where((F.col("node") != F.col("p.node")) & close) \
        .groupBy(F.col("node").alias("a"), F.col("p.node").alias("b")).agg(F.max("p.company").alias("company"))
    done = written(pairs, "pairs")
    texts = written(_texts(docs, shared.select("node").distinct().join(reps.select("node", "doc_id", "raw"), "node")), "texts")
    links = written(_verified(done.select("a", "b"), texts, threshold), "links")
    comps = components(links)
    # the best-connected pivot that each node was compared with
    apart = done.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("company", F.col("b").alias("ref"))).alias("s")).select("node", "s.ref")

    def mixed():
        """Buckets with several components, all their nodes, and how many pairs across components there are."""
        both = shared.join(comps, "node", "left").select("bucket", "salt", "node", F.coalesce("comp", "node").alias("comp"))
        per = written(both.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket")
                      .agg(F.sum("k").alias("n"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
                      .where("kk < cast(n as double) * n"), "mixed")
        got = written(both.join(replicated(per.select("bucket", "n"), F.col("n"), limit), ["bucket", "salt"], "left_semi"), "mixed")
        across = per.agg(F.coalesce(F.sum((F.col("n").cast("double") * F.col("n") - F.col("kk")) / 2), F.lit(0.0))).first()[0]
        drop_written(per)
        return got, across

    # large groups of near copies: rounds that try one member of the largest component for each node outside it
    turn, (left, across) = 0, mixed()
    while across > SPARSE * max(1, left.count()):
        turn += 1
        tried = written(_host_pivots(left, turn, limit), "tried")
        found = written(_verified(tried, texts, threshold), "links")
        n, asked = found.count(), tried.count()
        drop_written(tried)
        if n:
            links = written(links.union(found), "links")
            comps = components(links)
            drop_written(left)
            left, across = mixed()
        if n * 20 < asked:
            break
    drop_written(shared)

    # what may still be linked across the components of a bucket
    rest = _across(left.select("node", "comp").distinct(), texts, apart, threshold)
    known = done.select("a", "b")
    known = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(rest.join(known, ["a", "b"], "left_anti"), "rest")
    more = written(_verified(rest, texts, threshold), "links")
    for table in (left, done, texts, rest):
        drop_written(table)
    if more.limit(1).count():
        links = links.union(more)
        comps = components(links)
    return links, comps


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members`` has one row per document row: doc_id, node, class_id (the
    smallest doc_id of its class), copies (rows with the same words).
    ``links`` has the verified pairs (a, b, similarity) between different
    texts that span the classes; a and b are nodes. Null or empty texts, and
    texts without words unless equal, are classes of their own (node null for
    empty ones; class_id is then their doc_id). Rows with a null doc_id take
    part by their text and name no class. Extra columns are ignored.
    """
    sigs = written(_with_bands(_nodes(docs)), "signatures")
    reps = written(sigs.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "raw")).alias("d"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
        F.first("size").alias("size"), F.first("bands").alias("bands"))
        .select("node", F.col("d.doc_id").alias("at"), F.col("d.raw").alias("raw"), "doc_id", "copies", "size", "bands"), "reps")
    links, comps = _links(docs, reps.select("node", F.col("at").alias("doc_id"), "raw", "size", "bands"), threshold)
    classes = reps.select("node", "doc_id", "copies").join(comps, "node", "left") \
        .select("node", "doc_id", "copies", F.coalesce("comp", "node").alias("comp"))
    names = classes.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(names, "comp").select("node", "class_id", "copies")
    members = sigs.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    return members, links


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest doc_id of each class, all columns unchanged.

    Of rows alike in doc_id and words one stays; empty texts all stay. Of a
    class whose doc_ids are all null one row per different text stays.
    """
    members = written(near_duplicates(docs, threshold)[0], "members")
    out = members.where("node IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> class_id OR "
                        "node IS NOT NULL AND doc_id IS NULL AND class_id IS NOT NULL")
    again = members.where("node IS NOT NULL").groupBy("doc_id", "node").count().where("count > 1").select("doc_id", "node")
    again = written(again, "again")
    key = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")) \
        .withColumn("words", normal_words(F.col("row.text")))
    key = key.select("row", F.col("row.doc_id").cast("long").alias("doc_id"),
                     F.unhex(node_key(F.col("words"), F.col("row.text"))).alias("node"))

    def on(other):
        return F.col("doc_id").eqNullSafe(other["_d"]) & (F.col("node") == other["_n"])

    out = out.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n")).distinct()
    again = again.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"))
    kept = key.join(out, on(out), "left_anti")
    single = kept.join(again, on(again), "left_anti")
    if again.limit(1).count():
        single = single.unionByName(kept.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "node"]))
    return single.select("row.*")


def op1_query(spark, sf_dir):
    members, _ = near_duplicates(read(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id", "copies")
