"""Line de-duplication with a fixed-depth log-template tree (op7).

A line's place in the tree is its token count, then its first ``DEPTH``
tokens, then its template. Tokens that hold a digit, an address or a long
hexadecimal run are variable and generalise to ``<*>``. The tokens below the
leading ones are also cut into ``SEGMENTS`` runs, and a line belongs to the
templates in which one whole run is a variable field, so lines of one
template may differ in a quarter of their tail. Templates that occur in
several documents are dropped everywhere but in the first document.

Passages that recur inside longer lines, at other offsets or wrapped anew
are met by content-defined chunks: the words of a whole document are cut
where the hash of a word pair is the least within ``REACH`` words on both
sides, so equal passages are cut alike wherever they stand. Every run of
chunks of at least ``PASSAGE`` words has a key, and the words of a key that
an earlier document holds are cut.

Everything is an aggregation over template keys: no leaf of the tree is ever
gathered into a task, however many lines it holds.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import SPACE_CLASS, batch_rows, drop_written, read, written

DEPTH = 2
SEGMENTS = 4
#: Lines of at least LONG tokens recur from 2 documents on, shorter ones from SHORT_DOCS on.
LONG, SHORT, SHORT_DOCS = 8, 3, 20
#: Words on both sides that a cut between chunks depends on, and the fewest words of a passage key.
REACH, PASSAGE = 4, 20
#: Texts that a Python worker holds at a time.
BATCH = 1000
WORD = re.compile(f"[^{SPACE_CLASS}]+")
BASE = 0x2545F4914F6CDD1D
VARIABLE = re.compile(rb"[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*")
MAYBE = re.compile(rb"[0-9@]|://")


def tokens(line: bytes) -> list[bytes]:
    """Words of a line with variable fields masked."""
    return (VARIABLE.sub(b"<*>", line) if MAYBE.search(line) else line).split()


def template_keys(toks: list[bytes]) -> list[int]:
    """Template keys of one line: the masked line, then one key per generalised segment (long lines)."""
    import xxhash
    n = len(toks)
    if n < SHORT:
        return []
    out = [xxhash.xxh3_64_intdigest(b" ".join(toks), seed=n)]
    if n >= LONG:
        tail = n - DEPTH
        for k in range(SEGMENTS):
            a, b = DEPTH + tail * k // SEGMENTS, DEPTH + tail * (k + 1) // SEGMENTS
            out.append(xxhash.xxh3_64_intdigest(b" ".join(toks[:a]) + b"\n%d\n" % k + b" ".join(toks[b:]), seed=n))
    return [h - (1 << 64) if h >> 63 else h for h in out]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    return (np.cumprod(np.full(size, BASE, np.uint64)), np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64)))


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs of values from first up to last: (sum of value * BASE**place) / BASE**first, modulo 2**64."""
    powers, back = _powers(1 << int(len(values)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:len(values)], dtype=np.uint64)])
    return _mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(IN_WORD[raw].view(np.int8), prepend=np.int8(0)))
    first, last = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _runs(BYTES[raw], first, last), np.diff(np.searchsorted(first, ends), prepend=0)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: A random value for each byte, and whether a byte is part of a word.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
IN_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])


def passage_keys(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: the keys of its passages, and their places (first word << 32 | word after the last)."""
    h, n = _word_hashes(texts)
    end = np.cumsum(n)
    begin = end - n
    # one array for all texts, REACH places of the largest value between them
    place = np.arange(len(h)) + REACH * (1 + np.repeat(np.arange(len(n)), n))
    pair = _mix(h + np.uint64(BASE) * np.concatenate([h[:1], h[:-1]]))
    wide = np.full(len(h) + REACH * (len(n) + 1), np.iinfo(np.uint64).max, np.uint64)
    wide[place] = pair
    least = np.ones(len(h), bool)
    for k in range(1, REACH + 1):
        least &= (pair < wide[place - k]) & (pair <= wide[place + k])
    cuts = np.unique(np.concatenate([np.flatnonzero(least), begin, end]))
    owner = np.searchsorted(end, cuts, side="right")
    cuts, owner = cuts[owner < len(n)], owner[owner < len(n)]
    full = cuts + PASSAGE <= end[owner]
    first, owner = cuts[full], owner[full]
    bounds = np.append(cuts, len(h))
    last = bounds[np.searchsorted(bounds, first + PASSAGE)]
    keys = _runs(h, first, last).view(np.int64)
    spans = (first - begin[owner] << 32) | (last - begin[owner])
    at = np.searchsorted(owner, np.arange(1, len(n)))
    return list(zip(np.split(keys, at), np.split(spans, at)))


def _groups(texts: list[bytes], size: int = 1 << 20):
    """Slices of the texts of about ``size`` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), pos, n (tokens), keys of every line that has a template.

    A row with pos -1 has the keys of a document's passages and their places (spans).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))

    def cut(batches):
        for pdf in batches:
            rows = []
            texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            for doc, key, text in zip(docs, pdf["key"], texts):
                for pos, line in enumerate(text.split(b"\n")):
                    toks = tokens(line)
                    if len(toks) >= SHORT:
                        rows.append((doc, key, pos, len(toks), template_keys(toks), None))
            for part in _groups(texts):
                for doc, key, (keys, spans) in zip(docs[part], pdf["key"][part], passage_keys(texts[part])):
                    if len(keys):
                        rows.append((doc, key, -1, PASSAGE, keys, spans))
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["doc_id", "key", "pos", "n", "keys", "spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return base.where("text IS NOT NULL").mapInPandas(
        cut, "doc_id long, key long, pos int, n int, keys array<long>, spans array<long>")


def document(docs: DataFrame) -> Column:
    """What tells documents apart and orders them: doc_id where no two rows share it, else doc_id and text digest.

    Both order documents alike; a single number can be aggregated without sorting.
    """
    shared = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("doc_id IS NULL OR count > 1")
    return F.col("doc_id") if shared.isEmpty() else F.struct("doc_id", "key")


def recurring(lines: DataFrame, doc: Column) -> DataFrame:
    """Templates and passages that recur: tkey, first (the smallest document that holds it, see ``document``)."""
    each = lines.select(doc.alias("doc"), "n", F.explode("keys").alias("tkey"))
    # partial minimum and maximum see at once whether a second document has it; only short lines need counting
    stat = each.groupBy("tkey").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("n").alias("n"))
    long = stat.where((F.col("n") >= LONG) & (F.col("first") != F.col("last"))).select("tkey", "first")
    short = (each.where(F.col("n") < LONG).groupBy("tkey", "doc").agg(F.lit(1).alias("one"))
             .groupBy("tkey").agg(F.min("doc").alias("first"), F.count("*").alias("docs"))
             .where(F.col("docs") >= SHORT_DOCS).select("tkey", "first"))
    return long.unionByName(short)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, drop, cut): positions of dropped lines, and places of dropped passages."""
    doc = document(docs)
    with batch_rows(docs.sparkSession, BATCH):
        lines = written(_lines(docs), "lines")
    again = written(recurring(lines, doc), "templates")
    # a line's place is its position, a passage's the complement of its span
    each = lines.select("doc_id", "key", "pos", "spans", F.posexplode("keys").alias("i", "tkey")).select(
        "doc_id", "key", "tkey", F.when(F.col("pos") < 0, F.bitwise_not(F.get("spans", F.col("i")))).otherwise(F.col("pos")).alias("at"))
    met = (each.join(again, "tkey").where(doc != F.col("first"))
           .groupBy("doc_id", "key", "at").agg(F.lit(1).alias("hit")))
    met = written(met.drop("hit"), "met")
    drop_written(lines)
    drop_written(again)
    return met.groupBy("doc_id", "key").agg(
        F.collect_set(F.when(F.col("at") >= 0, F.col("at"))).alias("drop"),
        F.collect_set(F.when(F.col("at") < 0, F.bitwise_not(F.col("at")))).alias("cut"))


def without(text: str, drop, cut) -> tuple[str, int]:
    """``text`` without the dropped lines and passages, and the number of lines that are gone.

    The white space after a cut word goes with it, and so does a line of
    which no word is left.
    """
    drop = {int(x) for x in drop}
    spans = sorted((int(x) >> 32, int(x) & 0xFFFFFFFF) for x in cut)
    out, gone, word, s = [], 0, 0, 0
    for pos, line in enumerate(text.split("\n")):
        while s < len(spans) and spans[s][1] <= word:
            s += 1
        # words are counted while a span is still to come, and found where one begins before the line's end
        n = len(line.encode("utf-8", "surrogatepass").split()) if s < len(spans) else 0
        if pos in drop:
            gone += 1
        elif s == len(spans) or spans[s][0] >= word + n:
            out.append(line)
        else:
            found = [m.start() for m in WORD.finditer(line)]
            keep, at = [], s
            for i in range(word, word + n):
                while at < len(spans) and spans[at][1] <= i:
                    at += 1
                keep.append(at == len(spans) or i < spans[at][0])
            if all(keep):
                out.append(line)
            elif not any(keep):
                gone += 1
            else:
                ends = found[1:] + [len(line)]
                left = "".join(line[a:b] for a, b, k in zip(found, ends, keep) if k)
                out.append(line[:found[0]] + (left if keep[-1] else left.rstrip(" \t\r\x0b\x0c")))
        word += n
    return "\n".join(out), gone


def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines and passages cut from ``text``; all other columns unchanged.

    Documents without a repeated line or passage are returned as they are. A
    document of which no word is left is wholly repeated and goes; every other
    one stays with what is its own. Null and empty texts stay. Rows alike in
    doc_id and text are one document; null doc_ids sort first.
    """
    out = clean(docs)
    return out.where(~F.col("emptied")).select("row.*", F.col("clean").alias("_clean")) \
        .select(*[F.col("_clean").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def clean(docs: DataFrame) -> DataFrame:
    """row (struct of all columns), clean (the text that remains), n_lines, n_dropped, emptied."""
    drop = dropped_lines(docs).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "drop", "cut")
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    both = base.join(drop, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")

    @F.pandas_udf("left string, gone long")
    def remove(text: pd.Series, drop: pd.Series, cut: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if t is None else without(t, d, c) for t, d, c in zip(text, drop, cut)]
        return pd.DataFrame(rows, columns=["left", "gone"])

    hit = F.col("drop").isNotNull() & F.col("row.text").isNotNull()
    # only texts that lose something are sent to Python
    both = both.withColumn("hit", hit).withColumn("_r", remove(F.when(hit, F.col("row.text")), "drop", "cut"))
    return both.select(
        "row", F.when(F.col("hit"), F.col("_r.left")).otherwise(F.col("row.text")).alias("clean"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("hit"), F.col("_r.gone")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(F.col("hit"), ~F.col("_r.left").rlike(f"[^{SPACE_CLASS}]")).otherwise(F.lit(False)).alias("emptied"))


def op7_query(spark, sf_dir):
    out = clean(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "emptied", F.col("clean").alias("text"))
