"""Removal of repeated byte strings by sorting suffixes (op11).

A window is a string of ``SPAN`` bytes at some start in a document; it is
repeated if the same string starts earlier. Each window is dealt by its
anchor, the leftmost of its ``GRAM``-byte strings of least hash, so equal
windows meet whatever surrounds them. Windows next to each other mostly share
the anchor; they travel as one segment of text.

A task sorts the windows of the segments it holds, each a suffix cut at
``SPAN`` bytes, deep-shallow: multikey quicksort over characters of eight
bytes down to ``SHALLOW`` bytes, where nearly all different suffixes have
parted, then a blind trie for each group that still agrees. A trie's edge is
skipped, its members compared with the first only; they are sorted at its
branching character alone. What still agrees at ``SPAN`` is one string; all
but its first start are repeated.

Only anchors that at least two different segments share are dealt: chunks of
text are written once, say which anchors they hold, and are told which of
those are shared. Segments that are equal as a whole are put together in a
chunk before they are dealt, and in a task. An anchor of very many different
segments (a common passage in many contexts) would still fill one task: the
windows of such segments are dealt one by one, by their whole content.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import drop_written, read, written

SPAN, GRAM, SHALLOW = 100, 32, 24
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
PLACE_BITS = np.uint64(24)
LEAST_ID = -(1 << 63)
SEGMENT = "key long, doc long, dig long, lo long, off int, n int, seg binary"
COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]
MARK = "doc long, dig long, lo long, n long"


class Sizes(NamedTuple):
    """How the work is dealt; results do not depend on it."""

    chunk: int = 2 << 20         # bytes of text in a chunk
    piece: int = 64 << 10        # window starts in a piece of a document
    task_bytes: int = 8 << 20    # bytes of anchors or segments in a task
    common: int = 4000           # different segments of an anchor from which on their windows are dealt one by one


SIZES = Sizes()


# ------------------------------------------------------------------ segments

def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every place, by doubling."""
    with np.errstate(over="ignore"):
        h = (text.astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[0]
        h ^= h >> np.uint64(29)
        size = 1
        for m in MULTIPLIERS[:GRAM.bit_length() - 1]:
            h = h[:-size] * m + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
        return h * MULTIPLIERS[1]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if width > size else v


def segments(text: np.ndarray, first: np.ndarray, count: np.ndarray):
    """(First start, windows, anchor, anchor's hash) of the segments of the windows starting in the given ranges."""
    h = gram_hashes(text)
    tagged = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(tagged, SPAN - GRAM + 1)
    starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    anchor = (least[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(at, append=len(starts)), anchor[at], h[anchor[at]].view(np.int64)


def _gather(batches, sizes: Sizes):
    """Whole documents in chunks: rows (chunk, doc, dig, size, text) with their texts one after another, compressed."""
    import zstandard
    from pyspark import TaskContext
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

    def row():
        doc, dig, raw = zip(*held)
        return pd.DataFrame({"chunk": [chunk], "doc": [list(doc)], "dig": [list(dig)], "size": [[len(r) for r in raw]],
                             "text": [zstandard.compress(b"".join(raw), 3)]})

    for pdf in batches:
        for doc, dig, text in zip(pdf["doc"], pdf["dig"], pdf["text"]):
            held.append((doc, dig, text.encode()))
            size += len(held[-1][2])
            if size >= sizes.chunk:
                yield row()
                chunk, held, size = chunk + 1, [], 0
    if held:
        yield row()


def _pieces(row, sizes: Sizes):
    """(doc, dig, start in the document, bytes) of a chunk in order of position, equal ones once."""
    import zstandard
    text, at, out = zstandard.decompress(row.text), 0, set()
    for doc, dig, size in zip(row.doc, row.dig, row.size):
        for lo in range(at, at + size - SPAN + 1, sizes.piece):
            out.add((int(doc), int(dig), lo - at, text[lo:min(lo + sizes.piece + SPAN - 1, at + size)]))
        at += size
    return sorted(out)


def _cut(pieces):
    """Segments of a chunk, equal ones once: columns of SEGMENT with ``seg``, and marks of the later ones."""
    raw = b"".join(p[3] for p in pieces)
    size = np.array([len(p[3]) for p in pieces])
    base = np.cumsum(size) - size
    lo, n, anchor, key = segments(np.frombuffer(raw, np.uint8), base, size - SPAN + 1)
    piece = np.searchsorted(base, lo, "right") - 1
    doc, dig, start = (np.array([p[i] for p in pieces], np.int64)[piece] for i in range(3))
    known: dict[bytes, int] = {}
    segs = [raw[a:b] for a, b in zip(lo.tolist(), (lo + n + SPAN - 1).tolist())]
    firsts = np.fromiter((known.setdefault(s, i) for i, s in enumerate(segs)), np.int64, len(segs))
    once = firsts == np.arange(len(segs))
    table = pd.DataFrame({"key": key, "doc": doc, "dig": dig, "lo": lo - base[piece] + start, "off": (anchor - lo).astype(np.int32),
                          "n": n.astype(np.int32)})
    kept = table[once].copy()
    kept["seg"] = [segs[i] for i in np.flatnonzero(once)]
    return kept, join_runs(table[~once])


def join_runs(marks: pd.DataFrame) -> pd.DataFrame:
    """Marks (doc, dig, lo, n) with runs that touch or overlap put together."""
    marks = marks[["doc", "dig", "lo", "n"]].sort_values(["doc", "dig", "lo"])
    if not len(marks):
        return marks
    doc, dig, lo, n = (marks[c].to_numpy(np.int64) for c in marks)
    # starts of one piece of text, never two at one place: neighbours touch
    new = np.ones(len(lo), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(dig) != 0) | (lo[1:] > lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(lo + n, at)
    return pd.DataFrame({"doc": doc[at], "dig": dig[at], "lo": lo[at], "n": end - lo[at]})


def _windows(table: pd.DataFrame) -> pd.DataFrame:
    """Segments as single windows, dealt by their whole content; equal windows once, with marks of the later ones."""
    import xxhash
    rows, known, marks = [], {}, []
    for key, doc, dig, lo, off, n, seg in table.sort_values(["doc", "dig", "lo"])[COLUMNS].itertuples(index=False):
        for t in range(n):
            window = seg[t:t + SPAN]
            if window in known:
                marks.append((doc, dig, lo + t, 1))
            else:
                known[window] = True
                rows.append((xxhash.xxh64_intdigest(window) - (1 << 63), doc, dig, lo + t, off - t, 1, window))
    return pd.DataFrame(rows, columns=COLUMNS), join_runs(pd.DataFrame(marks, columns=["doc", "dig", "lo", "n"]))


def _as_rows(marks: pd.DataFrame) -> pd.DataFrame:
    """Marks in the columns of segments (no text), dealt by document."""
    return pd.DataFrame({"key": marks["doc"] ^ marks["dig"], "doc": marks["doc"], "dig": marks["dig"], "lo": marks["lo"], "off": 0,
                         "n": marks["n"], "seg": None}, columns=COLUMNS)


# ------------------------------------------------------------------ deep-shallow sorting

def _split(order: np.ndarray, group: np.ndarray, word: np.ndarray):
    """One step of multikey quicksort: members sorted by character inside their group, in new groups; those alone go."""
    by = np.lexsort((word, group))
    order, group, word = order[by], group[by], word[by]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group) != 0) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(order))
    many = np.repeat(size > 1, size)
    return order[many], np.repeat(np.arange(len(at)), size)[many]


def equal_suffixes(text: bytes, starts: np.ndarray, group: np.ndarray):
    """(Members, class) of the suffixes, ``SPAN`` bytes each, that equal another one of their group."""
    padded = text + bytes(8)
    chars = np.empty(len(padded) - 7, np.uint64)        # the eight bytes at every place, first byte highest
    for r in range(8):
        part = np.frombuffer(padded, ">u8", offset=r, count=(len(padded) - r) // 8)
        chars[r::8] = part
    order = np.argsort(group, kind="stable")
    order, group = _split(order, group[order], np.zeros(len(order), np.uint64))
    depths = [*range(0, SPAN - 8, 8), SPAN - 8]
    for depth in [d for d in depths if d < SHALLOW]:    # shallow: multikey quicksort
        order, group = _split(order, group, chars[starts[order] + depth])
    for depth in [d for d in depths if d >= SHALLOW]:   # deep: blind tries, one level of all of them at a time
        if not len(order):
            break
        word = chars[starts[order] + depth]
        at = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(at, append=len(order))
        agree = np.logical_and.reduceat(word == np.repeat(word[at], size), at)
        edge = np.repeat(agree, size)                   # the whole group follows one edge: nothing to sort
        branch, parts = _split(order[~edge], group[~edge], word[~edge])
        order = np.concatenate([order[edge], branch])
        group = np.concatenate([group[edge], parts + (int(group.max()) + 1)])
    return order, group


def repeated(table: pd.DataFrame) -> pd.DataFrame:
    """Marks of the repeated windows among the segments of one task."""
    table = table.sort_values(["doc", "dig", "lo"], ignore_index=True)
    segs = table["seg"].tolist()
    known: dict[bytes, int] = {}
    firsts = np.fromiter((known.setdefault(s, i) for i, s in enumerate(segs)), np.int64, len(segs))
    place = table[["doc", "dig", "lo"]].to_numpy(np.int64)
    whole = np.any(place != place[firsts], axis=1)      # equal to a segment at an earlier place
    marks = [table.loc[whole, ["doc", "dig", "lo", "n"]]]

    once = np.flatnonzero(firsts == np.arange(len(segs)))
    _, group, size = np.unique(table["key"].to_numpy()[once], return_inverse=True, return_counts=True)
    met = size[group] > 1                               # anchors in several different segments
    once, group = once[met], group[met]
    if len(once):
        n = table["n"].to_numpy(np.int64)[once]
        text = b"".join(segs[i] for i in once)
        base = np.cumsum(n + SPAN - 1) - (n + SPAN - 1)
        seg = np.repeat(np.arange(len(once)), n)
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # equal windows have their anchor at the same distance
        order, cls = equal_suffixes(text, base[seg] + t, group[seg] * SPAN + table["off"].to_numpy(np.int64)[once][seg] - t)
        at = np.flatnonzero(np.diff(cls, prepend=-1)) if len(cls) else np.zeros(0, np.int64)
        first = np.minimum.reduceat(order, at) if len(at) else order       # members are numbered in order of position
        later = order != np.repeat(first, np.diff(at, append=len(order)))
        w = order[later]
        rows = table.loc[once[seg[w]], ["doc", "dig", "lo"]]
        marks.append(pd.DataFrame({"doc": rows["doc"].to_numpy(), "dig": rows["dig"].to_numpy(), "lo": rows["lo"].to_numpy() + t[w], "n": 1}))
    return join_runs(pd.concat(marks))


# ------------------------------------------------------------------ jobs

def _texts(docs: DataFrame) -> DataFrame:
    """doc (null: the least number), dig (of the text) and text of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(text).alias("dig"), text.alias("text"))


def _shared(batches, common: int):
    """What the chunks are told: the anchors (key, n different segments) that are shared, and those of very many segments."""
    held = [pdf for pdf in batches if len(pdf)]
    if held:
        asked = pd.concat(held)
        _, at = np.unique(asked["key"].to_numpy(), return_inverse=True)
        asked["all"] = np.bincount(at, weights=asked["n"].to_numpy())[at].astype(np.int64)
        yield asked[asked["all"] > 1].assign(common=lambda x: x["all"] >= common)[["chunk", "key", "n", "common"]]


def marks(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """Runs (doc, dig, lo, n) of starts of repeated windows, written."""
    chunks = written(_texts(docs).mapInPandas(lambda batches: _gather(batches, sizes),
                                              "chunk long, doc array<long>, dig array<long>, size array<long>, text binary"), "chunks")

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pieces = _pieces(row, sizes)
                if pieces:
                    key, n = np.unique(_cut(pieces)[0]["key"].to_numpy(), return_counts=True)
                    yield pd.DataFrame({"chunk": row.chunk, "key": key, "n": n})

    size = chunks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # an anchor stands for some 35 bytes of text and is asked for by 24
    answers = written(chunks.mapInPandas(ask, "chunk long, key long, n long").repartition(max(1, -(-size // sizes.task_bytes)), "key")
                      .mapInPandas(lambda batches: _shared(batches, sizes.common), "chunk long, key long, n long, common boolean"), "answers")
    n = answers.groupBy("common").agg(F.sum("n").alias("n"))
    dealt = sum(r["n"] * ((SPAN - GRAM + 1) * SPAN if r["common"] else 3 * SPAN // 2) for r in n.collect())

    def deal(key, chunk, told):
        if not len(chunk):
            return pd.DataFrame([], columns=COLUMNS)
        pieces = _pieces(next(chunk.itertuples(index=False)), sizes) if len(told) else []
        if not pieces:
            return pd.DataFrame([], columns=COLUMNS)
        table, later = _cut(pieces)
        out = [_as_rows(later)]
        table = table[np.isin(table["key"].to_numpy(), told["key"].to_numpy(np.int64))]
        single = np.isin(table["key"].to_numpy(), told.loc[told["common"], "key"].to_numpy(np.int64))
        out.append(table[~single])
        if single.any():
            windows, later = _windows(table[single])
            out += [_as_rows(later), windows]
        return pd.concat(out)[COLUMNS]

    def sort(batches):
        held = []
        for pdf in batches:
            text = pdf["seg"].notna()
            held.append(pdf[text])
            yield pdf.loc[~text, ["doc", "dig", "lo", "n"]]
        if held:
            yield repeated(pd.concat(held))

    told = answers.select(F.col("chunk").alias("_chunk"), "key", "common")
    found = written(chunks.groupBy("chunk").cogroup(told.groupBy("_chunk")).applyInPandas(deal, SEGMENT)
                    .repartition(max(1, -(-dealt // sizes.task_bytes)), "key").mapInPandas(sort, MARK), "marks")
    drop_written(chunks)
    drop_written(answers)
    return found


def spans(starts) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a document from the runs (lo, n) of its repeated windows."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted(starts):
        end = lo + n - 1 + SPAN
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def remove(docs: DataFrame, text: bool = False, sizes: Sizes = SIZES) -> DataFrame:
    """Documents without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept (binary)].

    A null text is empty; a null doc_id comes before all others; texts of one
    doc_id are ordered by a hash of theirs. Rows equal in doc_id and text are
    one document, each returned. Texts of under ``SPAN`` bytes lose nothing.
    An empty table gives no rows; other columns are ignored.
    """
    import hashlib
    found = marks(docs, sizes).groupBy("doc", "dig").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    found = found.select(F.col("doc").alias("_doc"), F.col("dig").alias("_dig"), "runs")
    joined = _texts(docs).join(found, (F.col("doc") == F.col("_doc")) & (F.col("dig") == F.col("_dig")), "left").select("doc", "text", "runs")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else "")

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, whole, runs in zip(pdf["doc"], pdf["text"], pdf["runs"]):
                raw = whole.encode()
                gone = spans((r["lo"], r["n"]) for r in runs) if runs is not None else []
                edges = [0, *(e for s in gone for e in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                rows.append(row + (kept,) if text else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64").mask(out["doc_id"] == LEAST_ID)
            yield out

    return joined.mapInPandas(cut, schema)


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that start earlier too."""
    return remove(read(spark, sf_dir, "documents"))
