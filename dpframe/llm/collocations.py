"""Phrase collocations by direct-address pair tiles (op13).

Words of a language are ranked by frequency and numbered. The ids of two
neighbours address a cell of a square tile of pairs: a block of
text counts its crowded tiles with a dense ``bincount`` and all others as
sorted coordinate lists, and tiles of many blocks are added up cell by cell.
Frequent pairs are ranked and numbered again and, as the first of a pair with
the next word, make the phrases one word longer, up to ``LONGEST`` words.

Text is tokenized once into blocks of ids; ids of words and phrases reach a
block as messages for what it holds, so nothing that grows with the corpus
is broadcast. Tiles are merged in groups of a few blocks, so the tile
of the commonest words is no task's whole work.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dpframe.llm.common import drop_written, read, written
from dpframe.llm.order import place

LEAST, LONGEST, TOP = 100, 5, 2000
BREAK = b"\xff"
TO_BREAK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")
STATE = "block long, lang string, words binary, symbols binary"
TILE = "block long, lang string, ta long, tb long, cells binary, counts binary"
TOTAL = "lang string, ta long, tb long, salt long, cells binary, counts binary"
FOUND = "block long, lang string, ta long, tb long, cells binary, ids binary"


class Tiling(NamedTuple):
    """Ids along a tile, pairs from which a tile is counted densely, blocks merged at once, bytes of text in a block."""

    side: int = 1024
    crowded: int = 1 << 16
    fan_in: int = 64
    block_bytes: int = 8 << 20


TILING = Tiling()


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs (4 or 8), bytes of equal weight together.

    The upper bytes are mostly 0, so that a shuffle's or a file's compression packs them well.
    """
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _cells(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=0))


def _from_cells(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw))


def _pack(values: np.ndarray) -> bytes:
    import zstandard
    return zstandard.compress(_planes(values), 1)


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard
    return _numbers(zstandard.decompress(raw))


# ------------------------------------------------------------------ tiles

def tiles(a: np.ndarray, b: np.ndarray, tiling: Tiling = TILING):
    """Counts of the pairs (a, b) of ids from 1: rows (ta, tb, cells, counts), cells in ascending order."""
    side, square = tiling.side, tiling.side ** 2
    ta, tb = (a - 1) // side, (b - 1) // side
    cell = (a - 1) % side * side + (b - 1) % side
    across = int(tb.max(initial=0)) + 1
    tile, which, size = np.unique(ta * across + tb, return_inverse=True, return_counts=True)
    for t in np.flatnonzero(size >= tiling.crowded):          # direct address: one counter a cell
        counts = np.bincount(cell[which == t], minlength=square)
        cells = np.flatnonzero(counts)
        yield int(tile[t]) // across, int(tile[t]) % across, cells, counts[cells]
    rest = size[which] < tiling.crowded                       # sorted coordinates
    coo, counts = np.unique(which[rest] * square + cell[rest], return_counts=True)
    starts = np.flatnonzero(np.diff(coo // square, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(coo)]):
        t = int(tile[coo[i] // square])
        yield t // across, t % across, coo[i:j] % square, counts[i:j]


class TileSum:
    """Sum of one tile's counts: a counter a cell once it is crowded, coordinates until then."""

    def __init__(self, tiling: Tiling = TILING):
        self.tiling = tiling
        self.parts, self.size, self.dense = [], 0, None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        if self.dense is None and self.size + len(cells) < self.tiling.crowded:
            self.parts.append((cells, counts))
            self.size += len(cells)
            return
        if self.dense is None:
            self.dense = np.zeros(self.tiling.side ** 2, np.int64)
            for c, n in self.parts:
                self.dense[c] += n
            self.parts = []
        self.dense[cells] += counts                    # a part names each cell once

    def total(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            cells = np.flatnonzero(self.dense >= max(least, 1))
            return cells, self.dense[cells]
        cells = np.concatenate([c for c, _ in self.parts])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], np.concatenate([n for _, n in self.parts])[order]
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        cells, counts = cells[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        return cells[counts >= least], counts[counts >= least]


def _runs(batches, keys: list[str]):
    """(Key, rows) of sorted batches, the rows as an iterator."""
    from itertools import groupby
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    return groupby(rows, key=lambda r: tuple(getattr(r, k) for k in keys))


def _merge(parts: DataFrame, least: int, tiling: Tiling) -> DataFrame:
    """Tiles of one key (lang, ta, tb, salt) added up; only cells counted ``least`` times stay."""
    keys = ["lang", "ta", "tb", "salt"]

    def add(batches):
        rows, held = [], 0
        for key, run in _runs(batches, keys):
            tile = TileSum(tiling)
            for r in run:
                tile.add(_from_cells(r.cells), _numbers(r.counts))
            cells, counts = tile.total(least)
            if len(cells):
                rows.append((*key, _cells(cells), _planes(counts)))
                held += len(cells)
            if held > 1 << 20:
                yield pd.DataFrame(rows, columns=keys + ["cells", "counts"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=keys + ["cells", "counts"])

    return parts.select(*keys, "cells", "counts").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, TOTAL)


def _totals(counted: DataFrame, blocks: int, least: int, tiling: Tiling) -> DataFrame:
    """Rows (lang, a, b, f) of all pairs counted at least ``least`` times."""
    salts = -(-blocks // tiling.fan_in)
    parts, old = counted.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))), None
    while salts > 1:
        merged = written(_merge(parts, 1, tiling), "tiles")
        if old is not None:
            drop_written(old)
        parts = old = merged
        salts = -(-salts // tiling.fan_in)
        parts = parts.withColumn("salt", F.pmod("salt", F.lit(salts)))

    side = tiling.side

    def cells(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cell = _from_cells(r.cells)
                yield pd.DataFrame({"lang": r.lang, "a": r.ta * side + cell // side + 1, "b": r.tb * side + cell % side + 1,
                                    "f": _numbers(r.counts)})

    return _merge(parts, least, tiling).mapInPandas(cells, "lang string, a long, b long, f long")


# ------------------------------------------------------------------ blocks of text

def _blocks(docs: DataFrame, tiling: Tiling) -> DataFrame:
    """Blocks (block, lang, codes, words, counts): texts as numbers of the block's own words, 0 between pieces."""
    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        first, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def rows(held, block):
            out = []
            for lang, texts in held.items():
                raw = BREAK.join(texts).lower().translate(TO_BREAK).replace(BREAK, b" " + BREAK + b" ")
                coded = pa.array([BREAK] + raw.split(), pa.binary()).dictionary_encode()
                codes = coded.indices.to_numpy()                       # the break is word 0
                words = [w.decode() for w in coded.dictionary.to_pylist()[1:]]
                out.append((block, lang, _pack(codes), words, np.bincount(codes, minlength=len(words) + 1)[1:]))
            return pd.DataFrame(out, columns=["block", "lang", "codes", "words", "counts"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                text = text.encode()
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= tiling.block_bytes:
                    yield rows(held, first)
                    first, held, size = first + 1, {}, 0
        if held:
            yield rows(held, first)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInPandas(cut, "block long, lang string, codes binary, words array<string>, counts array<long>")


def _first_state(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks as ids of frequent words (0: any other word or a break), from messages (block, lang, code, id)."""
    def fill(key, part, found):
        if not len(part):
            return pd.DataFrame([], columns=["block", "lang", "words", "symbols"])
        codes = _unpack(part["codes"].iloc[0])
        to = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        to[found["code"].to_numpy(np.int64)] = found["id"].to_numpy(np.int64)
        words = _pack(to[codes])
        return pd.DataFrame({"block": [key[0]], "lang": [key[1]], "words": [words], "symbols": [words]})

    ids = ids.select(F.col("block").alias("_block"), F.col("lang").alias("_lang"), "code", "id")
    return blocks.select("block", "lang", "codes").groupBy("block", "lang").cogroup(ids.groupBy("_block", "_lang")).applyInPandas(fill, STATE)


def _pairs(words: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Places where a phrase of ``length`` words may go on: it and the phrase one word later are both frequent."""
    return np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))[:max(len(words) - length, 0)]


def _count(state: DataFrame, length: int, tiling: Tiling) -> DataFrame:
    """Tiles of (phrase of ``length`` words, next word) of every block."""
    def count(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, symbols = _unpack(r.words), _unpack(r.symbols)
                at = _pairs(words, symbols, length)
                rows = [(r.block, r.lang, ta, tb, _cells(cells), _planes(counts))
                        for ta, tb, cells, counts in tiles(symbols[at], words[at + length], tiling)]
                yield pd.DataFrame(rows, columns=["block", "lang", "ta", "tb", "cells", "counts"])

    return state.mapInPandas(count, TILE)


def _answers(counted: DataFrame, ranked: DataFrame, blocks: int, tiling: Tiling) -> DataFrame:
    """For every block's tile, the frequent cells it holds and their ids."""
    salts = -(-blocks // tiling.fan_in)
    side = tiling.side
    cell = F.expr(f"(a - 1) % {side} * {side} + (b - 1) % {side}")

    def binary(batches):
        for pdf in batches:
            pdf["cells"] = [_cells(np.asarray(c, np.int64)) for c in pdf["cells"]]
            pdf["ids"] = [_planes(np.asarray(c, np.int64)) for c in pdf["ids"]]
            yield pdf

    frequent = (ranked.groupBy("lang", F.expr(f"(a - 1) div {side}").alias("ta"), F.expr(f"(b - 1) div {side}").alias("tb"))
                .agg(F.sort_array(F.collect_list(F.struct(cell.alias("c"), "id"))).alias("x"))        # at most a tile
                .select(F.lit(-1).cast("long").alias("block"), "lang", "ta", "tb", F.col("x.c").alias("cells"), F.col("x.id").alias("ids"))
                .mapInPandas(binary, FOUND)
                .withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))))
    asked = counted.select("block", "lang", "ta", "tb", "cells", F.lit(b"").alias("ids"),
                           F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    keys = ["lang", "ta", "tb", "salt"]

    def answer(batches):
        rows, held = [], 0
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for key, run in _runs(batches, keys):
            known = None
            for r in run:
                cells = _from_cells(r.cells)
                if r.block < 0:
                    known, ids = cells, _numbers(r.ids)
                elif known is None:
                    break                                # nothing in this tile is frequent
                else:
                    at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
                    hit = known[at] == cells
                    if hit.any():
                        rows.append((r.block, *key[:3], _cells(cells[hit]), _planes(ids[at[hit]])))
                        held += len(cells)
                if held > 1 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return frequent.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "block").mapInPandas(answer, FOUND)


def _next_state(state: DataFrame, answers: DataFrame, length: int, tiling: Tiling) -> DataFrame:
    """Symbols of phrases one word longer, where they are frequent."""
    side = tiling.side

    def fill(key, part, found):
        if not len(part):
            return pd.DataFrame([], columns=["block", "lang", "words", "symbols"])
        words, symbols = _unpack(part["words"].iloc[0]), _unpack(part["symbols"].iloc[0])
        out = np.zeros(len(words), np.int64)
        if len(found):
            cells = [_from_cells(c) for c in found["cells"]]
            a = np.concatenate([ta * side + c // side + 1 for ta, c in zip(found["ta"], cells)])
            b = np.concatenate([tb * side + c % side + 1 for tb, c in zip(found["tb"], cells)])
            ids = np.concatenate([_numbers(c) for c in found["ids"]])
            at = _pairs(words, symbols, length)
            # ids of the block's own pairs, numbered within the block so that two fit one integer
            ua, ub = np.unique(a), np.unique(b)
            key_of = np.searchsorted(ua, a) * len(ub) + np.searchsorted(ub, b)
            order = np.argsort(key_of)
            pa, pb = (np.minimum(np.searchsorted(u, x), len(u) - 1) for u, x in ((ua, symbols[at]), (ub, words[at + length])))
            mine = np.where((ua[pa] == symbols[at]) & (ub[pb] == words[at + length]), pa * len(ub) + pb, -1)
            place_of = np.minimum(np.searchsorted(key_of[order], mine), len(order) - 1)
            hit = key_of[order][place_of] == mine
            out[at[hit]] = ids[order][place_of[hit]]
        return pd.DataFrame({"block": [key[0]], "lang": [key[1]], "words": [_pack(words)], "symbols": [_pack(out)]})

    return state.groupBy("block", "lang").cogroup(answers.groupBy("block", "lang")).applyInPandas(fill, STATE)


# ------------------------------------------------------------------ phrases

def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST,
                     tiling: Tiling = TILING) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, size, f) of 1 to ``longest`` words met ``least`` times, and the words n of each language."""
    blocks = written(_blocks(docs, tiling), "blocks")
    n_blocks = max(blocks.select("block").distinct().count(), 1)
    held = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")) \
        .select("block", "lang", (F.col("code") + 1).alias("code"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    vocabulary = written(held.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    words = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = place(vocabulary.where(F.col("f") >= least), "lang", [F.col("f").desc(), F.col("word")], "ranks") \
        .select("lang", "word", "f", (F.col("pos") + 1).alias("id"))
    single = written(ranked, "ids")
    numbers = single.select(F.lit(-1).cast("long").alias("block"), "lang", F.col("id").alias("code"), "word")
    asked = numbers.union(held.select("block", "lang", "code", "word"))
    known = F.last(F.when(F.col("block") < 0, F.col("code")), ignorenulls=True).over(
        Window.partitionBy("lang", "word").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    state = written(_first_state(blocks, asked.select("block", "lang", "code", known.alias("id")).where("block >= 0 and id is not null")), "state")
    drop_written(blocks)
    level = single.select("lang", "id", F.col("word").alias("phrase"), "f")
    phrases = [level]
    for length in range(1, longest):
        counted = written(_count(state, length, tiling), "counted")
        pairs = place(_totals(counted, n_blocks, least, tiling), "lang", [F.col("f").desc(), F.col("a"), F.col("b")], "pairs") \
            .select("lang", "a", "b", "f", (F.col("pos") + 1).alias("id"))
        pairs = written(pairs, "pairs")
        level = written(pairs.join(level.select("lang", F.col("id").alias("a"), F.col("phrase").alias("head")), ["lang", "a"])
                        .join(single.select("lang", F.col("id").alias("b"), "word"), ["lang", "b"])
                        .select("lang", "id", F.concat_ws(" ", "head", "word").alias("phrase"), "f"), "phrases")
        phrases.append(level)
        if length + 1 < longest:
            answers = written(_answers(counted, pairs, n_blocks, tiling), "answers")
            drop_written(counted)
            old, state = state, written(_next_state(state, answers, length, tiling), "state")
            drop_written(old)
            drop_written(answers)
        else:
            drop_written(counted)
    out = None
    for size, level in enumerate(phrases, 1):
        rows = level.select("lang", "phrase", F.lit(size).alias("size"), "f")
        out = rows if out is None else out.union(rows)
    return out, words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 tiling: Tiling = TILING) -> DataFrame:
    """The ``top`` phrases of each language by how much oftener their two parts meet than by chance.

    Returns lang, rank, phrase, a, l, r, n, score. A null language is ``und``,
    a null text has no words; ties in score go by frequency, then phrase. An
    empty table gives no rows; repeated rows count each time; other columns
    are ignored.
    """
    phrases, words = frequent_phrases(docs, least, longest, tiling)
    found = phrases.where("size > 1")
    # a phrase inside a longer one of the same frequency lies inside one that is a word longer, of the same frequency too
    inner = found.where("size > 2").select(
        "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"),
        F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < f").drop("longer")
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("m"))
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")) \
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = (cuts.join(part.select("lang", F.col("part").alias("head"), F.col("m").alias("l")), ["lang", "head"])
            .join(part.select("lang", F.col("part").alias("tail"), F.col("m").alias("r")), ["lang", "tail"])
            .join(words, "lang"))
    # whole numbers of up to 37 digits; the quotient fits 64 bits, as l and r are at least a
    score = F.expr("(cast(a as decimal(15, 0)) * cast(n as decimal(16, 0)) * cast(1000 as decimal(4, 0))) div "
                   "(cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    best = (cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
            .select("lang", "phrase", "a", "n", "c.l", "c.r", "c.score"))
    ranked = place(best.withColumnRenamed("n", "words"), "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "scores")
    return ranked.where(F.col("pos") < top).select("lang", (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op13_query(spark, sf_dir: str) -> DataFrame:
    """Collocations of all whole texts."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
runs AS (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM cut, (VALUES (1), (2), (3), (4), (5)) x(m) WHERE len(w) >= m) y),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= {LEAST}),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM (
  SELECT lang, f AS longer, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, m - k + 2)) AS s FROM often, (VALUES (2), (3), (4)) x(k) WHERE k < m) y) z GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN inside i USING (lang, phrase) WHERE o.m > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * o.f)),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM kept, range(1, 5) x(k) WHERE k < m),
scored AS (SELECT c.*, h.f AS l, t.f AS r, n.n, (1000::HUGEINT * c.a * n.n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {TOP}"""
