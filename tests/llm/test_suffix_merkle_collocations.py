"""Suffix dedup, Merkle manifest and collocations against plain versions, on sf0.001 and on odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from dpframe.llm import collocations, merkle, suffix_dedup
from odd_rows import DOCS, ODD

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_as_sql(got, sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(sql).df()[list(got.columns)]
    order = list(got.columns)
    a, b = (x.sort_values(order, ignore_index=True).astype(object).where(lambda v: v.notna(), None) for x in (got, want))
    assert a.values.tolist() == b.values.tolist()


# ---------------------------------------------------------------- op11

def plain_removal(rows, span=100):
    """(n_bytes, n_removed, n_spans, kept hash) of each (doc_id, text), in order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            window = raw[p:p + span]
            if window in seen:
                gone[p:p + span] = b"\1" * span
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


def removal(df):
    return {r["doc_id"]: tuple(r)[1:5] for r in df.collect()}


def test_removed_strings_equal_every_window_compared(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    assert removal(suffix_dedup.remove(docs)) == dict(zip([r[0] for r in rows], plain_removal(rows)))


def test_common_anchor_pieces_and_runs(spark):
    """A passage in many contexts, overlaps inside one document, a text of several pieces, one-letter runs."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(list("abcdefgh"), n).tolist())
    passage = word(70)
    rows = [(i, f"{word(40)} {passage} {word(40)}") for i in range(60)]
    rows += [(100, "x" * 450), (101, "ab" * 200 + "x" * 150), (102, word(3000)), (103, passage[:99]), (104, passage[20:120] + "é" * 60)]
    rows += [(105, rows[62][1][:5000] + "é" + rows[62][1][1000:])]
    want = dict(zip([r[0] for r in rows], plain_removal(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    small = suffix_dedup.Sizes(chunk=3000, piece=700, task_bytes=9000, common=2)
    assert removal(suffix_dedup.remove(df, sizes=small)) == want
    assert removal(suffix_dedup.remove(df, sizes=small._replace(common=10 ** 9))) == want
    assert removal(suffix_dedup.remove(df)) == want


def test_kept_bytes_are_the_texts_without_their_spans(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300)) + "tail"
    df = spark.createDataFrame([(1, text), (2, "head" + text[:150] + "rest" * 30)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove(df, text=True).collect()}
    assert hashlib.sha256(got[2]).hexdigest() == plain_removal([(1, text), (2, "head" + text[:150] + "rest" * 30)])[1][3]


def test_equal_suffixes_are_those_that_agree():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"ab"), 600, p=[0.97, 0.03]).tolist())
    starts = np.arange(len(text) - 99)
    order, group = suffix_dedup.equal_suffixes(text, starts, starts % 2)
    got = collections.defaultdict(set)
    for i, g in zip(order.tolist(), group.tolist()):
        got[g].add(i)
    want = collections.defaultdict(set)
    for i in starts.tolist():
        want[text[i:i + 100], i % 2].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_removal_of_odd_rows(spark, odd, none):
    got = sorted(map(tuple, suffix_dedup.remove(odd).collect()), key=str)
    rows = list(dict.fromkeys((r[0], r[1]) for r in ODD))       # equal rows are one document
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))      # null first; the two null ids hold one text
    plain = dict(zip(rows, plain_removal(rows)))
    want = sorted(((r[0], *plain[r[0], r[1]]) for r in ODD), key=str)
    assert got == want
    assert suffix_dedup.remove(none).collect() == []


# ---------------------------------------------------------------- op12

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Proof rows of (doc_id, source, lang, n_chars, text) rows, from whole trees."""
    def leaf_of(r):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            first = at // 8 * 8
            yield "".join(level[first:at]), "".join(level[at + 1:first + 8])
            at //= 8

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*path(trees[g], at), *path(top, k)]
            folded = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf_of((*r[:4], r[4].translate(LOWER) if r[4] is not None else None))
            for a, b in steps:
                folded = sha(a, folded, b)
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


def test_proofs_equal_whole_trees(spark, docs):
    got = merkle.op12_query(spark, SF).toPandas()
    same_as_sql(got, merkle.ORACLE, pd.read_parquet(f"{SF}/documents.parquet"))
    rows = [tuple(r) for r in docs.select(*merkle.LEAF_COLUMNS).collect()]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(plain_manifest(rows))


def test_many_leaves_and_languages(spark):
    """Trees of 1, 8, 9, 512, 513 and 700 leaves, over 600 languages."""
    sizes = {None: 700, "é": 513, "en": 512, "EN": 9, "": 8} | {f"x{i}": 1 for i in range(600)}
    rows = [(n * 1000 + i, "s", lang, i, f"Text {i} of {lang}") for n, (lang, m) in enumerate(sizes.items()) for i in range(m)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    built = merkle.manifest(df)
    assert [x.count() for x in built[0]] == [len(rows), 605 + 2, 605]
    got = [tuple(r) for r in merkle.prove(*built).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))
    wanted = spark.createDataFrame([(3,), (1512,), (60_000,), (-1,)], "doc_id long")
    assert sorted(map(tuple, merkle.prove(*built, wanted).collect())) == sorted(r for r in got if r[0] in (3, 1512, 60_000))


def test_manifest_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select(*merkle.LEAF_COLUMNS).collect()]
    got = [tuple(r) for r in merkle.prove(*merkle.manifest(odd)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert merkle.prove(*merkle.manifest(none)).collect() == []


# ---------------------------------------------------------------- op13

def test_collocations_equal_sql(spark, docs):
    """Every phrase met 5 times, so that the small table has phrases of all sizes."""
    sql = collocations.ORACLE.replace(f"f >= {collocations.LEAST}", "f >= 5").replace(f"rank <= {collocations.TOP}", "rank <= 300")
    got = collocations.collocations(docs, least=5, top=300).toPandas()
    assert got["phrase"].str.count(" ").max() == 4
    same_as_sql(got, sql, pd.read_parquet(f"{SF}/documents.parquet"))


def test_collocations_over_many_blocks(spark, docs):
    """Tiny blocks, tiles and merges give the same rows."""
    want = collocations.collocations(docs, least=5, top=300).toPandas()
    small = collocations.Tiling(side=16, crowded=40, fan_in=3, block_bytes=20_000)
    got = collocations.collocations(docs.repartition(6), least=5, top=300, tiling=small).toPandas()
    order = ["lang", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_tiles_count_every_pair():
    rng = np.random.default_rng(2)
    a, b = rng.zipf(1.3, 200_000) % 5000 + 1, rng.zipf(1.3, 200_000) % 5000 + 1
    want = collections.Counter(zip(a.tolist(), b.tolist()))
    got = {}
    side = collocations.TILING.side
    for ta, tb, cells, counts in collocations.tiles(a, b):
        for c, n in zip(cells.tolist(), counts.tolist()):
            got[ta * side + c // side + 1, tb * side + c % side + 1] = n
    assert got == want


def test_collocations_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(20, "a b a b a b\tA  b. a b, c \x0bb\x0ca \x1cb", None, "k", 1, "x", "k", "n")], DOCS)
    table = odd.union(more)
    sql = collocations.ORACLE.replace(f"f >= {collocations.LEAST}", "f >= 2")
    same_as_sql(collocations.collocations(table, least=2).toPandas(), sql, table.toPandas())
    assert collocations.collocations(none).collect() == []
