"""Merkle manifest of a dataset, with stored levels and recomputed proofs (op12).

Every row is a leaf digest. The leaves of a group (a language) in ascending
order of doc_id are hashed in runs of 8 until one node, the subroot, is left;
the subroots make the root in the same way. Only every third level is stored
(``LEVELS``): a stored node covers an aligned subtree of up to 512 stored
nodes below it. A proof needs the missing levels too: the task that holds a
subtree hashes them again from its stored nodes, emits the siblings and
forgets them. No task holds more than one subtree, the driver holds nothing.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import ascii_lower, drop_written, read, written
from dpframe.llm.order import place

#: Nodes hashed into one, and levels between two stored ones.
RUN, LEVELS = 8, 3
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
CHAIN = "lefts array<string>, rights array<string>, subroot string, root string"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict[str, Column]) -> Column:
    """Digest of a row: each column as ``-`` or its UTF-8 byte count, a colon and its value."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[field(row[c]) for c in LEAF_COLUMNS]).cast("binary"), 256)


def _rounds(n: Column) -> Column:
    """Levels from a stored one to the next, for a group of ``n`` nodes (none when one node is left)."""
    out = F.lit(0)
    for k in range(LEVELS):
        out = F.when(n > RUN ** k, F.lit(k + 1)).otherwise(out)
    return out


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, pos, n, h) with their levels to the next stored node and its position."""
    return nodes.withColumn("rounds", _rounds(F.col("n"))) \
        .withColumn("up", F.expr(f"cast(pos div cast(pow({RUN}, rounds) as bigint) as bigint)"))


def _levels(h: list[str], rounds: int) -> list[list[str]]:
    """All levels of one aligned subtree, its own nodes first."""
    out = [h]
    for _ in range(rounds):
        last = out[-1]
        out.append([digest(last[i:i + RUN]) for i in range(0, len(last), RUN)])
    return out


def _raise(nodes: DataFrame) -> DataFrame:
    """The next stored level."""
    def up(key, part):
        part = part.sort_values("pos")
        rounds = int(part["rounds"].iloc[0])
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-int(part["n"].iloc[0]) // RUN ** rounds)],
                             "h": [_levels(part["h"].tolist(), rounds)[-1][0]]})

    return _subtrees(nodes).select("grp", "pos", "n", "h", "rounds", "up").groupBy("grp", "up") \
        .applyInPandas(up, "grp string, pos long, n long, h string")


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Every third level from ``nodes`` up to one node a group."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(written(_raise(levels[-1]), "merkle"))
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(Left, right) siblings of node ``at`` of a subtree, level by level."""
    out = []
    for level in levels[:-1]:
        first = at - at % RUN
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + RUN])))
        at //= RUN
    return out


def _lower(nodes: DataFrame, chains: DataFrame, keep: list[str], schema: str, row) -> DataFrame:
    """Rows of the nodes of one stored level, from their subtree and the chain of the stored node above.

    ``row(node, siblings, above)`` gives one result row for a node.
    """
    def down(key, part, above):
        columns = [c.split()[0] for c in schema.split(", ")]
        if not len(part) or not len(above):     # no proof wanted below this node
            return pd.DataFrame([], columns=columns)
        part = part.sort_values("pos")
        levels = _levels(part["h"].tolist(), int(part["rounds"].iloc[0]))
        top = above.iloc[0]
        return pd.DataFrame([row(node, _siblings(levels, i), top) for i, node in enumerate(part.itertuples())], columns=columns)

    part = _subtrees(nodes).select("grp", "pos", "h", "rounds", "up", *keep)
    return part.groupBy("grp", "up").cogroup(chains.groupBy("grp", "pos")).applyInPandas(down, schema)


def _chain_row(node, siblings, above):
    return (node.grp, node.pos, [s[0] for s in siblings] + list(above["lefts"]), [s[1] for s in siblings] + list(above["rights"]),
            above["subroot"], above["root"])


def _chains(levels: list[DataFrame], chains: DataFrame) -> DataFrame:
    """Chains (grp, pos, lefts, rights, subroot, root) of the lowest level but one, from those of the top nodes."""
    for nodes in levels[:0:-1]:
        above, chains = chains, written(_lower(nodes, chains, [], f"grp string, pos long, {CHAIN}", _chain_row), "chains")
        drop_written(above)
    return chains


def fold(h: str, lefts, rights) -> str:
    """Root recomputed from a node and its siblings (a level without siblings still hashes its only node)."""
    for a, b in zip(lefts, rights):
        h = digest((a, h, b))
    return h


def _proof_row(node, siblings, above):
    lefts, rights = [s[0] for s in siblings] + list(above["lefts"]), [s[1] for s in siblings] + list(above["rights"])
    folded = fold(node.tampered, lefts, rights)
    return (node.doc_id, node.h, above["subroot"], above["root"], digest(a + b for a, b in zip(lefts, rights)), folded,
            folded == above["root"])


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels of the groups' trees and of the tree of subroots.

    Level 0 of the first has one row per document (grp, pos, n, h, doc_id,
    tampered); the last one has the subroots. The second ends in the root.
    ``grp`` is the language after ``=``, empty for null, which sorts first.
    """
    doc_id = F.col("doc_id").cast("long")
    row = {"doc_id": doc_id, "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars"), "text": F.col("text")}
    changed = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang")).alias("grp"),
                         doc_id.alias("doc_id"), leaf(row).alias("h"),
                         F.when(changed, leaf(row | {"text": ascii_lower(F.col("text"))})).alias("tampered")) \
        .withColumn("tampered", F.coalesce("tampered", "h"))
    levels = stored_levels(place(leaves, "grp", [F.col("doc_id").asc_nulls_first(), F.col("h")], "leaves"))
    subroots = levels[-1].select(F.lit("").alias("all"), "grp", "h")
    tops = place(subroots, "all", [F.col("grp")], "subroots").select(F.col("all").alias("grp"), "pos", "n", "h", F.col("grp").alias("lang"))
    return levels, stored_levels(tops)


def prove(levels: list[DataFrame], tops: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """Proofs of all leaves, or of the aligned subtrees that hold a doc_id of ``wanted``.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    root = tops[-1].select("grp", "pos", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"),
                           F.lit("").alias("subroot"), F.col("h").alias("root"))
    root = written(root, "chains")
    # each subroot starts the chain of its group
    high = _chains(tops, root)
    langs = _lower(tops[0], high, ["lang"], f"grp string, pos long, {CHAIN}",
                   lambda node, siblings, above: (node.lang, 0, *_chain_row(node, siblings, above)[2:4], node.h, above["root"]))
    chains = _chains(levels, written(langs, "chains"))
    leaves = levels[0]
    if wanted is not None:
        held = _subtrees(leaves.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")).select("grp", "up").distinct()
        chains = chains.join(held.withColumnRenamed("up", "pos"), ["grp", "pos"], "left_semi")
    out = _lower(leaves, chains, ["doc_id", "tampered"],
                 "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
                 _proof_row)
    return out if wanted is None else out.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def op12_query(spark, sf_dir: str) -> DataFrame:
    """A proof of every document, folded again from its row as it is after tampering.

    A null column is ``-``. Rows of one doc_id are ordered by their digest, a
    null doc_id comes first and is never tampered with. Empty texts, repeated
    rows and extra columns need no care. An empty table gives no rows.
    """
    return prove(*manifest(read(spark, sf_dir, "documents")))


def _oracle() -> str:
    """The same in SQL, for at most 8^7 documents a language and 8^3 languages."""
    def text(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(text(c) for c in LEAF_COLUMNS[:-1])
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: {byte}), 4294967295)"
    ctes = [f"""leaves AS MATERIALIZED (SELECT doc_id, lang, sha256({head} || {text('text')}) AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {text(lower)}) ELSE sha256({head} || {text('text')}) END AS changed FROM documents)""",
            """l0 AS MATERIALIZED (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n, leaf AS h, doc_id, changed FROM leaves)"""]

    def tree(name: str, grp: str, depth: int):
        run = f"OVER (PARTITION BY {grp}, pos // 8 ORDER BY pos ROWS BETWEEN"
        for k in range(depth):
            ctes.append(f"""{name}s{k} AS MATERIALIZED (SELECT {grp}, pos, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})""")
            ctes.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT {grp}, pos // 8 AS pos, (n + 7) // 8 AS n,
  CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY {grp}, pos // 8, n)""")

    tree("l", "lang", 7)
    ctes.append("t0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, lang FROM l7)")
    tree("t", "g", 3)
    ctes.append("f0 AS (SELECT l0.*, changed AS f, '' AS p FROM l0)")
    for k in range(7):
        ctes.append(f"""f{k + 1} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s.n = 1 THEN f ELSE sha256(s.a || f || s.b) END AS f, p || s.a || s.b AS p
  FROM f{k} x JOIN ls{k} s ON x.lang IS NOT DISTINCT FROM s.lang AND x.pos // {8 ** k} = s.pos)""")
    ctes.append("h0 AS (SELECT f7.doc_id, f7.h AS leaf, f7.f, f7.p, t0.h AS subroot, t0.pos AS place FROM f7 JOIN t0 ON f7.lang IS NOT DISTINCT FROM t0.lang)")
    for k in range(3):
        ctes.append(f"""h{k + 1} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s.n = 1 THEN f ELSE sha256(s.a || f || s.b) END AS f, p || s.a || s.b AS p
  FROM h{k} x JOIN ts{k} s ON x.place // {8 ** k} = s.pos)""")
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, (SELECT h FROM t3) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM t3) AS verified FROM h3"""


ORACLE = _oracle()
