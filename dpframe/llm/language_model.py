"""Language-model scores by deleted interpolation of n-grams (op3).

A bigram model: the maximum-likelihood estimates c(v,w)/c(v), c(w)/N and
1/(V+1) are mixed with weights that depend on how often the context v was
seen. Expectation-maximisation learns the weights from one fold of the
training documents, whose estimates come from the counts of the others. The
scores then use the counts of all training text.

Counting and scoring are a blocked hash join. Documents are put together in
blocks of about ``BLOCK_BYTES`` bytes, each written once. A block asks
for the counts of its distinct n-grams, dealt by ranges of hashes over reducers
that add up what all blocks hold of a key and answer every block in the
order it asked. What moves is one hash per distinct n-gram and block, not
one row per token, and a frequent word is one key per block. N-grams are
known by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import batch_rows, fold, read, written

BLOCK_BYTES = 6_000_000
BLOCK_DOCS = 8192
DELETED = 3
CONTEXT_BUCKETS = 20
ITERATIONS = 60
#: Resolution of the log-estimates in the held-out table: steps per factor of 2.
GRID = 16
#: Lower bytes of the differences of hashes that deflating does not make shorter.
NOISE = 5
END, START = 0xE4D, 0x57A
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACES = b" \t\n\v\f\r"
#: Longer words (in bytes) are hashed one by one.
LONG_WORD = 64
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * C2
        z = (z ^ (z >> np.uint64(27))) * C3
        return z ^ (z >> np.uint64(31))


def _hashes(raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``raw`` that begin there, of so many bytes: eight bytes of all words at a time."""
    import xxhash
    eight = np.ndarray(len(raw), "<u8", raw + bytes(7), strides=(1,))       # the eight bytes from every place on
    with np.errstate(over="ignore"):
        out = _mix(size.astype(np.uint64) * C1)
        rest = np.arange(len(size))
        for k in range(0, LONG_WORD, 8):
            rest = rest[size[rest] > k]
            out[rest] = _mix(out[rest] * C3 + (eight[begin[rest] + k] & FIRST_BYTES[np.minimum(size[rest] - k, 8)]))
    for i in rest[size[rest] > LONG_WORD].tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i]:begin[i] + size[i]])
    return out


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of every token, hash of every code, tokens per text) of UTF-8 texts; each text ends with the end token.

    The last two codes are the end token and the start, which is no token.
    """
    raw = b" ".join([b"", *texts, b""]).translate(LOWER)
    space = IS_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    word_code, single = pd.factorize(_hashes(raw, begin, end - begin))
    n = np.diff(np.searchsorted(begin, 1 + np.cumsum([len(t) + 1 for t in texts])), prepend=0) + 1
    code = np.full(n.sum(), len(single), np.int64)
    word = np.ones(len(code), bool)
    word[np.cumsum(n) - 1] = False
    code[word] = word_code
    return code, np.append(single, np.array([END, START], np.uint64)), n


START_KEY = int(_mix(np.array([START], np.uint64) + C1)[0]) & ~1


def _grams(code: np.ndarray, single: np.ndarray, n: np.ndarray):
    """Distinct keys (sorted) and, for each token, the place of its pair, its context and itself among them.

    Single tokens have even keys, pairs odd ones; a text's first context is the start key.
    """
    context = np.empty_like(code)
    context[1:] = code[:-1]
    context[np.cumsum(n) - n] = len(single) - 1
    pair_code, pairs = pd.factorize(context * len(single) + code)
    with np.errstate(over="ignore"):
        odd = _mix(_mix(single * C1 + C3)[pairs // len(single)] + single[pairs % len(single)]) | np.uint64(1)
        even = _mix(single + C1) & ~np.uint64(1)
    keys = np.concatenate([even, odd])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], place[len(even):][pair_code], place[:len(even)][context], place[:len(even)][code]


def _cuts(keys: np.ndarray, reducers: int) -> np.ndarray:
    """Where the sorted keys of one reducer end and those of the next begin: each has an equal range of keys."""
    first = np.array([(r << 64) // reducers for r in range(1, reducers)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight together: the upper ones lightly deflated, then the ``NOISE`` lower ones."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes[NOISE:].tobytes(), 1) + planes[:NOISE].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    upper = zlib.decompressobj()
    upper, lower = upper.decompress(raw), upper.unused_data
    planes = np.concatenate([np.frombuffer(b, np.uint8).reshape(k, -1) for b, k in ((lower, NOISE), (upper, 8 - NOISE))])
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _numbers(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _from_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def make_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: block (64-bit id), deleted, doc_ids, held_out, payload (the texts, deflated).

    Deleted documents (those whose weights are learned from: crc32(doc_id)
    mod 7 is ``DELETED``) are put in blocks of their own.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       fold(F.col("doc_id"), 7).alias("fold"))

    def gather(batches):
        import uuid
        open_blocks = {False: ([], [], [], [0]), True: ([], [], [], [0])}

        def row(deleted):
            ids, held, texts, _ = open_blocks[deleted]
            payload = zlib.compress(np.array([len(r) for r in texts], "<u4").tobytes() + b"".join(texts), 1)
            open_blocks[deleted] = ([], [], [], [0])
            return pd.DataFrame({"block": [uuid.uuid4().int >> 65], "deleted": [deleted],
                                 "doc_ids": [pd.array(ids, dtype="Int64").tolist()], "held_out": [held], "payload": [payload]})

        for pdf in batches:
            for d, t, f in zip(pdf["doc_id"], pdf["text"], pdf["fold"]):
                ids, held, texts, size = open_blocks[f == DELETED]
                ids.append(None if pd.isna(d) else int(d))
                held.append(bool(f == 2))
                texts.append(t.encode("utf-8", "surrogatepass"))
                size[0] += len(texts[-1])
                if size[0] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield row(f == DELETED)
        for deleted in (False, True):
            if open_blocks[deleted][0]:
                yield row(deleted)

    schema = "block long, deleted boolean, doc_ids array<long>, held_out array<boolean>, payload binary"
    return written(base.mapInPandas(gather, schema), "blocks", codec="none")


def _texts(payload: bytes, n: int) -> list[bytes]:
    raw = zlib.decompress(payload)
    end = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
    begin = np.concatenate([[4 * n], end[:-1]])
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]


def _requests(blocks: DataFrame, reducers: int) -> DataFrame:
    """(block, deleted, reducer, keys, counts): a block's distinct n-grams and how often its training text has them."""
    def ask(batches):
        for pdf in batches:
            for block, deleted, held, payload in zip(pdf["block"], pdf["deleted"], pdf["held_out"], pdf["payload"]):
                code, single, n = _words(_texts(payload, len(held)))
                train = ~np.array(held, bool)
                keys, pair, context, word = _grams(code, single, n)
                use = np.repeat(train, n)
                counts = np.bincount(word[use], minlength=len(keys)) + np.bincount(pair[use], minlength=len(keys))
                counts[context[0]] = train.sum()          # the start key, once a document
                cuts = _cuts(keys, reducers).tolist()
                rows = [(block, deleted, r, _pack(keys[a:b]), _numbers(counts[a:b]))
                        for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pd.DataFrame(rows, columns=["block", "deleted", "reducer", "keys", "counts"])

    return blocks.select("block", "deleted", "held_out", "payload").mapInPandas(
        ask, "block long, deleted boolean, reducer int, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """Per (block, reducer): counts of the asked keys in all training text and, for deleted blocks, in deleted text.

    A reducer also reports its number of tokens and distinct words, in all
    and in deleted text, on a row of its own (block -1).
    """
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        flat, inverse = np.unique(np.concatenate([_unpack(k) for k in pdf["keys"]]), return_inverse=True)
        total, deleted = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        places, at = [], 0
        for d, raw in zip(pdf["deleted"], pdf["counts"]):
            c = _from_numbers(raw).astype(np.int64)
            places.append(inverse[at:at + len(c)])
            at += len(c)
            for sums in (total, deleted) if d else (total,):
                np.add.at(sums, places[-1], c)
        rows = []
        for block, d, mine in zip(pdf["block"], pdf["deleted"], places):
            rows.append((block, pdf["reducer"].iloc[0], _numbers(total[mine]), _numbers(deleted[mine]) if d else None, 0, 0, 0, 0))
        uni = (flat & np.uint64(1) == 0) & (flat != np.uint64(START_KEY))
        kept = total[uni] - deleted[uni]
        rows.append((-1, pdf["reducer"].iloc[0], None, None, int(total[uni].sum()), int((total[uni] > 0).sum()),
                     int(kept.sum()), int((kept > 0).sum())))
        return pd.DataFrame(rows, columns=["block", "reducer", "total", "gone", "n", "v", "kept_n", "kept_v"])

    return requests.groupBy("reducer").applyInPandas(
        add, "block long, reducer int, total binary, gone binary, n long, v long, kept_n long, kept_v long")


def _tokens_with_counts(payload, held, answers):
    """Tokens per text and, for each kind of count answered, the counts (pair, context, word) of each token.

    ``answers`` are (reducer, counts of a kind, ...): in the order of reducers they are in that of the sorted keys.
    """
    code, single, n = _words(_texts(payload, len(held)))
    _, *places = _grams(code, single, n)
    kinds = list(zip(*sorted(answers)))[1:]
    counts = [np.concatenate([_from_numbers(c) for c in kind]).astype(np.int64) for kind in kinds]
    return n, *([c[i] for i in places] for c in counts)


def _estimates(pair, context, word, n_all):
    """(pair estimate, word estimate); 0 where the context or the corpus was not seen."""
    f2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    return f2, word / max(n_all, 1)


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(count)), at most the last bucket."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), CONTEXT_BUCKETS - 1).astype(np.int64)


def learn_weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights (bucket x [pair, word, uniform]) by EM.

    ``cells`` rows are (bucket, log step of the pair estimate or -1, log step
    of the word estimate or -1, tokens). Buckets without tokens take the
    weights of the nearest lower bucket that has some.
    """
    floor = 1.0 / (vocabulary + 1)
    weights = np.tile([0.3, 0.5, 0.2], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    seen = np.zeros(CONTEXT_BUCKETS, bool)
    for b in range(CONTEXT_BUCKETS):
        c = cells[cells[:, 0] == b]
        if len(c):
            seen[b] = True
            p = np.stack([np.where(c[:, k] < 0, 0.0, 2.0 ** (-c[:, k] / GRID)) for k in (1, 2)] + [np.full(len(c), floor)], 1)
            w = weights[b]
            for _ in range(ITERATIONS):
                post = p * w
                post /= post.sum(axis=1, keepdims=True)
                w = (post * c[:, 3:4]).sum(axis=0) / c[:, 3].sum()
                w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
                w = w / w.sum()
            weights[b] = w
        elif b > 1 and seen[:b].any():
            weights[b] = weights[b - 1]
    return weights


def _held_out_cells(joined: DataFrame, kept_n: int) -> np.ndarray:
    """The bounded table of held-out tokens: (bucket, pair step, word step, tokens)."""
    def steps(p):
        return np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-30)) * GRID), -1).astype(np.int64)

    def cells(batches):
        for pdf in batches:
            for held, payload, answers in zip(pdf["held_out"], pdf["payload"], pdf["answers"]):
                got = [(a["reducer"], a["total"], a["gone"]) for a in answers]
                n, total, gone = _tokens_with_counts(payload, held, got)
                use = np.repeat(~np.array(held, bool), n)
                pair, ctx, uni = [(t - g)[use] for t, g in zip(total, gone)]
                f2, f1 = _estimates(pair, ctx, uni, kept_n)
                cell, k = np.unique(context_bucket(ctx) << 32 | steps(f2) + 1 << 16 | steps(f1) + 1, return_counts=True)
                yield pd.DataFrame({"b": cell >> 32, "s2": (cell >> 16 & 0xFFFF) - 1, "s1": (cell & 0xFFFF) - 1, "k": k})

    rows = joined.where("deleted").mapInPandas(cells, "b int, s2 int, s1 int, k long") \
        .groupBy("b", "s2", "s1").agg(F.sum("k").alias("k")).collect()
    return np.array([tuple(r) for r in rows], float).reshape(-1, 4)


def score(docs: DataFrame, blocks_per_reducer: int = 5) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training text is that of rows whose crc32(doc_id) mod 7 is not 2. Null
    texts are empty and have the end token alone; a null doc_id counts as the
    empty text in the fold; repeated rows count and are scored each; without
    training text every count is 0. Extra columns are ignored.
    """
    spark = docs.sparkSession
    blocks = make_blocks(docs)
    n_blocks = blocks.count()
    reducers = max(32, -(-n_blocks // blocks_per_reducer))
    with batch_rows(spark, 2):                       # block rows are some MB each
        answers = written(_answers(_requests(blocks, reducers)), "answers", codec="none")
        stats = answers.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "kept_n", "kept_v")]).first()
        n_all, vocabulary = stats["n"], stats["v"]
        back = answers.where("block <> -1").groupBy("block").agg(
            F.collect_list(F.struct("reducer", "total", "gone")).alias("answers"))      # a block's own keys
        joined = blocks.join(back, "block")
        weights = learn_weights(_held_out_cells(joined, stats["kept_n"]), stats["kept_v"])

        def run(batches):
            for pdf in batches:
                for ids, held, payload, got in zip(pdf["doc_ids"], pdf["held_out"], pdf["payload"], pdf["answers"]):
                    got = [(a["reducer"], a["total"]) for a in got]
                    n, (pair, ctx, uni) = _tokens_with_counts(payload, held, got)
                    f2, f1 = _estimates(pair, ctx, uni, n_all)
                    w = weights[context_bucket(ctx)]
                    p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (vocabulary + 1)
                    at = np.cumsum(n) - n
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"),
                        "held_out": list(held), "n_tokens": n, "n_known": np.add.reduceat((uni > 0).astype(np.int64), at),
                        "train_tokens": n_all,
                        "base_score": np.add.reduceat(np.log10((uni + 1) / (n_all + vocabulary + 1)), at),
                        "score": np.add.reduceat(np.log10(p), at)})

        return written(joined.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                               "train_tokens long, base_score double, score double"), "scores")


def op3_query(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"))
