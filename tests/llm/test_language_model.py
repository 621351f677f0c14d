"""op3: words, n-gram counts and the work a token costs."""

import collections
import random
import re
import sys
import zlib

import numpy as np
import pandas as pd

from dpframe.llm import language_model

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class Plan:
    """Stands for a table: gives back the function that would run over it."""

    def select(self, *columns):
        return self

    def mapInPandas(self, function, schema):
        return function


def payload(texts):
    return zlib.compress(np.array([len(t) for t in texts], "<u4").tobytes() + b"".join(texts))


def test_tokens_beyond_any_memory_cost_no_python_call_each():
    words = [f"w{i:x}".encode() for i in range(320_000)]
    texts = [b" ".join(words), b" ".join(reversed(words))]
    ask = language_model._requests(Plan(), 32)
    block = pd.DataFrame({"block": [1], "deleted": [False], "held_out": [[False] * 2], "payload": [payload(texts)]})
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        rows = list(ask([block]))
    finally:
        sys.setprofile(None)
    counts = np.concatenate([language_model._from_numbers(c) for r in rows for c in r["counts"]])
    assert counts.sum() == 2 * 2 * 320_001 + 2 and len(counts) == 320_000 + 2 + 2 * 319_999 + 4
    assert calls["call"] + calls["c_call"] < 64_000


def test_words_are_those_of_the_rule():
    rnd = random.Random(0)
    odd = [b"a", b"A", b"a\0", b"a\0\0", b"\0", b"\x1c", b"\x1f", "\x85".encode(), " É".encode(), "é".encode(), b"x" * 64, b"x" * 65,
           b"X" * 65, b"x" * 72, b"y" * 5000, b"12345678", b"123456789", b"123456789abcdef0", "漢字".encode() * 40]
    odd += [bytes(rnd.choices(b"ab", k=n)) for n in range(1, 130) for _ in range(4)]
    texts = [b"", b" \t\n", b"end"] + [b"".join(w + rnd.choice([b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" \n "])
                                        for w in rnd.choices(odd, k=rnd.randrange(60))) + rnd.choice(odd) for _ in range(200)]
    seen = {}
    for part in (texts, texts[::-1], texts[:1], texts[5:6]):
        code, single, n = language_model._words(part)
        plain = [WORDS.findall(t.translate(language_model.LOWER)) + [None] for t in part]
        assert n.tolist() == [len(p) for p in plain] and len(code) == n.sum()
        for word, k in zip((w for p in plain for w in p), single[code].tolist()):
            assert seen.setdefault(word, k) == k
    assert len(set(seen.values())) == len(seen)


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000, 100_000):
        keys = np.sort(rng.integers(0, 2 ** 64 - 1, n, np.uint64, endpoint=True))
        assert (language_model._unpack(language_model._pack(keys)) == keys).all()
    ends = np.array([0, 0, 1, 1, 2 ** 63, 2 ** 64 - 1], np.uint64)
    assert (language_model._unpack(language_model._pack(ends)) == ends).all()


def test_counts_of_pairs_contexts_and_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    blocks = language_model.make_blocks(docs)
    rows = blocks.collect()
    every, gone = [[collections.Counter() for _ in range(3)] for _ in range(2)]       # of pairs, contexts and words
    plain = []
    for b in rows:
        plain.append([])
        for text, held in zip(language_model._texts(b["payload"], len(b["held_out"])), b["held_out"]):
            words = WORDS.findall(text.translate(language_model.LOWER)) + [b" end"]
            two = list(zip([b" start"] + words, words))
            plain[-1] += two
            for pairs, contexts, uni in ([] if held else [every, gone] if b["deleted"] else [every]):
                pairs.update(two)
                contexts.update([b" start", *words])
                uni.update(words)
    for reducers in (1, 7, 600):
        got = collections.defaultdict(list)
        for a in language_model._answers(language_model._requests(blocks, reducers)).where("block <> -1").collect():
            got[a["block"]].append((a["reducer"], a["total"], *([] if a["gone"] is None else [a["gone"]])))
        for b, two in zip(rows, plain):
            _, *kinds = language_model._tokens_with_counts(b["payload"], b["held_out"], got[b["block"]])
            assert len(kinds) == 1 + b["deleted"]
            for counts, (pairs, contexts, uni) in zip(kinds, (every, gone)):
                assert [c.tolist() for c in counts] == [[pairs[t] for t in two], [contexts[v] for v, _ in two], [uni[w] for _, w in two]]
