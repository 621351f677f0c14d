"""Keyed access to the token store, its id width, and the encoder's pieces."""

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import WhitespaceSplit

from dpframe.llm import token_store as ts
from dpframe.llm import tokens
from dpframe.llm.common import new_folder

SF = "/root/testdata/sf0.001"


def test_lookup_finds_every_key_and_reads_few_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = ts.write_store(docs, new_folder(spark, "t"), shard_rows=32)
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    keys = spark.createDataFrame([(i,) for i in ids + ids[:5] + [-5, 10 ** 12]], "doc_id long")
    found = ts.lookup(m, keys)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: np.frombuffer(b, "<u4").tolist() for i, b in zip(ids, tokens.encoder().encode([text[i] for i in ids]))}
    rows = found.collect()
    assert len(rows) == len(ids) and {r["doc_id"]: r["ids"] for r in rows} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # one key loads no section
    row = m.where("docs > 0").first()
    shard = ts.ShardReader(row["path"])
    first, n = shard.rows_of(np.array([row["min_key"]]))
    assert n.tolist() == [1] and shard.ids(int(first[0])).tolist() == want[row["min_key"]]
    assert all(getattr(shard, s).array is None for s in ("bits", "ranks", "fingerprint", "first_row", "rows", "key", "row_start"))


def test_lookup_in_slices_of_shards(spark, monkeypatch):
    rows = [(i // 3, f"text number {i}") for i in range(90)]        # keys of three rows, which may span shards
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = ts.write_store(docs, new_folder(spark, "t"), shard_rows=4)
    keys = spark.range(-3, 40).withColumnRenamed("id", "doc_id")
    whole = sorted((r["doc_id"], tuple(r["ids"])) for r in ts.lookup(m, keys).collect())
    assert len(whole) == 90
    monkeypatch.setattr(ts, "LOOKUP_SHARDS", 5)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in ts.lookup(m, keys).collect()) == whole
    empty = ts.write_store(docs.limit(0), new_folder(spark, "t"))
    assert ts.lookup(empty, keys).count() == 0


def test_width_follows_the_tokenizer(spark, tmp_path):
    tok = Tokenizer(WordLevel({"a": 0, "b": 70_000, "[unk]": 2}, unk_token="[unk]"))
    tok.pre_tokenizer = WhitespaceSplit()
    path = str(tmp_path / "wide.json")
    tok.save(path)
    assert tokens.id_width(path) == 4 and tokens.id_width() == 2
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "B b\tc")], "doc_id long, text string")
    m = ts.write_store(docs, new_folder(spark, "t"), path)
    found = {r["doc_id"]: r["ids"] for r in ts.lookup(m, docs.select("doc_id")).collect()}
    assert found == {1: [0, 70_000, 1], 2: [1], 3: [2, 70_000, 2, 1]}
    with pytest.raises(ValueError):
        ts.write_shard(str(tmp_path / "out"), 0, [(1, np.array([70_000], "<u4").tobytes())], 2)


def test_other_tokenizers_get_whole_texts():
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist()[:60] + ["  two  blanks ", "", None]
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = tokens.WordEncoder(path).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [
        tok.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID] for t in texts]


def test_pieces_side_by_side_are_as_alone():
    rng = np.random.default_rng(4)
    parts = ["<", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext", "'s", "'", "é", "é", "́", "ß", "İ", "中", "a", "B",
             "1", ".", "$", " ", "​", "…", "\x00", "﻿", "＜|endoftext|＞"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(rng.integers(1, 40))) for _ in range(3000)]
    enc = tokens.WordEncoder()
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        whole = [e.ids + [tokens.END_ID] for e in enc.tok.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)] == whole
