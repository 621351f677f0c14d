"""Line dedup gives the same rows however documents are told apart."""

from pyspark.sql import functions as F

from dpframe.llm import line_dedup

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.select("row.doc_id", "clean", "n_lines", "n_dropped", "emptied").collect()), key=repr)


def test_unique_ids_and_pairs_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = line_dedup.document(docs)
    assert "doc_id" == ids._jc.toString()
    by_id = _rows(line_dedup.clean(docs))
    monkeypatch.setattr(line_dedup, "document", lambda d: F.struct("doc_id", "key"))
    assert _rows(line_dedup.clean(docs)) == by_id
    assert any(r[3] for r in by_id)


def test_shared_and_null_ids_need_the_text(spark):
    row = "doc_id long, text string"
    assert "struct" in line_dedup.document(spark.createDataFrame([(1, "a"), (1, "b")], row))._jc.toString()
    assert "struct" in line_dedup.document(spark.createDataFrame([(1, "a"), (None, "b")], row))._jc.toString()
    assert "struct" not in line_dedup.document(spark.createDataFrame([], row))._jc.toString()
    line = "eight words or more stand in this shared line of text"
    docs = spark.createDataFrame([(1, line + "\nown words of one"), (1, line + "\nother words here"), (2, line + "\nthe third has these")], row)
    got = _rows(line_dedup.clean(docs))
    assert sum(r[3] for r in got) == 2 and sum(line in r[1] for r in got) == 1


def test_cutting_equals_a_word_by_word_replay():
    import random
    rng = random.Random(8)
    blank = " \t\r\x0b\x0c"
    for _ in range(3000):
        lines = ["".join(rng.choice(["word", "é x", "\x1c", "a", " ", "  ", "\t", "\r", "\x0c"]) for _ in range(rng.randint(0, 8)))
                 for _ in range(rng.randint(1, 6))]
        words = [line_dedup.WORD.findall(x) for x in lines]
        total = sum(map(len, words))
        drop = {i for i in range(len(lines)) if rng.random() < 0.2}
        spans = [sorted(rng.sample(range(total + 1), 2)) for _ in range(rng.randint(0, 4))] if total else []
        covered = {i for a, b in spans for i in range(a, b)}
        want, gone, at = [], 0, 0
        for i, (line, ws) in enumerate(zip(lines, words)):
            hit = [at + k in covered for k in range(len(ws))]
            at += len(ws)
            if i in drop or (ws and all(hit)):
                gone += 1
                continue
            if any(hit):
                starts = [m.start() for m in line_dedup.WORD.finditer(line)] + [len(line)]
                left = "".join(line[a:b] for a, b, h in zip(starts, starts[1:], hit) if not h)
                line = line[:starts[0]] + (left.rstrip(blank) if hit[-1] else left)
            want.append(line)
        assert line_dedup.without("\n".join(lines), drop, [a << 32 | b for a, b in spans]) == ("\n".join(want), gone)
