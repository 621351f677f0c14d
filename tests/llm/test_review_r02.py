"""Cases of the second review: what the operators once left undone."""

import random

import numpy as np

from dpframe.llm import decontaminate, html_extract, language_model, line_dedup, quality

DOC = "doc_id long, text string"


def text_of(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def shared(a, b, n):
    a, b = a.split(), b.split()
    return {tuple(a[i:i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}


def test_op7_passages_inside_longer_lines(spark):
    passage = text_of(0, 120)
    words = passage.split()
    one_more = " ".join(words[:60] + ["inserted"] + words[60:])
    wrapped = "\n".join(" ".join(words[i:i + 7]) for i in range(0, 120, 7))
    rows = [(1, f"{text_of(1, 30)} {passage} {text_of(2, 30)}"), (2, f"{text_of(3, 47)} {passage} {text_of(4, 20)}"),
            (3, f"{text_of(5, 33)} {one_more}\n{text_of(6, 30)}"), (4, f"{text_of(7, 40)}\n{wrapped}\n{text_of(8, 40)}"),
            (5, text_of(9, 300))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(spark.createDataFrame(rows, DOC)).collect()}
    assert got[1] == rows[0][1] and got[5] == rows[4][1]
    for i, own in ((2, (3, 47, 4, 20)), (3, (5, 33, 6, 30)), (4, (7, 40, 8, 40))):
        assert not shared(got[i], passage, 51)
        assert text_of(*own[:2]) in got[i] and text_of(*own[2:]) in got[i]


def test_op7_keeps_documents_of_short_lines(spark):
    license_line = "permission is granted to copy and use this work under the license terms"
    verse = "\n".join(text_of(100 + i, 5) for i in range(40))
    dense = "漢字" * 200
    rows = [(1, f"{license_line}\n{text_of(1, 30)}"), (2, f"{license_line}\n{verse}"), (3, f"{dense}\n{license_line}"),
            (4, f" \n{license_line}\n\t")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: rows[0][1], 2: verse, 3: dense}


def test_op4_sample_counts_labelled_pages(spark):
    plain = [(i, "u", f"<div><p>Plain page {i}, text of its own.</p></div><!-- <article> --><main></main>") for i in range(400)]
    named = [(1000 + i, "u", f"<nav><a>Home</a></nav><article><h1>Title {i}</h1><p>{text_of(i, 30)}.</p></article><footer>Us</footer>")
             for i in range(4)]
    pages = spark.createDataFrame(plain + named, "page_id long, url string, html string")
    model = html_extract.train(pages, sample=4)
    assert [html_extract.extract_text(h, model) for _, _, h in named] == [f"Title {i}\n{text_of(i, 30)}." for i in range(4)]


def test_op4_keeps_formulas_fallback_text_and_captions(spark):
    model = html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A title</h1>"
            "<p>Here <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds <svg><path d=x /></svg>for all.</p>"
            "<figure><svg><text>Mass in kilograms.</text></svg><figcaption>Figure one shows the mass.</figcaption></figure>"
            "<object data=x>The table lists ten cities.</object><noscript><p>The map shows all of the rivers.</p></noscript>"
            "<video>The film shows the river.</video><form><textarea>Write here</textarea></form><p>Last paragraph.</p></article>"
            "<footer>&copy; us</footer><script>var x='<p>no</p>'</script></body></html>")
    assert html_extract.extract_text(page, model).split("\n") == [
        "A title", "Here E=m holds for all.", "Mass in kilograms.", "Figure one shows the mass.", "The table lists ten cities.",
        "The map shows all of the rivers.", "The film shows the river.", "Last paragraph."]


def test_op3_totals_beyond_32_bits(spark):
    keys, most = np.array([6, 8], np.uint64), (1 << 53) + 1
    rows = [(b, False, 0, language_model._pack(keys), language_model._numbers(np.array([n, 1], np.int64)))
            for b, n in ((1, most), (2, (1 << 32) - 1))]
    asked = spark.createDataFrame(rows, "block long, deleted boolean, reducer int, keys binary, counts binary")
    got = {r["block"]: r for r in language_model._answers(asked).collect()}
    for b in (1, 2):
        assert language_model._from_numbers(bytes(got[b]["total"])).tolist() == [most + (1 << 32) - 1, 2]
    assert got[-1]["n"] == most + (1 << 32) + 1


def test_op5_repeated_lines_count_against_lines(spark):
    def doc(i, repeated):
        lines = [text_of(1000 * i + k, 12) for k in range(20 - repeated)]
        return "\n".join(lines + lines[:1] * repeated)

    rows = [(i, "en", "a", doc(i, 0)) for i in range(250)] + [(1000, "en", "a", doc(1000, 9)), (1001, "en", "a", doc(1001, 4))]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
           .withColumnRenamed("n_repeat_words", "r").collect()}
    limits = quality.thresholds(quality._with_keys(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
                                .select("_lang", "_source", quality.measures(quality.F.col("text")).alias("_m"))
                                .select("_lang", "_source", "_m.*")).first()
    assert 0.25 <= limits["max_dup_line_ratio"] < 9 / 20
    ratio = quality._ratios()["dup_line_ratio"]
    one = spark.createDataFrame([(240, 9, 20, 0, 0, 1000)], "n_words long, n_dup_lines long, n_lines long, n_symbols long, "
                                                           "n_repeat_words long, word_chars long")
    assert one.select(ratio.alias("x")).first()["x"] == 9 / 20
    assert all(got[i]["kept"] for i in range(250)) and not got[1000]["kept"]


def test_op8_windows_of_many_equal_items_are_broadcast_once(spark):
    passage = text_of(0, 20)
    bench = spark.createDataFrame([(i, passage if i % 2 else passage.upper() + "!") for i in range(60)] + [(100, text_of(1, 15))],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{text_of(2, 9)} {passage}"), (2, text_of(3, 40)), (3, f"{passage} {text_of(1, 15)}")], DOC)
    windows = decontaminate.benchmark_windows(bench)
    assert windows.count() == 8 + 3
    assert decontaminate.hits(docs, windows).count() == 8 + 8 + 3
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (20, 60), 2: (0, 0), 3: (35, 61)}
