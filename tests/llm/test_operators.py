"""Corpus operators against plain versions, on sf0.001 and on odd rows."""

import collections
import html
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dpframe.llm import (decontaminate, html_extract, language, language_model, line_dedup, near_dedup, packing, quality, queries,
                         token_store, tokens, url_rules)
from odd_rows import ODD

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d.doc_id, d.text))


def ids_of(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


# ---------------------------------------------------------------- op1

def bag(text):
    w = NORMAL.findall((text or "").translate(LOWER))
    return collections.Counter(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) for i, t in rows}
    index = collections.defaultdict(list)
    for i, b in bags.items():
        for k in b:
            index[k].append(i)
    pairs = {(a, b) for v in index.values() for n, a in enumerate(v) for b in v[n + 1:] if a != b}
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in parent}


def test_near_duplicates_equal_all_pairs(docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs)[0].collect()}
    assert got == classes(list(texts.items()))


def test_near_misses_in_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(110)]
    rows = []
    for i in range(160):
        w = list(base)
        for p in rng.choice(110, rng.integers(1, 8), replace=False):
            w[p] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df)[0].collect()}
    assert got == classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    w1, w2 = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    sig = near_dedup.bag_minhash(np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([w1, w2]), 2, m=4096)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_duplicates_odd_rows(odd, none):
    got = [tuple(r) for r in near_dedup.near_duplicates(odd)[0].select("doc_id", "class_id").collect()]
    assert len(got) == len(ODD)
    by = dict((a, b) for a, b in got if a is not None)
    assert by[1] == by[2] == by[3] == 1 and by[7] == by[8] == 7 and by[4] == 4 and by[9] == 9
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (2, 3, 8)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert near_dedup.near_duplicates(none)[0].count() == 0 and near_dedup.keep_one(none).count() == 0


# ---------------------------------------------------------------- op2

def test_url_rules(spark):
    urls = [None, "no scheme", "http://WWW.Example.com/en/a?x", "http://example.com/en/", "http://a.example.com/de/", "http://xexample.com/en",
            "http://com", "ftp://n.net/es/1#f", "a://b://c.net/fr/", "http:///p", "http://e.org/\n/x?q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[3] == ("example.com", "/en/", "example.com/en/", "block") and got[4][2:] == ("com/", "allow")
    assert got[5][2:] == ("com/", "allow") and got[6] == ("com", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8] == ("b:", "//c.net/fr/", None, "allow") and got[9][:2] == ("", "/p")
    assert got[10][1] == "/\n/x" and url_rules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_match_brute_force(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}-h{i % 5}.e.org/{'win' if i % 2 else 'news'}/") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 2 == 1) for i in range(90)], "page_id long, block boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, rules=[("zz", "/", "block")]).collect()}
    tokens_of = {r["page_id"]: r["t"] for r in pages.select("page_id", url_rules.url_tokens(
        *url_rules.host_path(F.col("url")), F.col("url")).alias("t")).collect()}
    block = {r["page_id"]: r["block"] for r in labels.collect()}
    have, bad = collections.Counter(), collections.Counter()
    for i, b in block.items():
        for n in range(1, url_rules.MAX_TOKENS + 1):
            for s in itertools.combinations(sorted(tokens_of[i]), n):
                have[s] += 1
                bad[s] += b
    share = sum(block.values()) / len(block)
    rules = [set(s) for s, k in bad.items() if k >= url_rules.MIN_COUNT and k / have[s] >= url_rules.MIN_CONFIDENCE
             and k / have[s] / share >= url_rules.MIN_LIFT]
    assert rules and got == {i: "block" if any(r <= set(tokens_of[i]) for r in rules) else "allow" for i, _ in rows}


# ---------------------------------------------------------------- op3

def test_language_model_counts_and_normalisation(docs, texts, odd, none):
    toks = {i: WORDS.findall(t.translate(LOWER)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = collections.Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = c.total(), len(c)
    rows = language_model.score(docs).collect()
    assert len(rows) == len(toks)
    for r in rows:
        t = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(t), n)
        assert r["n_known"] == sum(c[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    again = {r["doc_id"]: r["score"] for r in language_model.score(docs.repartition(3)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in rows)
    got = language_model.score(odd).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert all(math.isfinite(r["score"]) for r in got) and language_model.score(none).count() == 0


def test_expectation_maximisation_beats_other_weights():
    rng = np.random.default_rng(0)
    cells = np.column_stack([np.full(50, 3), rng.integers(0, 100, 50), rng.integers(50, 200, 50), rng.integers(1, 9, 50)]).astype(float)
    w = language_model.learn_weights(cells, 1000)[3]
    p = np.stack([2.0 ** (-cells[:, 1] / 16), 2.0 ** (-cells[:, 2] / 16), np.full(50, 1 / 1001)], 1)

    def gain(x):
        return (np.log(p @ x) * cells[:, 3]).sum()

    assert w.sum() == pytest.approx(1) and all(gain(w) >= gain(np.array(x)) - 1e-3 for x in rng.dirichlet([1, 1, 1], 50))


# ---------------------------------------------------------------- op4

def test_article_text_of_all_pages(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.QUERIES["op4_html_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for i, x in zip(pages.page_id, pages.html):
        a = x[x.index("<article>") + 9:]
        a = a.split("</article>")[0] if "</article>" in a else a.split("<footer>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", a)]
        want = "\n".join(p for p in parts if p)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_other_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.train(pages)
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=x>Home</a></nav>"
            "<div class='notice'><p>We use cookies.</p></div><main><h1>A &amp; B</h1><p>First\n  paragraph here.<p>Second one.</p>"
            "<aside><p>See also that.</p></aside><form><p>Send <button>Go</button></p></form><p>Third.</p></main>"
            "<section class='comments'><p>Nice read, thanks.</p></section><div class=sidebar><ul><li>Other</ul></div>"
            "<footer>&copy; us</footer><script>var x='<p>no</p>'</script></body></html>")
    assert html_extract.extract_text(page, model) == "A & B\nFirst paragraph here.\nSecond one.\nThird."
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p"), (3, "u", '<a b="<p>'), (3, "u", "\x00<<>>")],
                                "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_extract.extract(odd, model).orderBy("n_chars").collect()][:3] == [0, 0, 0]
    assert html_extract.extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- op5

def plain_measure(text):
    words = WORDS.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    win = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    rep = {i + j for i in range(len(words) - 2) if win[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep)


def test_quality_measures(texts, odd, none):
    for t in [*texts.values(), *(r[1] for r in ODD), "a b c a b c a b\na b\n\na b"]:
        assert quality.measure(t) == plain_measure(t)
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(none).count() == 0 and quality.filter_documents(none).count() == 0


def test_quality_keeps_good_and_rejects_junk(spark):
    lab = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").quality
    got = [r for r in queries.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in lab.index]
    good = [r for r in got if lab[r["doc_id"]] == 1 and not r["base_failed"]]
    junk = [r for r in got if lab[r["doc_id"]] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97 and np.mean([r["kept"] for r in junk]) < 0.1


# ---------------------------------------------------------------- op6, op10

def best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(size - x)
    return len(bins), sorted(bins)


def test_plan_equals_plain_best_fit():
    rng = np.random.default_rng(3)
    for size in (7, 50, 300):
        lengths = rng.integers(1, size + 1, 400).tolist()
        plan, n = packing.plan_best_fit(collections.Counter(lengths), size)
        used = collections.Counter()
        for length, _, count, per, first, offset in plan:
            for r in range(count):
                assert used[first + r // per] == offset + r % per * length
                used[first + r // per] += length
        assert (n, sorted(size - u for u in used.values())) == best_fit(lengths, size)


def test_packing_places(odd, none, docs, texts):
    rows = packing.pack(odd, ids=True).collect()
    want = collections.Counter()
    for r in ODD:
        ids = ids_of(r[1])
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(r[0], k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    for df in (odd, docs):
        seqs = collections.defaultdict(list)
        rows = packing.pack(df).collect()
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(seqs) == best_fit([r["length"] for r in rows], 4096)[0]
    assert packing.pack(none).count() == 0


def test_encoder_equals_whole_text(texts):
    odd = [r[1] for r in ODD] + ["H\u0331 A\u0308. <|STARTOFTEXT|> don't, 3.5! x\xa0y\x85z\u3000.\x1c", "I\u0307 \u0391\u03a3, ab***, c?! \t\r\x0b\x0c"]
    all_texts = odd + list(texts.values())
    for small in (False, True):
        enc = tokens.WordEncoder(max_pieces=50) if small else tokens.encoder()
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(all_texts)] == [ids_of(t).tolist() for t in all_texts]


def test_token_store_round_trip(spark, docs, texts, odd, none):
    from dpframe.llm.common import new_folder
    rows = token_store.read_store(token_store.write_store(docs, new_folder(spark, "t"), shard_rows=64)).orderBy("start").collect()
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = ids_of(texts[i])
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    m = token_store.write_store(odd, new_folder(spark, "t"), shard_rows=4)
    got = token_store.read_store(m).collect()
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == collections.Counter(
        (r[0], zlib.crc32(ids_of(r[1]).tobytes())) for r in ODD)
    keys = spark.createDataFrame([(1,), (3,), (777,), (None,)], "doc_id long")
    found = token_store.lookup(m, keys).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 3, 3]
    assert next(r for r in found if r["doc_id"] == 1)["ids"] == ids_of(ODD[0][1]).tolist()
    assert token_store.read_store(token_store.write_store(none, new_folder(spark, "t"))).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 5000)
    mph = token_store.PerfectHash.build(keys)
    assert sorted(mph.slots(np.unique(keys))) == list(range(len(np.unique(keys))))


# ---------------------------------------------------------------- op7

def test_lines_that_recur(spark, odd, none):
    passage = "This long passage of many words stands in several documents and it should stay in only one of them"
    var = "user 17 logged in from 10.0.0.1 at 12:05 with the long session key of the day"
    rows = [(1, f"alpha beta\n{passage}\nown text of the first one here stands on its own line"),
            (2, f"gamma delta of another kind that no one else would ever write down\n{passage}"), (3, passage),
            (4, var + "\nsome line of its own that is long enough to stay here"),
            (5, var.replace("17", "99").replace("12:05", "13:44") + "\nyet another line that stands alone in this very document"),
            (6, passage.replace("several documents", "various papers") + "\nand the sixth has a closing line of its own kind too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated(df).collect()}
    assert got[1] == rows[0][1] and got[4] == rows[3][1] and 3 not in got
    assert got[2] == rows[1][1].split("\n")[0] and got[5] == rows[4][1].split("\n")[1] and got[6] == rows[5][1].split("\n")[1]
    out = line_dedup.drop_repeated(odd)
    assert out.columns == odd.columns and line_dedup.drop_repeated(none).count() == 0
    assert out.where("doc_id IN (4, 5, 6, 7, 8, 9, 10, 11)").count() == 8


# ---------------------------------------------------------------- op8

def test_contamination_against_duckdb(spark, odd, none):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "Short, item"), (3, None), (None, "***"), (1, passage)], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame(
        [(20, f"before {passage.upper()} after", "en", "s", 1, "r", "k", "n"), (21, "a short ITEM b", "en", "s", 1, "r", "k", "n"),
         (22, "x " * 400 + passage[:60], "en", "s", 1, "r", "k", "n")], odd.schema))
    got = decontaminate.contamination(docs, bench).select(*decontaminate.RESULT).collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    want = con.execute(decontaminate.ORACLE).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["doc_id"] for r in got if r["contaminated"]} == {20, 21}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[20] == "before after" and cut[21] == "a b" and cut[1] == ODD[0][1]
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


# ---------------------------------------------------------------- op9

def test_language_held_out(spark, docs, odd, none):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    rows = language.identify(odd).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6, 7, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(none).count() == 0
    assert language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 7, 12):
        code = language.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
