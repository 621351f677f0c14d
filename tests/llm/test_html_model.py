"""The CRF of the page extraction against enumeration, its sample, and corpora without article markup."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from dpframe.llm import html_extract as hx

PAGES = "page_id long, url string, html string"


def _score(model, blocks, labels):
    e = sum(model.w[model.index[f], k] for feats, k in zip(blocks, labels) for f in feats if f in model.index)
    return e + sum(model.trans[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_and_likelihood_by_enumeration():
    rng = random.Random(3)
    pages = []
    for _ in range(30):
        n = rng.randint(1, 7)
        y = [rng.randint(0, 1) for _ in range(n)]
        pages.append(([rng.sample("abcdef", 2) + (["x"] if k and rng.random() < 0.7 else []) for k in y], y))
    model = hx.ChainModel().fit(pages)

    def objective(m):
        total, n = 0.0, sum(len(y) for _, y in pages)
        for blocks, y in pages:
            every = [_score(m, blocks, c) for c in itertools.product((0, 1), repeat=len(y))]
            total += _score(m, blocks, y) - np.logaddexp.reduce(every)
        theta = np.concatenate([m.w.ravel(), m.trans.ravel()])
        return total / n - hx.L2 / 2 * (theta @ theta)

    for blocks, y in pages:
        best = max(_score(model, blocks, c) for c in itertools.product((0, 1), repeat=len(y)))
        assert abs(_score(model, blocks, model.decode(blocks)) - best) < 1e-9
    # the fit ends near the top of the enumerated likelihood: no direction gains more than a little
    top = objective(model)
    blank = hx.ChainModel()
    blank.index, blank.w = model.index, np.zeros_like(model.w)
    assert top > objective(blank)
    for a in (model.w, model.trans):
        for i in np.ndindex(a.shape):
            for d in (0.05, -0.05):
                a[i] += d
                assert objective(model) < top + 1e-3
                a[i] -= d


def _plain(i):
    return (f"<html><head><title>Site</title></head><body><div class=menu><a href=/>Home</a> <a href=/n>News {i}</a></div>"
            f"<div><h2>Story number {i}</h2><p>The first part of story {i} says something at length.</p>"
            f"<p>Its second part, for {i} readers, ends here.</p></div><div class=footer>All rights reserved {i}</div></body></html>")


def test_pages_of_a_corpus_without_article_markup_give_their_text(spark):
    pages = spark.createDataFrame([(i, None, _plain(i)) for i in range(50)] + [(50, None, None), (51, None, "")], PAGES)
    got = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    for i in range(50):
        assert got[i] == (f"Story number {i}\nThe first part of story {i} says something at length.\n"
                          f"Its second part, for {i} readers, ends here.")
    assert got[50] == got[51] == ""
    blank = pages.where("page_id >= 50")
    assert [r["text"] for r in hx.extract(blank).collect()] == ["", ""]


def test_sample_is_of_different_pages_by_hash_and_orders_only_hashes(spark):
    rows = [(i, None, f"<article>{i}</article>") for i in range(40)] + [(1000, None, "<article>copy</article>")] * 60
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    order = [r["html"] for r in pages.distinct().orderBy(F.xxhash64("page_id", "html")).collect()]
    for n in (1, 7, 41, 60):
        assert hx.least_pages(pages, n) == order[:n]
    # article elements in comments only: the pages behind them are still found
    hidden = [(i, None, "<!-- <article> --><p>x</p>") for i in range(100, 130)]
    mixed = spark.createDataFrame(rows[:3] + hidden, PAGES)
    assert len(hx.labelled_pages(mixed, 3)) == 3 and len(hx.labelled_pages(mixed, 2)) == 2


def test_references_end_at_tags():
    text = lambda s: [b.text for b in hx.leaf_blocks(s)]
    assert text("<p>&l<b>t;</b> &lt;b&gt; a&nbsp;b &#65;</p>") == ["&lt; <b> a b A"]
    assert text("<p>x &amp<i></i>; y</p>") == ["x &; y"]
