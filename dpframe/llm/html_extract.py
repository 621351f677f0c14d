"""Main-text extraction with a linear-chain CRF over DOM leaf blocks (op4).

A page is cut into leaf blocks: runs of text without a block-level boundary,
each with its open elements. Features are the ancestor tags, the words of
ancestor class, id and role attributes, and text features (length, link
share, punctuation). A two-label linear-chain conditional random field is
trained on labelled pages and decoded by Viterbi.

Labelled pages come from the corpus itself: up to ``TRAIN_PAGES`` pages
(smallest hash of page_id and html) whose markup names its article, labelled
by that markup, and about as many rebuilt from them in other layouts with
known menus, notices, adverts, forms and comments around and inside the article
(each of at most ``TRAIN_BLOCKS`` blocks of its article). Where no page names its
article, the sample is of all pages, and what neither markup nor links mark as
something else is the article. The fit is therefore on a bounded sample; the
decoding reads every page whole.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import read

TRAIN_PAGES = 300
TRAIN_BLOCKS = 40
EPOCHS, RATE, L2 = 80, 0.15, 1e-3

# HTML element classes.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search
section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Text in these is a block of its own; without text they do not part what stands around them.
FALLBACK = frozenset("noscript template iframe svg object canvas audio video".split())
FOREIGN = frozenset("svg math".split())
SPACED = frozenset("br td th img wbr".split())
#: Opening the key closes an open element of these kinds (up to the boundary elements).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table select body html article section div main".split())
# Markup that says what a block is.
ARTICLE = frozenset("article main".split())
OTHER = frozenset("nav header footer aside form button select option textarea dialog menu title head".split())
OTHER_WORDS = frozenset("""ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie
cookies discussion disqus footer form header login menu nav navbar navigation newsletter notice popup promo related
replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
                 r"""([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)(?:>|\Z|["'][^>]*(?:>|\Z))""", re.S)
ATTR = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Block:
    __slots__ = ("text", "tags", "parent", "words", "linked", "chars")

    def __init__(self, text, stack, linked, chars):
        self.text = text
        self.tags = {t for t, _ in stack}
        self.parent = next((t for t, _ in reversed(stack) if t in BLOCK), "")
        self.words = set().union(*[w for _, w in stack]) if stack else set()
        self.linked, self.chars = linked, chars


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; blocks without visible text are left out."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, set]] = []
    parts: list[str] = []
    linked = 0
    waiting = None              # place of the outermost open fallback element that has had no text yet

    def flush():
        nonlocal linked, waiting
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[:waiting], linked, max(1, sum(map(len, parts)))))
            parts.clear()
            linked = 0
        waiting = None

    def add(s):
        nonlocal linked
        s = html.unescape(s)        # here, as no reference goes on behind a tag
        if s:
            if waiting is not None and not s.isspace():
                flush()
            parts.append(s)
            if any(t == "a" for t, _ in stack):
                linked += len(s)

    def close(names, stop=()):
        nonlocal waiting
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                # inline elements and fallback elements without text part nothing
                if any(t in BLOCK for t, _ in stack[i:]) or any(t in FALLBACK for t, _ in stack[i:waiting]):
                    flush()
                elif waiting is not None and i <= waiting:
                    waiting = None
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                flush()
            if any(t == name for t, _ in stack):
                close({name})
            continue
        if name in RAW:
            if not m.group(3).rstrip().endswith("/"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in SPACED:
            parts.append(" ")
        if name in BLOCK:
            flush()
            if name not in ("option", "button", "select"):
                close({"p"}, BOUNDARY)
            if name in CLOSES:
                close(CLOSES[name], BOUNDARY)
            if name[0] == "h" and name[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, BOUNDARY)
        attrs = m.group(3)
        if (name in FALLBACK or name in FOREIGN or any(t in FOREIGN for t, _ in stack)) and attrs.rstrip().endswith("/"):
            continue
        if name in FALLBACK and waiting is None:
            waiting = len(stack)
        if name not in VOID:
            words = {w.lower() for v in ATTR.findall(attrs) for w in WORD.findall("".join(v))} if "=" in attrs else set()
            stack.append((name, words))
    flush()
    return out


def features(b: Block) -> list[str]:
    """Feature names of a block."""
    words = b.text.count(" ") + 1
    share = b.linked / b.chars
    out = ["bias", "parent=" + b.parent, "len=%d" % min(words.bit_length(), 7),
           "link=%d" % (0 if share == 0 else 1 if share < 0.5 else 2),
           "end=" + ("stop" if b.text[-1] in ".!?;:\"'" else "open")]
    out += ["tag=" + t for t in b.tags]
    out += ["word=" + w for w in b.words]
    if b.tags & ARTICLE:
        out.append("article")
    if b.words & OTHER_WORDS:
        out.append("other word")
    if b.tags & OTHER:
        out.append("other tag")
    if "©" in b.text:
        out.append("copyright")
    return out


def markup_labels(blocks: list[Block]) -> list[int] | None:
    """1 for article text by markup; None when the page's markup names no article."""
    if not any(b.tags & ARTICLE for b in blocks):
        return None
    return [int(bool(b.tags & ARTICLE) and not b.tags & OTHER and not b.words & OTHER_WORDS) for b in blocks]


def negative_labels(blocks: list[Block]) -> list[int]:
    """1 for text that neither its markup nor its links mark as something else than an article."""
    return [int(not b.tags & OTHER and not b.words & OTHER_WORDS and 2 * b.linked < b.chars) for b in blocks]


# Layouts for the rebuilt training pages, as (tag, class) of containers.
CONTAINERS = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "story"),
              ("div", "entry-content"), ("div", "article-text")]
AROUND = [("nav", ""), ("div", "menu"), ("header", ""), ("div", "header"), ("aside", ""), ("div", "sidebar"),
          ("div", "notice"), ("div", "cookie-banner"), ("div", "ad"), ("div", "advert"), ("div", "promo"), ("form", ""),
          ("section", "comments"), ("div", "comment"), ("ol", "comment-list"), ("footer", ""), ("div", "footer"),
          ("div", "related"), ("div", "newsletter"), ("ul", "breadcrumb"), ("div", "share")]


def rebuilt(article: list[str], spare: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """A labelled page: the article's blocks in a layout of known parts filled with other text."""
    def part(tag, cls):
        inner = "".join(f"<{t}>{html.escape(rng.choice(spare))}</{t}>" for t in rng.choices(["p", "li", "a", "span", "div"], k=rng.randint(1, 3)))
        mark = f' class="{cls}"' if cls and rng.random() < 0.8 else f' id="{cls}"' if cls else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    tag, cls = rng.choice(CONTAINERS)
    parts = rng.sample(AROUND, 8)
    body = [f"<p>{html.escape(t)}</p>" for t in article]
    if body:
        body[0] = f"<h1>{html.escape(article[0])}</h1>"
    inside = [part(*p) for p in parts[:3]]
    for p in inside:
        body.insert(rng.randint(0, len(body)), p)
    page = "".join(part(*p) for p in parts[3:6]) + f'<{tag} class="{cls}">' + "".join(body) + f"</{tag}>" \
        + "".join(part(*p) for p in parts[6:])
    noise = {(t, c) for t, c in AROUND}
    noise_tags, noise_words = {t for t, c in noise if not c}, {w for _, c in noise for w in WORD.findall(c)}
    return [(b, int(not (b.tags & noise_tags) and not (b.words & noise_words))) for b in leaf_blocks(page)]


class ChainModel:
    """Two-label linear-chain CRF: feature weights (feature x label) and transitions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.trans = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]]) -> "ChainModel":
        """Maximise the regularised conditional log-likelihood by Adam, all pages at once."""
        pages = [p for p in pages if p[1]]
        if not pages:
            return self
        for feats, _ in pages:
            for block in feats:
                for f in block:
                    self.index.setdefault(f, len(self.index))
        n, longest = len(pages), max(len(y) for _, y in pages)
        slot = np.concatenate([i * longest + np.arange(len(y)) for i, (_, y) in enumerate(pages)])
        label = np.concatenate([y for _, y in pages])
        rows = np.repeat(slot, [len(b) for feats, _ in pages for b in feats])
        cols = np.array([self.index[f] for feats, _ in pages for b in feats for f in b])
        length = np.array([len(y) for _, y in pages])
        real = np.arange(longest)[None, :] < length[:, None]
        gold = np.zeros((n * longest, 2))
        gold[slot, label] = 1
        y = gold.reshape(n, longest, 2)
        pair_gold = np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])
        theta = np.zeros(2 * len(self.index) + 4)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        total = len(slot)
        for step in range(1, EPOCHS + 1):
            w, trans = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            e = np.stack([np.bincount(rows, weights=w[cols, k], minlength=n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, longest):
                fwd[:, t] = e[:, t] + np.logaddexp(fwd[:, t - 1, 0, None] + trans[0], fwd[:, t - 1, 1, None] + trans[1])
            for t in range(longest - 2, -1, -1):
                nxt = e[:, t + 1] + bwd[:, t + 1]
                back = np.logaddexp(nxt[:, 0, None] + trans[:, 0], nxt[:, 1, None] + trans[:, 1])
                bwd[:, t] = np.where(real[:, t + 1, None], back, 0.0)
            last = fwd[np.arange(n), length - 1]
            z = np.logaddexp(last[:, 0], last[:, 1])
            p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
            both = np.exp(fwd[:, :-1, :, None] + trans + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) \
                * real[:, 1:, None, None]
            diff = (y - p).reshape(-1, 2)
            g = np.concatenate([np.stack([np.bincount(cols, weights=diff[rows, k], minlength=len(self.index)) for k in (0, 1)], 1).ravel(),
                                (pair_gold - both.sum(axis=(0, 1))).ravel()]) / total - L2 * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta = theta + RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
        self.w, self.trans = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        return self

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi labels of a page."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.trans.tolist()
        index, w = self.index, self.w
        a = b = 0.0
        back = []
        for i, feats in enumerate(blocks):
            cols = [index[f] for f in feats if f in index]
            e0, e1 = w[cols].sum(axis=0).tolist() if cols else (0.0, 0.0)
            if i == 0:
                a, b = e0, e1
                continue
            from0, from1 = int(b + t10 > a + t00), int(b + t11 > a + t01)
            back.append((from0, from1))
            a, b = e0 + max(a + t00, b + t10), e1 + max(a + t01, b + t11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def least_pages(pages: DataFrame, n: int) -> list[str]:
    """html of up to ``n`` different pages, those of the smallest hashes of (page_id, html), in order of hash.

    Only hashes are ordered; then the pages of the chosen ones are fetched.
    """
    keyed = pages.select("html", F.xxhash64("page_id", "html").alias("h"))
    keys: list[int] = []
    while len(keys) < n:            # more than one round only where pages repeat
        rest = keyed.where(F.col("h") > keys[-1]) if keys else keyed
        got = [r["h"] for r in rest.select("h").orderBy("h").limit(n).collect()]
        keys += sorted(set(got))
        if len(got) < n:
            break
    if not keys:
        return []
    rows = keyed.where(F.col("h").isin(keys[:n])).groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def labelled_pages(pages: DataFrame, sample: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of the ``sample`` first pages (by hash) that name their article; of all pages where none does."""
    @F.pandas_udf("boolean")
    def names_article(s: pd.Series) -> pd.Series:
        return pd.Series([markup_labels(leaf_blocks(x)) is not None for x in s], dtype=bool)

    def labelled(texts):
        found = [(b, markup_labels(b)) for b in map(leaf_blocks, texts)]
        return [(b, y) for b, y in found if y is not None][:sample]

    # pages without such markup are not read; those with it only in a comment, a script or an empty element do not count
    named = pages.where(F.col("html").rlike("(?i)<(?:" + "|".join(sorted(ARTICLE)) + r")[\s/>]"))
    texts = least_pages(named, 2 * sample)
    out = labelled(texts)
    if len(out) < sample and len(texts) == 2 * sample:
        out = labelled(least_pages(named.where(names_article("html")), sample))
    if not out:
        blocks = map(leaf_blocks, least_pages(pages.where("html IS NOT NULL"), sample))
        out = [(b, negative_labels(b)) for b in blocks if b]
    return out


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> ChainModel:
    """Fit the chain on at most ``sample`` labelled pages and as many rebuilt from them."""
    known, texts = [], []
    for blocks, y in labelled_pages(pages, sample):
        known.append(([features(b) for b in blocks], y))
        texts.append(([b.text for b, k in zip(blocks, y) if k], [b.text for b, k in zip(blocks, y) if not k]))
    rng = random.Random(1)
    for i, (article, _) in enumerate(texts * max(1, sample // max(1, len(texts)))):
        i %= len(texts)
        spare = [s for _, o in (texts[i], texts[i - 1]) for s in o] + [" ".join(a.split()[:12]) for a in texts[i - 1][0]]
        if article and spare:
            page = rebuilt(article[:TRAIN_BLOCKS], spare, rng)
            known.append(([features(b) for b, _ in page], [k for _, k in page]))
    return ChainModel().fit(known)


def extract_text(page: str | None, model: ChainModel) -> str:
    """Blocks labelled as article text, joined by one line feed."""
    blocks = leaf_blocks(page)
    keep = model.decode([features(b) for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page row, from its whole html.

    Null or blank html gives an empty text. Truncated pages and unclosed
    elements are read as far as they go. Where no page names its article, the
    sample is labelled by what is marked as something else. Repeated rows give
    repeated results and count once in the sample; extra columns are ignored.
    """
    model = model or train(pages)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([extract_text(x, model) if isinstance(x, str) else "" for x in s], dtype=object)

    out = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), run(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_query(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
