"""Language identification with error-correcting output codes (op9).

Every learned language gets a binary codeword; for each bit a binary
classifier over hashed letter n-grams (1 to ``ORDER`` letters) says how much
a text looks like the languages with a one. The classifiers are Bayes
log-odds from n-gram counts that Spark sums over all training texts. A text
is given the language whose codeword loses least, each bit's logistic loss
weighted by that bit's training accuracy; a small lead flags it ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import fold, read

ORDER = 3
BUCKETS = 1 << 15
SMOOTHING = 0.5
AMBIGUOUS = 0.6
#: Letters handled in one numpy pass; a longer text is taken alone.
CHUNK = 1 << 20
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letter_table() -> np.ndarray:
    """Lower-case code point of every letter, 32 (blank) for all else; the table covers all planes' letters."""
    import sys
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    return _TABLE[0]


def gram_indices(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text it belongs to, letters per text) for a list of texts.

    Texts are lower-cased, all but letters becomes a blank; an n-gram is
    counted when it holds a letter and, beyond its first character, runs of
    blanks are not repeated.
    """
    table = letter_table()
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lens)
    code = table[code]
    letter = code != 32
    keep = letter | np.concatenate([[True], letter[:-1]])           # one blank after a word
    keep[np.cumsum(lens) - 1] = True                                # and one at the end of a text
    code, owner, letter = code[keep].astype(np.uint64), owner[keep], letter[keep]
    letters = np.bincount(owner[letter], minlength=len(texts))
    idx, own = [], []
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            if len(code) < n:
                break
            m = len(code) - n + 1
            h = np.full(m, np.uint64(n))
            ok = np.zeros(m, bool)
            for j in range(n):
                h = (h ^ code[j:j + m]) * MULTIPLIERS[j]
                h ^= h >> np.uint64(29)
                ok |= letter[j:j + m]
            ok &= owner[:m] == owner[n - 1:]
            idx.append((h[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
            own.append(owner[:m][ok])
    return np.concatenate(idx), np.concatenate(own), letters


def _chunks(texts: list[str]):
    """Slices of the list with at most CHUNK characters each (or one text)."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: one-vs-rest bits and, for up to 7 languages, every other two-way split."""
    if n == 1:
        return np.ones((1, 1))
    rest = [[1 if i == k else -1 for i in range(n)] for k in range(n)] if n > 2 else [[1, -1]]
    if 3 < n <= 7:
        for r in range(2, n // 2 + 1):
            for ones in itertools.combinations(range(n), r):
                if 2 * r < n or 0 in ones:
                    rest.append([1 if i in ones else -1 for i in range(n)])
    elif n > 7:                      # pseudo-random balanced splits, 4 log2 n of them
        rng = np.random.default_rng(n)
        for _ in range(4 * int(np.ceil(np.log2(n)))):
            ones = set(rng.permutation(n)[: n // 2].tolist())
            rest.append([1 if i in ones else -1 for i in range(n)])
    return np.array(rest, float).T


class OutputCodeModel:
    """languages, codewords (language x bit), weights (bucket x bit), bit weights."""

    def __init__(self, languages, counts: np.ndarray):
        self.languages = list(languages)
        self.code = codewords(len(self.languages))
        share = counts + SMOOTHING
        share = share / share.sum(axis=1, keepdims=True)            # languages count alike, whatever their share
        bits = []
        for col in self.code.T:
            one = share[col > 0].mean(axis=0)
            other = share[col < 0].mean(axis=0) if (col < 0).any() else np.full(share.shape[1], 1 / share.shape[1])
            bits.append(np.log(one / other))
        self.weights = np.array(bits).T.astype(np.float32)
        self.bit_weight = np.ones(self.code.shape[1])

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text x bit) mean log-odds per n-gram, scaled by the root of the number of n-grams; letters per text."""
        out = np.zeros((len(texts), self.code.shape[1]))
        letters = np.zeros(len(texts), np.int64)
        for a, b in _chunks(texts):
            idx, own, n = gram_indices(texts[a:b])
            letters[a:b] = n
            total = np.bincount(own, minlength=b - a)
            for k in range(out.shape[1]):
                s = np.bincount(own, weights=self.weights[idx, k], minlength=b - a)
                out[a:b, k] = s / np.sqrt(np.maximum(total, 1))
        return out, letters

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(text x language) loss-weighted distance to each codeword."""
        w = self.bit_weight / self.bit_weight.sum()
        out = np.empty((len(margins), len(self.languages)))
        for k, word in enumerate(self.code):
            out[:, k] = (np.logaddexp(0, -margins * word) * w).sum(axis=1)
        return out

    def predict(self, texts: list[str]):
        """(language or 'und', score, ambiguous) per text."""
        margins, letters = self.margins(texts)
        loss = self.losses(margins)
        z = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = z.max(axis=1) / z.sum(axis=1)
        best = loss.argmin(axis=1)
        lang = [self.languages[i] if n else "und" for i, n in zip(best, letters)]
        score = np.where(letters > 0, score, 0.0)
        return lang, score, (score < AMBIGUOUS) | (letters == 0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> OutputCodeModel | None:
    """Model from every labelled row: n-gram counts per language, then the weight of each bit.

    What reaches the driver is one count vector per language (``BUCKETS``
    numbers) and one accuracy per bit. None when there is no labelled text.
    """
    use = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                texts = part["text"].fillna("").tolist()
                v = total.setdefault(name, np.zeros(BUCKETS))
                for a, b in _chunks(texts):
                    v += np.bincount(gram_indices(texts[a:b])[0], minlength=BUCKETS)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    parts = use.mapInPandas(count, "lang string, v array<double>")
    rows = (parts.select("lang", F.posexplode("v").alias("i", "c")).where("c > 0")
            .groupBy("lang", "i").agg(F.sum("c").alias("c")).groupBy("lang")
            .agg(F.collect_list(F.struct("i", "c")).alias("cells")).collect())
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return None
    counts = np.zeros((len(rows), BUCKETS))
    for k, r in enumerate(rows):
        counts[k, [c["i"] for c in r["cells"]]] = [c["c"] for c in r["cells"]]
    model = OutputCodeModel([r["lang"] for r in rows], counts)
    index = {r["lang"]: k for k, r in enumerate(rows)}

    def accuracy(batches):
        right, n = np.zeros(model.code.shape[1]), 0
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            word = model.code[[index[x] for x in pdf["lang"]]]
            right += (model.margins(texts)[0] * word > 0).sum(axis=0)
            n += len(texts)
        if n:
            yield pd.DataFrame({"bit": np.arange(len(right)), "right": right, "n": n})

    for r in use.where(F.col("lang").isin(list(index))).mapInPandas(accuracy, "bit int, right double, n long") \
            .groupBy("bit").agg((F.sum("right") / F.greatest(F.sum("n"), F.lit(1))).alias("a")).collect():
        model.bit_weight[r["bit"]] = max(r["a"] - 0.5, 0.01)
    return model


def predict(docs: DataFrame, model: OutputCodeModel | None, keep: list[str], text: Column) -> DataFrame:
    """``keep`` columns plus lang_pred, score and ambiguous for every row."""
    def run(s):
        texts = [t if isinstance(t, str) else "" for t in s]
        if model is None or not texts:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "ambiguous": True})
        lang, score, odd = model.predict(texts)
        return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": odd})


    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def udf(s: pd.Series) -> pd.DataFrame:
        return run(s)

    return docs.select(*keep, udf(text).alias("_p")).select(*keep, "_p.*")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous for every document row.

    Learns from rows with a non-null lang whose crc32(doc_id) mod 4 is not 2.
    Null texts and texts without a letter are ``und`` with score 0; with no
    training text everything is ``und``; repeated rows are judged alike.
    """
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"),
                       (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(base.where(~F.col("held_out")))
    return predict(base, model, ["doc_id", "held_out"], F.col("text"))


def op9_query(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))

