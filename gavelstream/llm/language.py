"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier tells the languages
with a one from those with a zero; it is built from n-gram counts of all labelled texts, which
Spark sums per language. Decoding adds up each codeword's losses, weighted by how well a bit
separates its two sides, and takes the nearest. Where the second nearest is close, the text is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, quoted

UNKNOWN = "und"
BUCKETS = 4096  # for pairs of bytes, and again for triples
FEATURES = 2 * BUCKETS
SMOOTHING = 0.5
CONFIDENT = 4.0  # loss margin that a typical text of a language has on each bit
CLOSE = 0.2  # lead in probability under which a decision is ambiguous
AT_ONCE = 4_000_000

# Letters of ASCII to lower case, other ASCII to a blank; other bytes belong to letters mostly.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of all pairs and triples of folded bytes, those of blanks only left out."""
    data = text.encode()
    total = np.zeros(FEATURES, np.int64)
    for k in range(0, len(data), AT_ONCE):
        b = _FOLD[np.frombuffer(data[max(0, k - 2):k + AT_ONCE], np.uint8)]
        # A piece after the first repeats two bytes, whose own pair was counted before.
        pair = (b[:-1] << np.uint32(8)) | b[1:]
        triple = (pair[:-1] << np.uint32(8)) | b[2:]
        pair = pair[1 if k else 0:]
        pair, triple = pair[pair != 0x2020], triple[triple != 0x202020]
        for at, codes in ((0, pair), (BUCKETS, triple)):
            total[at:at + BUCKETS] += np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords: every split of up to five languages, else seeded words far from each other."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([bits for bits in product((1, -1), repeat=n) if bits[0] == 1 and min(bits) < 0]).T
    draws = np.random.default_rng(7).choice((-1, 1), (64, n, 8 * int(np.ceil(np.log2(n)))))
    for d in draws:  # no bit may have all languages on one side
        d[0, np.all(d == 1, axis=0)] = -1
        d[0, np.all(d == -1, axis=0)] = 1
    apart = [(np.count_nonzero(d[:, None] != d[None], axis=2) + 10**6 * np.eye(n, dtype=int)).min() for d in draws]
    return draws[int(np.argmax(apart))]


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    middle: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    @staticmethod
    def of(languages: list[str], counts: np.ndarray) -> Model:
        """From n-gram counts, languages x features."""
        words = codewords(len(languages))
        shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        weights = np.zeros((FEATURES, words.shape[1]))
        for bit, word in enumerate(words.T):
            # Each language counts the same, however much text it has.
            weights[:, bit] = np.log(shares[word > 0].mean(axis=0)) - np.log(shares[word < 0].mean(axis=0))
        typical = shares @ weights
        middle, scale, trust = (np.zeros(words.shape[1]) for _ in range(3))
        for bit, word in enumerate(words.T):
            low, high = typical[word < 0, bit].max(), typical[word > 0, bit].min()
            middle[bit], gap = (low + high) / 2, max(high - low, 1e-9)
            scale[bit], trust[bit] = 2 * CONFIDENT / gap, gap
        return Model(languages, words, weights, middle, scale, trust / trust.sum() * len(trust) if len(trust) else trust)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether another is close."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        counts = ngram_counts(text)
        n = counts.sum()
        margin = (counts @ self.weights / max(n, 1) - self.middle) * self.scale
        loss = (np.logaddexp(0.0, -self.words * margin) * self.trust).sum(axis=1)
        likely = np.exp(loss.min() - loss)
        likely /= likely.sum()
        order = np.argsort(-likely, kind="stable")
        close = len(order) > 1 and likely[order[0]] - likely[order[1]] < CLOSE
        return self.languages[order[0]], float(likely[order[0]]), bool(close)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with text and language. The driver gets one row of counts per language."""
    rows = labelled.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + ngram_counts(one)
        for name, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])],
                                             names=["lang", "feature", "n"])

    summed = (rows.mapInArrow(count, "lang string, feature bigint, n bigint")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.collect_list("feature").alias("at"), F.collect_list("n").alias("n"))
              .orderBy("lang").collect())
    counts = np.zeros((len(summed), FEATURES))
    for i, row in enumerate(summed):
        counts[i, row["at"]] = row["n"]
    return Model.of([row["lang"] for row in summed], counts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and a model without languages. A
    text's n-grams are counted piece by piece, so its length is not limited. Input columns named
    like the outputs are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        made = [model.decode(t) for t in texts.to_pylist()]
        return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()),
                pa.array([m[2] for m in made], pa.bool_())]

    return add_columns(df, [text], "lang_pred string, score double, ambiguous boolean", make)


def held_out(id):
    """A quarter of the documents, by digest of the id, that nothing is learned from; so are rows without id."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(True))
