"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text's view is what it says (which words and pairs of neighbouring words it holds, hashed, and
how much likelier each is in good documents than in bad) beside its shape; the metadata's is where
the page is from and how it is laid out. Both are logistic regressions, fitted by Newton steps whose
sums Spark adds up over all rows. Round by round each view labels the unlabelled rows that it is
sure of, and the other view learns from them beside the given labels.

Words are counted by folds of the documents, and a document is judged by the counts of the other
folds alone, so no text vouches for itself. A quarter of the given labels teaches neither view: on
it a third regression calibrates both views' margins and combines them, and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import Staged, add_columns, quoted, without

SURE = 0.95
PSEUDO_WEIGHT = 0.1  # of a pseudo-label, against a given one
RIDGE = 1.0
FIRST_STEPS, ROUNDS, STEPS = 5, 3, 2
SOURCE_BUCKETS, LANG_BUCKETS = 32, 8
WORD_BUCKETS = 1 << 15  # for words and pairs of words; their numbers are 16 bits wide
FOLDS = 4
SMOOTHING = 2.0  # documents of either kind that every bucket is taken to have been in
SHAPE_DIM = 24
TEXT_DIM = SHAPE_DIM + 2
META_DIM = 8 + SOURCE_BUCKETS + LANG_BUCKETS
# Neither view is preferred where no label is left to calibrate by.
PRIOR = np.array([0.0, 0.5, 0.5])
TEXT_MARGIN, META_MARGIN = 1, 2
SLICE_BYTES = 4_000_000


def _bytes_shares(data: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    groups = [counts[97:123], counts[65:91], counts[48:58], counts[128:], counts[32:33], counts[10:11], counts[33:34],
              counts[[35, 36, 37, 38, 42]], counts[124:125], counts[[46, 44, 59, 58]], counts[[60, 62, 123, 125, 61, 95]],
              counts[[39, 34, 45, 40, 41, 47, 64]]]
    return [float(g.sum()) / n for g in groups]


def shape_features(text: str | None) -> list[float]:
    """Shares of kinds of characters and of repeated words and lines."""
    if not text:
        return [1.0, 1.0] + [0.0] * (SHAPE_DIM - 2)
    words = text.split()
    n = max(1, len(words))
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = text.split("\n")
    top = max(distinct.values(), default=0) / n
    shares = _bytes_shares(text.encode())
    return [1.0, 0.0, *[min(1.0, 4 * s) for s in shares], len(distinct) / n, top, float(top > 0.2),
            len(set(lines)) / len(lines), min(1.0, np.log1p(n) / 10), min(1.0, len(text) / n / 20),
            min(1.0, sum(map(str.istitle, words)) / n * 2), float(text[-1:] in ".!?"),
            min(1.0, shares[7] * 40), min(1.0, shares[8] * 40)]


def word_buckets(text: str | None) -> np.ndarray:
    """Which buckets the words and the pairs of neighbouring words of a whole text fall in, ascending, each once."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, "<u2")
    digest = {w: zlib.crc32(w.encode()) for w in set(words)}
    at = np.array([digest[w] for w in words], np.uint64)
    pairs = (at[:-1] * np.uint64(0x9E3779B1) + at[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(17)
    held = np.zeros(WORD_BUCKETS, bool)
    held[(at % np.uint64(WORD_BUCKETS)).astype(np.int64)] = True
    held[(pairs % np.uint64(WORD_BUCKETS)).astype(np.int64)] = True
    return np.flatnonzero(held).astype("<u2")


def meta_features(source: str | None, lang: str | None, chars: int, lines: int) -> list[float]:
    """What a page's record says: where it is from, its language, how long it is and how it is laid out."""
    x = [0.0] * META_DIM
    x[0], x[1], x[2] = 1.0, min(1.0, np.log1p(chars) / 12), min(1.0, np.log1p(lines) / 8)
    x[3], x[4] = min(1.0, chars / max(1, lines) / 1000), float(chars < 200)
    x[5], x[6], x[7] = float(source is None), float(lang is None), float(lines < 2)
    if source is not None:
        x[8 + zlib.crc32(source.encode()) % SOURCE_BUCKETS] = 1.0
    if lang is not None:
        x[8 + SOURCE_BUCKETS + zlib.crc32(lang.encode()) % LANG_BUCKETS] = 1.0
    return x


def features(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Add ``x``, the text's shape and the metadata as packed 32-bit numbers, and ``words``, its buckets as 16-bit ones."""
    def make(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> list[pa.Array]:
        whole = texts.to_pylist()
        rows = [np.array(shape_features(t) + meta_features(s, g, len(t or ""), (t or "").count("\n") + 1), "<f4").tobytes()
                for t, s, g in zip(whole, sources.cast(pa.string()).to_pylist(),
                                   langs.cast(pa.string()).to_pylist(), strict=True)]
        return [pa.array(rows, pa.binary()), pa.array([word_buckets(t).tobytes() for t in whole], pa.binary())]

    return add_columns(df, [text, source, lang], "x binary, words binary", make, keep=without(df, text, source, lang))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class CoTrained:
    text: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_DIM))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META_DIM))
    both: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    # By fold of the document: how much likelier a bucket is in good documents of the other folds, as logarithm.
    leaning: np.ndarray = field(default_factory=lambda: np.zeros((FOLDS, WORD_BUCKETS), np.float32))

    def content(self, words: list[bytes], fold: np.ndarray) -> np.ndarray:
        """Columns: the mean leaning of a text's buckets, and their sum over the root of their number."""
        length = np.array([len(w) // 2 for w in words], np.int64)
        leaning = self.leaning[np.repeat(fold, length), np.frombuffer(b"".join(words), "<u2")]
        total = np.bincount(np.repeat(np.arange(len(words)), length), weights=leaning, minlength=len(words))
        n = np.maximum(1, length)
        return np.clip(np.column_stack([4 * total / n, total / np.sqrt(n)]), -8, 8)

    def views(self, x: list[bytes], words: list[bytes], fold: np.ndarray) -> dict[str, np.ndarray]:
        """What each view sees of the rows; ``both`` sees one, the text's margin, the metadata's."""
        m = np.frombuffer(b"".join(x), "<f4").astype(np.float64).reshape(-1, SHAPE_DIM + META_DIM)
        text, meta = np.column_stack([m[:, :SHAPE_DIM], self.content(words, fold)]), m[:, SHAPE_DIM:]
        return {"text": text, "meta": meta, "both": np.column_stack([np.ones(len(m)), text @ self.text, meta @ self.meta])}


def _fold(id: Column) -> Column:
    return F.coalesce(F.floor(F.crc32(id.cast("string")) / 4) % FOLDS, F.lit(0)).cast("int")


def _calibrates(id: Column) -> Column:
    return F.coalesce(F.floor(F.crc32(id.cast("string")) / (4 * FOLDS)) % 4 == 3, F.lit(False))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        each = max(1, min(whole.num_rows, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes)))
        for start in range(0, whole.num_rows, each):
            yield whole.slice(start, each)


def _taught(batch: pa.RecordBatch, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and their weights for a view: given ones, and where the other view's margin is sure its own."""
    label = batch.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)
    blank = np.isnan(label)
    held = batch.column("calibrates").to_numpy(zero_copy_only=False).astype(bool)
    y, weight = np.where(blank, 0.0, label), (~blank & ~held).astype(float)
    if margin is not None:
        p = _chance(margin)
        sure = blank & ((p >= SURE) | (p <= 1 - SURE))
        y, weight = np.where(sure, p > 0.5, y), np.where(sure, PSEUDO_WEIGHT, weight)
    return y.astype(float), weight


def _seen(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes], np.ndarray]:
    return (batch.column("x").to_pylist(), batch.column("words").to_pylist(),
            batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64))


def _summed(rows: DataFrame, sums, length: int) -> np.ndarray:
    """Vectors that tasks add up, added up by Spark; what is zero does not travel. The driver gets one vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in _slices(batches):
            sums(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "v"])

    found = (rows.select("x", "words", "fold", "label", "calibrates").mapInArrow(run, "at int, v double")
             .groupBy("at").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros(length)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out


def _leanings(rows: DataFrame, pseudo: CoTrained | None) -> np.ndarray:
    """Of every bucket, the logarithm of its share in good documents against that in bad ones, by the fold left out.

    Documents count by the text view's labels. Where one kind was not seen, nothing leans.
    """
    shape = (FOLDS, 2, WORD_BUCKETS + 1)

    def sums(batch: pa.RecordBatch, total: np.ndarray) -> None:
        margins = None if pseudo is None else pseudo.views(*_seen(batch))["both"]
        y, weight = _taught(batch, None if margins is None else margins[:, META_MARGIN])
        at = np.flatnonzero(weight)
        words = [batch.column("words")[int(i)].as_py() for i in at]
        row = (batch.column("fold").to_numpy(zero_copy_only=False)[at].astype(np.int64) * 2 + (y[at] > 0.5)) * shape[2]
        length = np.array([len(w) // 2 for w in words], np.int64)
        np.add.at(total, np.repeat(row, length) + np.frombuffer(b"".join(words), "<u2"), np.repeat(weight[at], length))
        np.add.at(total, row + WORD_BUCKETS, weight[at])

    by_fold = _summed(rows, sums, int(np.prod(shape))).reshape(shape)
    others = by_fold.sum(axis=0) - by_fold
    documents = others[:, :, WORD_BUCKETS:]
    share = documents / np.maximum(documents.sum(axis=1, keepdims=True), 1e-9)
    counts = others[:, :, :WORD_BUCKETS] / np.maximum(share, 1e-9) + SMOOTHING
    known = np.all(documents > 1e-9, axis=1)
    return np.where(known, np.log(np.maximum(counts[:, 1], 1e-9)) - np.log(np.maximum(counts[:, 0], 1e-9)), 0).astype(np.float32)


def _newton(rows: DataFrame, model: CoTrained, views: str, pseudo: CoTrained | None) -> CoTrained:
    """The model after one Newton step of each named view, from sums over all rows; the driver gets the sums alone.

    With ``pseudo``, unlabelled rows count for a view where that model's other view is sure.
    """
    wanted = views.split()
    sizes = [len(getattr(model, v)) for v in wanted]
    starts = np.cumsum([0] + [n * (n + 1) for n in sizes])

    def sums(batch: pa.RecordBatch, total: np.ndarray) -> None:
        seen = model.views(*_seen(batch))
        margins = None if pseudo is None else pseudo.views(*_seen(batch))["both"]
        for view, start, end in zip(wanted, starts, starts[1:], strict=False):
            if view == "both":
                y = batch.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)
                weight = batch.column("calibrates").to_numpy(zero_copy_only=False).astype(float)
            else:
                other = META_MARGIN if view == "text" else TEXT_MARGIN
                y, weight = _taught(batch, None if margins is None else margins[:, other])
            at = weight > 0
            z, y, weight = seen[view][at], y[at], weight[at]
            p = _chance(z @ getattr(model, view))
            bend = z.T @ (z * (weight * p * (1 - p))[:, None])
            slope = z.T @ (weight * (y - p))
            total[start:end] += np.column_stack([bend, slope]).ravel()

    found = _summed(rows, sums, int(starts[-1]))
    made = {}
    for view, n, start, end in zip(wanted, sizes, starts, starts[1:], strict=False):
        w, m = getattr(model, view), found[start:end].reshape(n, n + 1)
        pull = w - PRIOR if view == "both" else w
        made[view] = w + np.linalg.solve(m[:, :-1] + RIDGE * np.eye(n), m[:, -1] - RIDGE * pull)
    return replace(model, **made)


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Train on ``x``, ``words``, ``fold``, ``label`` (1, 0, or null) and ``calibrates`` (that the label is for the last step).

    Without any label all scores are one half.
    """
    model = CoTrained(leaning=_leanings(rows, None))
    for _ in range(FIRST_STEPS):
        model = _newton(rows, model, "text meta", None)
    for _ in range(rounds):
        teacher = model
        model = replace(model, leaning=_leanings(rows, teacher))
        for _ in range(STEPS):
            model = _newton(rows, model, "text meta", teacher)
    for _ in range(FIRST_STEPS):
        model = _newton(rows.where("calibrates"), model, "both", None)
    return model


def score(rows: DataFrame, model: CoTrained) -> DataFrame:
    """Add ``p_text``, ``p_meta`` and the combined ``score`` to rows with ``x``, ``words`` and ``fold``, which go."""
    def make(x: pa.Array, words: pa.Array, fold: pa.Array) -> list[pa.Array]:
        m = model.views(x.to_pylist(), words.to_pylist(), fold.to_numpy(zero_copy_only=False).astype(np.int64))["both"]
        return [pa.array(_chance(m[:, TEXT_MARGIN])), pa.array(_chance(m[:, META_MARGIN])), pa.array(_chance(m @ model.both))]

    return add_columns(rows, ["x", "words", "fold"], "p_text double, p_meta double, score double", make,
                       keep=without(rows, "x", "words", "fold"))


def prepared(df: DataFrame, labels: DataFrame, learn_from=None, id: str = "doc_id", text: str = "text",
             source: str = "source", lang: str = "lang", label: str = "quality") -> DataFrame:
    """``id`` and what ``co_train`` and ``score`` read, of every row of ``df``. Texts are read here alone, and not shuffled
    as long as the labels are few enough to be broadcast, which is counted."""
    narrow = df.select(quoted(id).alias("id"), quoted(text).alias("text"), quoted(source).alias("source"), quoted(lang).alias("lang"))
    taught = labels.select(quoted(id).alias("of"), quoted(label).cast("double").alias("label")).where("label IN (0, 1)")
    if learn_from is not None:
        taught = taught.where(learn_from(F.col("of")))
    taught = (taught.groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .where("label = most").drop("most"))
    rows = features(narrow).join(small_side(taught), F.col("id") == F.col("of"), "left")
    return rows.select("id", "x", "words", "label", _fold(F.col("id")).alias("fold"),
                       (F.col("label").isNotNull() & _calibrates(F.col("id"))).alias("calibrates"))


def classify(df: DataFrame, labels: DataFrame, learn_from=None, id: str = "doc_id", text: str = "text",
             source: str = "source", lang: str = "lang", label: str = "quality") -> DataFrame:
    """``id``, ``p_text``, ``p_meta``, ``score`` and ``good`` (score of a half or more) for every row of ``df``.

    Three quarters of the labelled rows teach the views and a quarter, by digest of the id, the last
    regression; all other rows teach where a view is sure of them. ``learn_from`` limits by
    condition on the id whose labels are used. An id with labels that disagree counts as
    unlabelled, as do null labels and labels of unknown ids. Null and empty texts have features of
    their own; a null source or language is a level. Rows that repeat are scored alike. Other columns are not read.
    """
    rows = Staged(df.sparkSession, "quality").put(prepared(df, labels, learn_from, id, text, source, lang, label), "rows")
    told = score(rows.select("id", "x", "words", "fold"), co_train(rows))
    return told.select(F.col("id").alias(id), "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("good"))
