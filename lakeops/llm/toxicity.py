"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax.

Every word is the mean of the vectors of its character n-grams (the whole word is one of them), a text the
mean of its words, and two class vectors turn that into a softmax. Vectors and classes are learned together,
in numpy, from a bounded sample of labelled rows, so a misspelling that was never seen still shares most
n-grams with the words it comes from. Since all steps are linear, scoring needs one number for each n-gram.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, remembered, task, texts

WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """What scoring needs: a margin for each n-gram bucket, the bias, and where on that scale the cut lies."""

    margins: np.ndarray  # NaN: an n-gram that was never met
    bias: float
    cut: float
    at: float
    typical: float = 0.0  # of a word without known n-grams: what words of clean texts have on average
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def grams(word: str, buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> list[int]:
    """Distinct buckets of a word's n-grams, its ends marked, and of the whole word."""
    w = f"<{word}>"
    return list({zlib.crc32(w.encode()) % buckets, *(zlib.crc32(w[i:i + n].encode()) % buckets for n in sizes for i in range(len(w) - n + 1))})


def _bag(docs: list[str], buckets: int):
    """Documents by words and words by n-grams as index arrays, with the weights of the means."""
    known: dict[str, int] = {}
    doc, word, share, flat, sizes = array("i"), array("i"), array("f"), array("i"), array("i")  # no Python object for each entry
    for k, text in enumerate(docs):
        counts: dict[str, int] = {}
        for w in WORDS.findall(text.lower()):
            counts[w] = counts.get(w, 0) + 1
        total = sum(counts.values())
        for w, n in counts.items():
            if w not in known:
                known[w] = len(known)
                own = grams(w, buckets)
                flat.extend(own)
                sizes.append(len(own))
            doc.append(k)
            word.append(known[w])
            share.append(n / total)
    return *(np.frombuffer(x, np.int32) for x in (doc, word)), np.frombuffer(share, np.float32), *(np.frombuffer(x, np.int32) for x in (flat, sizes))


def fit(docs: list[str], toxic: list[int], weight_clean: float = 1.0, at: float = 0.3, buckets: int = 1 << 18, width: int = 8,
        steps: int = 60, rate: float = 0.3, seed: int = 7) -> Model:
    """Fit on four fifths of the sample; on the last fifth find the margin with the best F1 score, which then scores ``at``.

    ``weight_clean``: how many clean rows one clean row of the sample stands for. With one class only, every
    text scores the smoothed share of that class.
    """
    y = np.array(toxic, dtype=np.int64)
    if y.sum() in (0, len(y)):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(np.zeros(1), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0, 0.5)
    fold = np.arange(len(y)) % 5 == 4
    if not 0 < y[fold].sum() < fold.sum() or not 0 < y[~fold].sum() < (~fold).sum():
        fold = np.zeros(len(y), bool)
    doc, word, share, gram, sizes = _bag(docs, buckets)
    starts, each, of = np.cumsum(sizes) - sizes, (1 / sizes).astype(np.float32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((buckets, width)) * 0.05).astype(np.float32)
    classes = (rng.standard_normal((width, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    learn = np.where(fold, 0, np.where(y == 1, 0.5 / y[~fold].mean(), 0.5 / (1 - y[~fold].mean()))) / (~fold).sum()

    def margins() -> np.ndarray:  # of class 1 over class 0, for every document
        side = vectors @ (classes[:, 1] - classes[:, 0])
        words = np.add.reduceat(side[gram], starts) * each
        return np.bincount(doc, weights=words[word] * share, minlength=len(y)) + float(bias[1] - bias[0])

    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, classes, bias)]
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-margins())) - y) * learn  # of the softmax's second class; the first has its negative
        by_word = (np.bincount(word, weights=error[doc] * share, minlength=len(sizes)) * each).astype(np.float32)
        by_gram = np.bincount(gram, weights=by_word[of], minlength=buckets).astype(np.float32)
        side = vectors.T @ by_gram
        slopes = (np.outer(by_gram, classes[:, 1] - classes[:, 0]) + 1e-6 * vectors, np.stack([-side, side], 1), np.array([-error.sum(), error.sum()], np.float32))
        for p, g, (m, v), speed in zip((vectors, classes, bias), slopes, moments, (rate, 0.05, 0.05)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= speed * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    z = margins()
    held = fold if fold.any() else np.ones(len(y), bool)
    side = (vectors @ (classes[:, 1] - classes[:, 0])).astype(np.float64)
    own = float(bias[1] - bias[0])
    side[np.bincount(gram, minlength=buckets) == 0] = np.nan
    return Model(side, own, _best_cut(z[held], y[held], weight_clean), at, float(z[y == 0].mean()) - own)


def _best_cut(z: np.ndarray, y: np.ndarray, weight_clean: float) -> float:
    """The margin with the best F1 score, midway to the next text below; of several as good, the highest."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit, miss = np.cumsum(y), np.cumsum((1 - y) * weight_clean)
    score = 2 * hit / (hit + miss + y.sum())
    k = int(np.flatnonzero(score >= score.max() - 1e-12)[0])
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1e-6)


class _Margins(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.margins, self.size, self.typical = model.margins, len(model.margins), model.typical

    def __missing__(self, word: str) -> float:
        own = self.margins[grams(word, self.size)]
        own = own[~np.isnan(own)]
        value = float(own.mean()) if len(own) else self.typical
        if len(self) < 300_000:
            self[word] = value
        return value


def _margins(model: Model) -> _Margins:
    """The words of a model that this worker has met, kept from task to task."""
    return remembered(("toxicity", model.key), lambda: _Margins(model))


def score_text(text: str, model: Model, known: _Margins) -> float:
    words = WORDS.findall(text.lower())
    if not words:
        return 0.0
    z = sum(map(known.__getitem__, words)) / len(words) + model.bias - model.cut
    return float(1 / (1 + np.exp(-(z + np.log(model.at / (1 - model.at))))))


def _scores(batches, shared):
    model = shared.value
    known = _margins(model)
    for batch in in_batches(batches):
        scores = [score_text(t, model, known) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(scores, pa.float64())],
                                         names=[*(c for c in batch.schema.names if c != "text"), "score"])


def _clean(batches, shared):
    model = shared.value
    known = _margins(model)
    for column in batches:
        yield pa.array([score_text(t or "", model, known) < model.at for t in column.to_pylist()], pa.bool_())


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that labels are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 4500, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: of the labelled rows that are not held out, those whose ids hash lowest,
    at most ``most_toxic`` toxic and ``most_clean`` clean ones. NULL labels and ids are left out; an id with several
    labels counts as toxic if one says so."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(id_col))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    sample = parts[0].union(parts[1])  # at most most_toxic + most_clean pairs of numbers: safe to broadcast
    rows = (texts(docs, id_col, text_col).join(F.broadcast(sample), "id").select("id", "text", "y")
            .orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(most_toxic + most_clean).collect())
    taken = sum(r.y == 0 for r in rows)
    return fit([r.text for r in rows], [r.y for r in rows], max(1.0, counts.get(0, 0) / max(1, taken)) / max(1.0, counts.get(1, 0) / max(1, sum(r.y for r in rows))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey (hash of the text), score and predicted for every row; a text without words scores 0.

    The model is a fixed number of buckets, so its broadcast has the same size on any input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    scored = rows.mapInArrow(task(_scores, shared), "id long, tkey long, score double")
    return scored.select(F.col("id").alias("doc_id"), "tkey", "score", (F.col("score") >= model.at).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic.

    Only texts go to Python and only verdicts come back; the rows wait in the JVM, which spills them if it must.
    """
    run = task(_clean, docs.sparkSession.sparkContext.broadcast(model))

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)

    return docs.filter(clean(F.col(text_col)))
