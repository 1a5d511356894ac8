"""Toxicity by multiple-instance learning.

Only documents have labels, yet what makes one toxic is a sentence. A sentence's probability is a logistic
score of its words; a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. The weights
are trained through that formula on document labels, so the model learns which sentences offend
and can point at them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filigree.llm.common import rows_of, through

#: Words and what ends a sentence; prefixes of these lengths are features beside the word itself.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 18
FOLDS, HELD_OUT = 4, 2


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginnings."""
    out = [zlib.crc32(b"=" + word.encode()) % BUCKETS]
    out += [zlib.crc32(b"^" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return out


@dataclass(frozen=True)
class Model:
    """Weights of the features kept; all others weigh nothing."""

    weights: dict[int, float]
    bias: float


class _Words(dict):
    """Weight of a word, kept for words seen before; NaN for what ends a sentence."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__({e: float("nan") for e in ENDS})
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
            self.update({e: float("nan") for e in ENDS})
        got = self[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return got


def sentence_scores(text: str, words: _Words) -> np.ndarray:
    """Probability of each sentence that has a word, in order; 0 by a model without weights."""
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0)
    w = np.fromiter(map(words.__getitem__, tokens), float, len(tokens))
    end = np.isnan(w)
    at = np.cumsum(end) - end
    has = np.bincount(at[~end], minlength=at[-1] + 1) > 0
    sums = np.bincount(at[~end], w[~end], minlength=at[-1] + 1)
    if not words.model.weights:
        return np.zeros(int(has.sum()))
    return 1 / (1 + np.exp(-np.clip(sums[has] + words.model.bias, -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) + 0.0  # 0.0, not -0.0, without sentences


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the sentences that `sentence_scores` scores, in the same order."""
    out, start, words = [], 0, False
    for m in re.finditer(TOKEN.pattern, text):
        if m.group() in ENDS:
            if words:
                out.append((start, m.end()))
            start, words = m.end(), False
        else:
            words = True
    return [*out, (start, len(text))] if words else out


def held_out(id_col: str | Column) -> Column:
    """Rows that training never sees; a null id can't be told, and counts as not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], dict[int, int]]:
    """Sentences as feature ids of at most ``per_class`` labelled documents a class, those with the lowest hash; and all counts."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit("toxicity"), "l_id")
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "l_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in rows_of(batches):
            out = []
            for text in batch.column(0):
                ids, lens, n = [], [], 0
                for t in [*TOKEN.findall(text.as_py().lower()), "."]:
                    if t not in ENDS:
                        got = seen.get(t) or seen.setdefault(t, features(t))
                        ids += got
                        n += len(got)
                    elif n:
                        lens.append(n)
                        n = 0
                out.append((np.array(ids, "<i4").tobytes(), np.array(lens, "<i4").tobytes()))
            ids, lens = list(zip(*out, strict=True)) or ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary()), pa.array(lens, pa.binary())], names=["y", "ids", "lens"])

    got = through(rows.select("text", "y"), "y int, ids binary, lens binary", run).toLocalIterator()
    # Sorted, so that sums come out the same however the rows arrive.
    made = sorted((r["y"], bytes(r["ids"]), bytes(r["lens"])) for r in got)
    return [(y, np.frombuffer(ids, "<i4"), np.frombuffer(lens, "<i4")) for y, ids, lens in made], counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    kept: int = 1500,
    least_z: float = 1.0,
    rounds: int = 300,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model from document labels, of rows that aren't held out.

    Fitted on a bounded sample: ``per_class`` labelled documents of each class, with the lowest hash of their ids, weighed
    as often as their class occurs in all labels. At most ``kept`` features get weights, those that toxic documents have
    most clearly more often (by ``least_z`` standard errors at least); weights are never negative, so
    harmless words beside it can't excuse an offending one. Labels that are neither 0 nor 1 don't count; of several for an id, the largest does.
    Without labels of both classes the model scores 0 everywhere.
    """
    sample, counts = _sample(docs, labels, per_class, id_col, text_col, label_col)
    y = np.array([s[0] for s in sample], float)
    if not len(y) or y.min() == y.max():
        return Model({}, -30.0)
    weight = np.where(y == 1, counts.get(1, 1) / max(1, y.sum()), counts.get(0, 1) / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()

    # Features by the difference of the shares of documents that have them, over its standard error.
    has = np.zeros((2, BUCKETS))
    for label, ids, _ in sample:
        has[int(label), np.unique(ids)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    rate = (has + 0.5) / (n[:, None] + 1)
    z = (rate[1] - rate[0]) / np.sqrt((rate * (1 - rate) / n[:, None]).sum(0))
    top = np.argsort(-np.where(has.sum(0) >= 3, z, 0), kind="stable")[:kept]
    top = np.sort(top[z[top] > least_z])
    place = np.full(BUCKETS, -1)
    place[top] = np.arange(len(top))

    sent, feat, doc = [], [], []
    at = 0
    for d, (_, ids, lens) in enumerate(sample):
        s = np.repeat(np.arange(len(lens)), lens) + at
        f = place[ids]
        sent.append(s[f >= 0])
        feat.append(f[f >= 0])
        doc.append(np.full(len(lens), d))
        at += len(lens)
    sent, feat, doc = (np.concatenate(x) for x in (sent, feat, doc))
    w, b = np.zeros(len(top)), -4.0
    m, v = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(sent, w[feat], minlength=at), -30, 30)))
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        all_ = np.clip(-np.expm1(log_none), 1e-9, 1)
        # d loss / d logit of a sentence: p for a clean document, p * (1 - 1 / P) for a toxic one
        g = (weight * np.where(y == 1, 1 - 1 / all_, 1.0))[doc] * p / len(y)
        grad = np.append(np.bincount(feat, g[sent], minlength=len(top)) + 2e-5 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return Model({int(f): float(x) for f, x in zip(top, w, strict=True)}, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sentence_threshold: float = 0.15, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences`` (+ the whole ``row`` if ``carry``).

    Scores use the text alone. Null and empty texts, and those without a letter, score 0. ``sentences`` are the spans
    (code points) and probabilities of the sentences over ``sentence_threshold`` in documents that are predicted toxic.
    One row for each row of ``docs``, with null or repeated ids too.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(id_col).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in rows_of(batches):
            total, found = [], []
            for text in batch.column(2):
                p = sentence_scores(t := text.as_py(), words)
                total.append(noisy_or(p))
                bad = np.flatnonzero(p >= sentence_threshold) if total[-1] >= threshold else []
                where = sentence_spans(t) if len(bad) else []
                found.append([{"start": where[i][0], "end": where[i][1], "p": float(p[i])} for i in bad if i < len(where)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.float64()), pa.array([int(x >= threshold) for x in total], pa.int32()), pa.array(found, spans), *batch.columns[3:]],
                names=["doc_id", "held_out", "score", "predicted", "sentences", *(["row"] if carry else [])],
            )

    schema = StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start:long,end:long,p:double>>")
    return through(d, StructType([*schema.fields, *d.schema.fields[3:]]), run)
