"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their leading 4, 5 and 6
letters.  The model is a bias, a weight per term and a vector per term whose
inner products weigh pairs of terms, so a pair (an insult with a mention of a
group) can count where its members alone do not.  Terms enter the model by their
association with the label over the training rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import keep, tidy

#: Bounds of the fit: labelled rows, terms in the model, length of a term's vector.
MOST_ROWS, MOST_TERMS, FACTORS = 20_000, 4096, 8
BUCKETS = 1 << 24
FOLDS = 5
_WORDS = re.compile(r"[^\W_]+").findall
_PREFIXES = (4, 5, 6)


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its prefixes."""
    parts = [word, *(f"{word[:k]}\0{k}" for k in _PREFIXES if len(word) > k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def terms(text: str) -> set[int]:
    return {t for w in set(_WORDS(text.lower())) for t in word_terms(w)}


@dataclass(frozen=True)
class Machine:
    """Bias, weights and vectors of the terms listed in ``ids``."""

    ids: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Model output for rows given as positions in ``ids``."""
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            cols = np.concatenate([rows[k] for k in full])
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            v = self.vectors[cols]
            s, q = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
            out[full] += np.add.reduceat(self.weights[cols], at) + 0.5 * (s * s - q).sum(axis=1)
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, *, rounds: int = 150, rate: float = 0.05, penalty: float = 2e-5) -> Machine:
    """Minimise the logistic loss by Adam over all rows at once."""
    n, m = len(rows), len(ids)
    prior = (labels.sum() + 0.5) / (n + 2) if n else 0.25
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)), float(np.log(prior / (1 - prior)))
    if not n or not m:
        return Machine(ids, b, w, v)
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate(rows).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, np.zeros(1))]
    for t in range(1, rounds + 1):
        # a factor at a time, so that what is held is a few numbers per term of a row
        z, sums = b + np.bincount(row, w[cols], n), []
        for k in range(FACTORS):
            one = v[cols, k]
            sums.append(np.bincount(row, one, n))
            z += 0.5 * (sums[k] ** 2 - np.bincount(row, one * one, n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        gr = g[row]
        pull = np.empty_like(v)
        for k in range(FACTORS):
            pull[:, k] = np.bincount(cols, gr * (sums[k][row] - v[cols, k]), m)
        grads = (np.bincount(cols, gr, m) + penalty * w, pull + penalty * v, np.array([g.sum()]))
        steps = []
        for (mean, square), grad in zip(state, grads):
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.999
            square += 0.001 * grad * grad
            steps.append(rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9))
        w, v, b = w - steps[0], v - steps[1], b - float(steps[2][0])
    return Machine(ids, b, w, v)


def held_out(id_col: str):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Machine:
    """Fit on at most ``most_rows`` labelled rows outside the held-out fold.

    Beyond that bound the rows are those of least hash of the id.  Null labels and
    ids are left out; of repeated labels the largest counts, of the texts of repeated
    ids the least by code point.  Without any row the model gives every text the same low score.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = keep(known.orderBy(F.xxhash64("i"), "i").limit(most_rows), "toxic-labels")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # the label side has most_rows rows of two numbers at most
    rows = texts.join(F.broadcast(known), "i").groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    rows = keep(rows.select("t", "y"), "toxic-rows")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                parts = [(np.fromiter(terms(t), np.int32), y) for t, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                got = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int32)
                hit = np.concatenate([np.full(len(p), y, np.int64) for p, y in parts]) if parts else np.zeros(0, np.int64)
                ids, slot = np.unique(got, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.bincount(slot, hit, len(ids)).astype(np.int64)), pa.array(np.bincount(slot, minlength=len(ids)).astype(np.int64))], names=["term", "pos", "n"])

    n_rows, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.mapInArrow(tidy(tally), "term int, pos bigint, n bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    expected = F.col("n") * F.lit(n_pos / max(n_rows, 1))
    lift = (F.col("pos") - expected) * (F.col("pos") - expected) / (expected + 1)
    strong = counts.where("pos >= 3").select("term", lift.alias("x")).where("x > 4").orderBy(F.desc("x"), "term").limit(MOST_TERMS)
    ids = np.array(sorted(r["term"] for r in strong.collect()), np.int64)
    place = {int(t): k for k, t in enumerate(ids)}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(sorted(place[x] for x in terms(t) if x in place), "<u2").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], names=["f", "y"])

    # most_rows rows of two bytes a term: of MOST_TERMS terms at most, a few as a rule
    got = sorted((r["y"], bytes(r["f"])) for r in rows.mapInArrow(tidy(put), "f binary, y int").collect())
    return fit([np.frombuffer(f, "<u2") for _, f in got], np.array([y for y, _ in got], float), ids)


class Scorer:
    """Scores of texts by a fitted model; what a word adds is remembered."""

    def __init__(self, model: Machine, most_words: int = 400_000):
        self.model, self.most_words = model, most_words
        self.place = {int(t): k for k, t in enumerate(model.ids)}
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows = []
        for t in texts:
            found = set(_WORDS((t or "").lower()))
            if len(self.words) > self.most_words:
                self.words.clear()
            for w in found.difference(self.words):
                self.words[w] = tuple(self.place[x] for x in word_terms(w) if x in self.place)
            rows.append(np.array(sorted({k for w in found if (f := self.words[w]) for k in f}), np.int64))
        return 1 / (1 + np.exp(-np.clip(self.model.logits(rows), -500, 500)))


def score(docs: DataFrame, model: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1 from the whole text.

    Null and empty texts get the score of no terms.  Very long texts are read
    whole; repeated rows and null ids are kept one to one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1).to_pylist()))], names=["i", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"i {kind}, s double")
    return out.select(F.col("i").alias(id_col), F.col("s").alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``.

    Null and empty texts score low and stay.  Rows pass through one to one, without
    a shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; see ``train`` and ``score``.

    An empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    out = score(docs, model, id_col=id_col, text_col=text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
