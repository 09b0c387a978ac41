"""Toxicity: multiple-instance learning with a noisy-or over sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordCache, distinct_words, frugal, slices

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: A sentence ends with a line, or with a word that ends so.
_ENDS = (".", "!", "?", ".\"", "!\"", "?\"", ".)", "!)", "?)", "。", "！", "？")
#: Bits of a word's hash: only words that agree in all of them share a weight.
BITS = 62


@dataclass
class Sentences:
    """The words of some texts that have a letter or digit, by sentence; only sentences with such words count."""

    #: Hashes of the distinct words, the place among them of each word in turn, and the sentence of each, numbered throughout.
    words: np.ndarray
    at: np.ndarray
    sentence: np.ndarray
    #: The text of each sentence, and the number of texts.
    text: np.ndarray
    texts: int

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the hashes of its words and the start of each sentence."""
        first = np.searchsorted(self.sentence, np.arange(len(self.text)))
        cuts = np.searchsorted(self.text, np.arange(self.texts + 1))
        edges = np.append(first, len(self.at))[cuts]
        for i in range(self.texts):
            yield self.words[self.at[edges[i] : edges[i + 1]]], first[cuts[i] : cuts[i + 1]] - edges[i]


class WordTable:
    """Maps the words of texts to hashes of ``bits`` bits, at most 62; a word is cut at white space, lower-cased and stripped of punctuation."""

    def __init__(self, bits: int):
        self.bits = bits
        self.known = WordCache(self.code)

    def code(self, word: str) -> int:
        """Twice the hash, -1 for a word without letter or digit, and one more if a sentence ends with the word."""
        core = _EDGES.sub("", word.lower())
        key = xxhash.xxh64_intdigest(core) >> (64 - self.bits) if core else -1
        return 2 * key + word.endswith(_ENDS)

    def read(self, texts: pa.Array) -> Sentences:
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        words, at, counts = distinct_words(lines.values)
        both = np.array(self.known.of(words), dtype=np.int64)
        end = (both & 1).astype(bool)[at]
        after = np.cumsum(counts)
        end[after[counts > 0] - 1] = True
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(0, after)[lines.offsets.to_numpy()]))
        number = np.cumsum(end) - end
        keep = (both >> 1)[at] >= 0
        at, number, text = at[keep], number[keep], text[keep]
        new = np.r_[True, number[1:] != number[:-1]] if len(number) else np.zeros(0, dtype=bool)
        return Sentences(both >> 1, at, np.cumsum(new) - 1, text[new], len(texts))

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a text and the start of each sentence that has words."""
        return next(self.read(pa.array([text], pa.string())).each())


@dataclass
class NoisyOr:
    """p(document) = 1 - product over sentences of (1 - p(sentence)); p(sentence) is a logistic in the sum of its words' weights."""

    weights: np.ndarray
    bias: float
    #: The hashes that the weights belong to, ascending; without them a word is the place of its weight.
    keys: np.ndarray | None = None
    bits: int = BITS

    def weights_of(self, words: np.ndarray) -> np.ndarray:
        """Weights of words; those that have none weigh nothing."""
        if self.keys is None:
            return self.weights[words].astype(np.float64)
        if not len(self.keys):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, self.weights[at], 0.0).astype(np.float64)

    def sentence_logits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights_of(words), starts) + self.bias if len(starts) else np.zeros(0)

    def score(self, words: np.ndarray, starts: np.ndarray) -> float:
        return float(-np.expm1(-np.logaddexp(0, self.sentence_logits(words, starts)).sum()))

    def scores(self, table: WordTable, texts: pa.Array) -> np.ndarray:
        """Scores of a column of texts, in order."""
        out = [np.zeros(0)]
        for first, n in slices(texts):
            x = table.read(texts.slice(first, n))
            # Only words that occur are looked up, so that words without letters (-1) don't matter.
            weights = np.where(x.words >= 0, self.weights_of(np.maximum(x.words, 0)), 0.0)
            z = np.bincount(x.sentence, weights[x.at], len(x.text)) + self.bias
            out.append(-np.expm1(-np.bincount(x.text, np.logaddexp(0, z), n)))
        return np.concatenate(out)


#: Documents that a word must be in, and standard errors by which its shares among the kinds must differ, to get a weight.
MIN_DOCS, LEAST_Z = 4, 3.5


def _prior_bias(y: np.ndarray, sentences: np.ndarray) -> float:
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    return float(np.log(-np.log1p(-prior) / max(1.0, sentences.mean() if len(y) else 1.0)))


def columns_of(words: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's words those among ``keys``, by their place there, and the sentence of each."""
    if not len(words) or not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    column = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    keep = np.flatnonzero(keys[column] == words)
    return column[keep], np.searchsorted(starts, keep, side="right") - 1


def fit_columns(rows: list[tuple[np.ndarray, np.ndarray]], sentences: np.ndarray, labels: np.ndarray, n_words: int, rounds: int = 300, ridge: float = 1e-6, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Word weights and bias by Adam on the log-likelihood of the noisy-or, from document labels alone.

    ``rows`` has for each document its words that can get a weight (as ``columns_of`` gives them), ``sentences`` its number of
    sentences: those without such words are alike, and their number is enough.
    """
    y, size = np.asarray(labels, dtype=np.float64), len(rows)
    bias = _prior_bias(y, sentences)
    words, sent, doc, n = [], [], [], 0
    plain = sentences.astype(np.float64)
    for i, (column, sentence) in enumerate(rows):
        own, number = np.unique(sentence, return_inverse=True)
        words.append(column)
        sent.append(number + n)
        doc.append(np.full(len(own), i))
        n += len(own)
        plain[i] -= len(own)
    words, sent, doc = np.concatenate(words), np.concatenate(sent), np.concatenate(doc)
    w = np.zeros(n_words)
    m1, m2, b1, b2 = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sent, weights=w[words], minlength=n) + bias
        total = np.maximum(np.bincount(doc, weights=np.logaddexp(0, z), minlength=size) + plain * np.logaddexp(0, bias), 1e-9)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) / size
        g = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.bincount(words, weights=g[sent], minlength=len(w)) + ridge * w
        grad_b = g.sum() + (slope * plain).sum() / (1 + np.exp(-bias))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * grad_b, 0.99 * b2 + 0.01 * grad_b**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias -= rate * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8)
    return w, float(bias)


def fit_noisy_or(docs: list[tuple[np.ndarray, np.ndarray]], labels, bits: int, rounds: int = 300, min_docs: int = MIN_DOCS, least_z: float = LEAST_Z) -> NoisyOr:
    """Trains a model from documents (word hashes, sentence starts) held in memory.

    Only words of at least ``min_docs`` documents whose share among the labelled kinds differs by ``least_z`` standard errors get a
    weight: with a million words, less would be chance. Without documents of both kinds the model scores all alike.
    """
    y = np.asarray(labels, dtype=np.float64)
    sentences = np.array([len(s) for _, s in docs], dtype=np.int64)
    nothing = NoisyOr(np.zeros(0, dtype=np.float32), _prior_bias(y, sentences), np.zeros(0, dtype=np.int64), bits)
    if not sentences.sum() or y.min() == y.max():
        return nothing
    counted = [np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.unique(b) for (b, _), label in zip(docs, y) if label == kind)]), return_counts=True) for kind in (0, 1)]
    keys = np.union1d(counted[0][0], counted[1][0])
    seen = [np.zeros(len(keys), dtype=np.int64) for _ in range(2)]
    for kind in (0, 1):
        seen[kind][np.searchsorted(keys, counted[kind][0])] = counted[kind][1]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    share = (seen[0] + seen[1]) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share) * (1 / n0 + 1 / n1), 1e-12))
    keys = keys[(seen[0] + seen[1] >= min_docs) & (np.abs(seen[1] / n1 - seen[0] / n0) >= least_z * error)]
    if not len(keys):
        return nothing
    w, bias = fit_columns([columns_of(*d, keys) for d in docs], sentences, y, len(keys), rounds)
    return NoisyOr(w.astype(np.float32), bias, keys, bits)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, limit: int) -> DataFrame:
    """Ids, texts and labels of at most ``limit`` labelled ids (those with the lowest hash); null labels and ids don't count.

    An id with several labels has the lowest; an id with several rows comes with each of them, and the caller learns from one.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & allowed).groupBy("doc_id").agg(F.min(F.col(label_col).cast("int")).alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", allowed: Column | None = None, limit: int = 20_000, bits: int = BITS) -> NoisyOr:
    """Fits on at most ``limit`` labelled rows, the documented bound.

    Their texts become word hashes on the executors. The words that get a weight are chosen by an aggregate over the documents'
    distinct words, as in ``fit_noisy_or``; only these words of the sample come to the driver.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(bits)
        for b in batches:
            for first, n in slices(b.column(1)):
                rows = list(table.read(b.column(1).slice(first, n)).each())
                arrays = [pa.array([r[0].astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(2).slice(first, n), *arrays], names=["doc_id", "label", "words", "starts"])

    def document(words, starts) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(words.as_buffer(), "<i8"), np.frombuffer(starts.as_buffer(), "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            words = [np.unique(np.frombuffer(w.as_buffer(), "<i8")) for w in b.column(2)]
            keys, at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *words]), return_inverse=True)
            toxic = np.repeat(label == 1, [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at[~toxic], minlength=len(keys))), pa.array(np.bincount(at[toxic], minlength=len(keys)))], names=["word", "n0", "n1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled(docs, labels, label_col, F.lit(True) if allowed is None else allowed, limit)
    sample = sample.mapInArrow(frugal(features), f"doc_id {kind}, label int, words binary, starts binary")
    one = sample.groupBy("doc_id").agg(F.min(F.struct("label", "words", "starts")).alias("x"))
    sample = scratch.keep(one.select("doc_id", "x.label", "x.words", "x.starts"), "sample")
    number = sample.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    n, n1 = number["n"], number["n1"]
    keys = np.zeros(0, dtype=np.int64)
    if 0 < n1 < n:
        share = (F.col("n0") + F.col("n1")) / n
        error = F.sqrt(F.greatest(share * (1 - share) * (1 / (n - n1) + 1 / n1), F.lit(1e-12)))
        counts = sample.mapInArrow(count, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        chosen = counts.where((F.col("n0") + F.col("n1") >= MIN_DOCS) & (F.abs(F.col("n1") / n1 - F.col("n0") / (n - n1)) >= LEAST_Z * error))
        keys = np.sort(chosen.select("word").toArrow()["word"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document(w, s) for w, s in zip(b.column(2), b.column(3))]
            found = [columns_of(*r, shared.value) for r in rows]
            arrays = [pa.array([len(r[1]) for r in rows], pa.int64()), *(pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in range(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["doc_id", "label", "sentences", "words", "sentence"])

    got = sample.mapInArrow(choose, f"doc_id {kind}, label int, sentences long, words binary, sentence binary").orderBy("doc_id").toArrow()
    scratch.drop(sample)
    y, sentences = got["label"].to_numpy(), got["sentences"].to_numpy()
    if not len(keys):
        return NoisyOr(np.zeros(0, dtype=np.float32), _prior_bias(y, sentences), keys, bits)
    w, bias = fit_columns([tuple(np.frombuffer(x.as_buffer(), "<i4") for x in r) for r in zip(got["words"], got["sentence"])], sentences, y, len(keys))
    return NoisyOr(w.astype(np.float32), bias, keys, bits)


def rows_where(docs: DataFrame, passing: Callable[[], Callable[[pa.Array], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass: ``passing()`` gives a task a function from an Arrow column of texts
    to a mask. Columns travel by number, so that their names don't matter."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = passing()
        for b in batches:
            yield b.filter(pa.array(test(b.column(len(names))), pa.bool_())).select(range(len(names)))

    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"c_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return renamed.mapInArrow(frugal(run), schema).toDF(*names)


def below(docs: DataFrame, model: NoisyOr, most: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below ``most``; null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passing() -> Callable[[pa.Array], np.ndarray]:
        model, table = shared.value, WordTable(shared.value.bits)
        return lambda texts: model.scores(table, texts) < most

    return rows_where(docs, passing)


def score(docs: DataFrame, model: NoisyOr, spans_from: float | None = None) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``score`` and, with ``spans_from``, ``offending``.

    ``offending`` is empty where the score is less than ``spans_from``; else it lists the sentences (number, from 0, among those
    with words; probability; text of the sentence's words joined by spaces as they stand) whose own probability is at least
    ``spans_from``, or the likeliest one if many sentences make up the score. Null and empty texts have no sentence and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, WordTable(shared.value.bits)
        for b in batches:
            scores = m.scores(table, b.column(1))
            arrays = [b.column(0), pa.array(scores, pa.float64())]
            if spans_from is not None:
                found = [_locate(table, m, b.column(1)[i].as_py() or "", spans_from) if s >= spans_from else [] for i, s in enumerate(scores.tolist())]
                arrays.append(pa.array(found, pa.list_(pa.struct([("sentence", pa.int32()), ("probability", pa.float64()), ("text", pa.string())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "offending"][: len(arrays)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double" + (", offending array<struct<sentence: int, probability: double, text: string>>" if spans_from is not None else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), schema)


def _locate(table: WordTable, model: NoisyOr, text: str, least: float) -> list[dict]:
    """The offending sentences of one text."""
    spans: list[list[str]] = [[]]
    for line in text.split("\n"):
        for word in line.split():
            spans[-1].append(word)
            if table.code(word) & 1:
                spans.append([])
        spans.append([])
    spans = [s for s in spans if any(table.code(w) >= 0 for w in s)]
    words, starts = table.sentences(text)
    p = 1 / (1 + np.exp(-np.clip(model.sentence_logits(words, starts), -500, 500)))
    at = np.flatnonzero(p >= least) if (p >= least).any() else [int(np.argmax(p))] if len(p) else []
    return [{"sentence": int(i), "probability": float(p[i]), "text": " ".join(spans[i])} for i in at]


#: Documents whose score reaches this are predicted toxic.
THRESHOLD = 0.7


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``offending``: trained on rows whose fold of 3 is not 1, applied to all.

    A null id counts as not held out and is never learnt from; repeated ids are rows like any other, of which at most one text is
    learnt from; null and empty texts score 0; other columns are ignored, whatever their names; without rows there are none in the
    result, and without labels of both kinds no word has a weight.
    """
    model = train(docs, labels, "toxic", fold("doc_id", 3) != 1)
    out = score(docs, model, THRESHOLD)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
