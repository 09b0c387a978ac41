"""Quality: random-indexing word vectors pooled per document, then a two-layer network with temperature-calibrated scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCache, distinct_words, frugal, slices
from .toxicity import fold, labelled, rows_where

#: Buckets of word cores, buckets of word shapes, dimensions, non-zero entries of an index vector.
CORES, SHAPES, DIM, ENTRIES = 16_384, 512, 64, 2
_BUCKETS = CORES + SHAPES
_CHUNK = 256
#: Bytes of text whose words are held at once.
_SLICE = 2_500_000
_NON_WORD = re.compile(r"[\W_]+")


class Shapes:
    """Maps words (cut at white space) to the bucket of their letters and digits, lower-cased, and to that of their shape."""

    def __init__(self):
        self.known = WordCache(self.code)

    @staticmethod
    def code(word: str) -> int:
        core = word if word.isalnum() else _NON_WORD.sub("", word)
        case = 0 if not core else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() else 4
        tail = word[-1]
        tail = 0 if tail.isalnum() else 1 if tail in ".,;:?\"')" else 2 if tail == "!" else 3
        extra = min(3, len(word) - len(core))
        length = min(7, len(core) // 3)
        shape = ((case * 4 + tail) * 4 + extra) * 4 + length // 2
        bucket = xxhash.xxh32_intdigest(core.lower()) % CORES if core else 0
        return bucket << 16 | min(len(core), 127) << 9 | shape % SHAPES

    def distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct words of some texts, the place of each word in turn among them, and each text's number of words."""
        words, at, counts = distinct_words(texts)
        return np.array(self.known.of(words), dtype=np.int64), at, counts

    def codes(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of all texts, and the number of words of each."""
        code, at, counts = self.distinct(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return code[at], counts


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random index vectors of all buckets: the dimensions of the entries and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (_BUCKETS, ENTRIES)), rng.choice([-1.0, 1.0], (_BUCKETS, ENTRIES))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets: sums of the index vectors of the words before and after, over all documents.

    Each task adds up a matrix of fixed size; these are added up by runs of its rows, and the sum, of fixed size too, comes to the
    driver. Rows are scaled to unit length after the mean is taken away.
    """
    dims, signs = index_vectors()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, cores, forms = Shapes(), np.zeros(CORES * DIM), np.zeros(SHAPES * DIM)
        for b in batches:
            for first, rows in slices(b.column(0), _SLICE):
                code, counts = shapes.codes(b.column(0).slice(first, rows))
                doc = np.repeat(np.arange(rows), counts)
                near = np.flatnonzero(doc[1:] == doc[:-1])
                core, shape = code >> 16, (code & 511) + CORES
                # A word's own index vector is its core's and its shape's; each neighbour gets it.
                own, sign = np.hstack([dims[core], dims[shape]]).T.copy(), np.hstack([signs[core], signs[shape]]).T.copy()
                for target, source in ((near, near + 1), (near + 1, near)):
                    place, weight = own[:, source], sign[:, source].ravel()
                    cores += np.bincount((place + core[target] * DIM).ravel(), weight, CORES * DIM)
                    forms += np.bincount((place + (shape[target] - CORES) * DIM).ravel(), weight, SHAPES * DIM)
        total = np.append(cores, forms).astype("<f4").reshape(_BUCKETS, DIM)
        chunks = range(0, _BUCKETS, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([i // _CHUNK for i in chunks], pa.int32()), pa.array([total[i : i + _CHUNK].tobytes() for i in chunks], pa.binary())], names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1)):
                sums[c] = sums.get(c, 0) + np.frombuffer(data.as_py(), "<f4").astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<f4").tobytes() for s in sums.values()], pa.binary())], names=["chunk", "sums"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(count), "chunk int, sums binary")
    got = parts.repartition("chunk").mapInArrow(add, "chunk int, sums binary").collect()
    out = np.zeros((_BUCKETS, DIM))
    for r in got:
        rows = np.frombuffer(bytes(r.sums), "<f4").reshape(-1, DIM)
        out[r.chunk * _CHUNK : r.chunk * _CHUNK + len(rows)] += rows
    out = np.sign(out) * np.log1p(np.abs(out))
    seen = np.abs(out).sum(1) > 0
    if seen.any():
        out[seen] -= out[seen].mean(0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _figures(code: np.ndarray, counts: np.ndarray, full: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the documents ``full``, which have words: figures that pooling loses (length, words' length, repeats, variety, junk)."""
    n = counts[full].astype(np.float32)
    core, length = code >> 16, code >> 9 & 127
    doc = np.repeat(np.arange(len(counts)), counts)
    same = np.r_[False, (core[1:] == core[:-1]) & (doc[1:] == doc[:-1])]
    kind = np.int32 if len(counts) * (CORES + 1) < 1 << 31 else np.int64
    both = np.sort((doc * (CORES + 1) + core).astype(kind))
    distinct = both[np.r_[True, both[1:] != both[:-1]]] // (CORES + 1)
    out = np.zeros((len(full), 5), dtype=np.float32)
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.add.reduceat(length.astype(np.float32), starts) / n / 10
    out[:, 2] = np.add.reduceat(same.astype(np.float32), starts) / n
    out[:, 3] = np.bincount(distinct, minlength=len(counts))[full] / n
    out[:, 4] = np.add.reduceat((length == 0).astype(np.float32), starts) / n
    return out


def pooled(vectors: np.ndarray, code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row a document: means of its words' core and shape vectors, and a few figures that pooling loses."""
    out = np.zeros((len(counts), 2 * DIM + 5), dtype=np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full].astype(np.float32)
    starts = (np.cumsum(counts) - counts)[full]
    core, shape = code >> 16, code & 511
    for a in range(0, len(full), 64):
        rows, z = full[a : a + 64], starts[a + 64] if a + 64 < len(full) else len(code)
        at = slice(starts[a], z)
        out[rows, :DIM] = np.add.reduceat(vectors[core[at]], starts[a : a + 64] - starts[a]) / n[a : a + 64, None]
        out[rows, DIM : 2 * DIM] = np.add.reduceat(vectors[CORES + shape[at]], starts[a : a + 64] - starts[a]) / n[a : a + 64, None]
    out[full, 2 * DIM :] = _figures(code, counts, full, starts)
    return out


@dataclass
class Network:
    """Two layers over standardised features; scores are logistic(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, decay: float = 1e-4, rate: float = 3e-3, seed: int = 3) -> Network:
    """Trains by Adam on four fifths of the rows and sets the temperature by the likelihood of the rest.

    Without rows of both labels the network scores all alike.
    """
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    d = x.shape[1]
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))))
    if len(y) < 10 or y.min() == y.max():
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-3
    net.w1, net.w2 = rng.normal(0, 1 / np.sqrt(d), (d, hidden)), rng.normal(0, 1 / np.sqrt(hidden), hidden)
    order = rng.permutation(len(y))
    held, kept = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for epoch in range(epochs):
        kept = rng.permutation(kept)
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(kept), batch):
            rows = kept[i : i + batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[rows]) / len(rows)
            gh = np.outer(g, params[2]) * (1 - h**2)
            grads = [z[rows].T @ gh + decay * params[0], gh.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for q, gr, (m1, m2) in zip(params, grads, moments):
                m1 *= 0.9
                m1 += 0.1 * gr
                m2 *= 0.999
                m2 += 0.001 * gr**2
                q -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, truth = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / s) - truth * logit / s) for s in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scorer(self) -> Callable[[pa.Array], Iterator[np.ndarray]]:
        """A function that gives the scores of a column of texts, in order, a run of rows at a time.

        The first layer is linear in the pooled vectors, so that it is applied to the word vectors once; a word then adds a row of
        the hidden layer's size instead of two whole vectors. The scores are those of ``network.scores(pooled(...))``.
        """
        net, shapes = self.network, Shapes()
        first = net.w1 / net.scale[:, None]
        core_rows, shape_rows = (self.vectors[:CORES] @ first[:DIM]).astype(np.float32), (self.vectors[CORES:] @ first[DIM : 2 * DIM]).astype(np.float32)
        rest = net.b1 - net.mean @ first

        def run(column: pa.Array) -> Iterator[np.ndarray]:
            for at, rows in slices(column, _SLICE):
                code, place, counts = shapes.distinct(column.slice(at, rows))
                hidden = np.tile(rest, (rows, 1))
                full = np.flatnonzero(counts)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    words = core_rows[code >> 16] + shape_rows[code & 511]
                    hidden[full] += np.add.reduceat(words[place], starts) / counts[full, None]
                    hidden[full] += _figures(code[place], counts, full, starts) @ first[2 * DIM :]
                logits = np.tanh(hidden) @ net.w2 + net.b2
                yield 1 / (1 + np.exp(-np.clip(logits / net.temperature, -40, 40)))

        return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", allowed: Column | None = None, limit: int = 20_000) -> QualityModel:
    """Word vectors come from all documents, the network from at most ``limit`` labelled rows, the documented bound."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            for first, n in slices(b.column(1), _SLICE):
                rows = pooled(shared.value, *shapes.codes(b.column(1).slice(first, n)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary()), b.column(2).slice(first, n)], names=["doc_id", "x", "label"])

    sample = labelled(docs, labels, label_col, F.lit(True) if allowed is None else allowed, limit)
    rows = sample.mapInArrow(frugal(features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary, label int")
    got = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("x", "label").toArrow().to_pydict()
    x = np.array([np.frombuffer(r, "<f4") for r in got["x"]]).reshape(-1, 2 * DIM + 5)
    order = np.lexsort([*x.T, got["label"]])  # the fit depends on the rows alone, not on the tasks they come from
    return QualityModel(vectors, fit_network(x[order], np.array(got["label"], dtype=np.int64)[order]))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *scores(b.column(1))]), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, score double")


def at_least(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``least``; null and empty texts are scored, too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passing() -> Callable[[pa.Array], np.ndarray]:
        scores = shared.value.scorer()
        return lambda texts: np.concatenate([np.zeros(0), *scores(texts)]) >= least

    return rows_where(docs, passing)


#: Documents whose score reaches this are predicted good.
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``: trained on rows whose fold of 5 is not 0, applied to all.

    A null id counts as not held out and is never learnt from; repeated ids are rows like any other, of which at most one text is
    learnt from; null and empty texts are scored as texts without words; other columns are ignored, whatever their names; without
    rows there are none in the result, and without labels of both kinds all rows score alike.
    """
    model = train(docs, labels, "quality", fold("doc_id", 5) != 0)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
