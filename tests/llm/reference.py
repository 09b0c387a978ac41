"""Plain versions of the classifiers: loops over words and sentences, without Arrow, slices, caches or Spark."""

import re
from collections import Counter

import numpy as np
import xxhash

from thicket.llm import quality, toxicity

EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def quality_codes(text):
    return [quality.Shapes.code(w) for w in (text or "").split()]


def quality_vectors(texts):
    """Sums of the neighbours' index vectors, word by word, made relative, centred and scaled as the operator states."""
    dims, signs = quality.index_vectors()
    total = np.zeros((quality.CORES + quality.SHAPES, quality.DIM))
    for t in texts:
        codes = quality_codes(t)
        for a, b in zip(codes, codes[1:]):
            for target, source in ((a, b), (b, a)):
                for row in (target >> 16, quality.CORES + (target & 511)):
                    for word in (source >> 16, quality.CORES + (source & 511)):
                        for d, s in zip(dims[word], signs[word]):
                            total[row, d] += s
    total = np.sign(total) * np.log1p(np.abs(total))
    seen = np.abs(total).sum(1) > 0
    if seen.any():
        total[seen] -= total[seen].mean(0)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def quality_features(vectors, text):
    codes = quality_codes(text)
    if not codes:
        return np.zeros(2 * quality.DIM + 5)
    core, shape, length = [c >> 16 for c in codes], [c & 511 for c in codes], [c >> 9 & 127 for c in codes]
    n = len(codes)
    figures = [np.log1p(n), np.mean(length) / 10, sum(a == b for a, b in zip(core, core[1:])) / n, len(set(core)) / n, sum(x == 0 for x in length) / n]
    return np.concatenate([vectors[core].mean(0), vectors[[quality.CORES + s for s in shape]].mean(0), figures])


def quality_scores(rows, labels):
    """Scores of ``(id, text)`` rows by a network fitted on the labelled ids of ``labels``."""
    vectors = quality_vectors([t for _, t in rows])
    x = np.array([quality_features(vectors, t) for _, t in rows])
    at = [i for i, (d, _) in enumerate(rows) if d in labels]
    chosen, marks = x[at].astype(np.float32), np.array([labels[rows[i][0]] for i in at])
    order = np.lexsort([*chosen.T, marks])
    net = quality.fit_network(chosen[order], marks[order])
    z = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
    return 1 / (1 + np.exp(-z / net.temperature))


def sentences(text):
    """Sentences of a text as lists of words: lower-cased, stripped of punctuation; without those that have none."""
    out = []
    for line in (text or "").split("\n"):
        own = []
        for word in line.split():
            if core := EDGES.sub("", word.lower()):
                own.append(core)
            if word.endswith(toxicity._ENDS):
                out.append(own)
                own = []
        out.append(own)
    return [s for s in out if s]


def toxicity_scores(rows, labels):
    """Scores of ``(id, text)`` rows by a noisy-or over sentences, fitted on the labelled ids of ``labels``."""
    read = [sentences(t) for _, t in rows]
    known = sorted((d, i) for i, (d, _) in enumerate(rows) if d in labels)
    y = np.array([labels[d] for d, _ in known])
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    seen = {0: Counter(), 1: Counter()}
    for (_, i), label in zip(known, y):
        seen[label].update({w for s in read[i] for w in s})
    chosen = []
    for w in {*seen[0], *seen[1]}:
        a, b = seen[0][w], seen[1][w]
        share = (a + b) / len(y)
        if a + b >= 4 and abs(b / n1 - a / n0) >= 3.5 * np.sqrt(max(share * (1 - share) * (1 / n0 + 1 / n1), 1e-12)):
            chosen.append(w)
    chosen.sort(key=lambda w: xxhash.xxh64_intdigest(w))
    place = {w: k for k, w in enumerate(chosen)}
    columns = []
    for _, i in known:
        pairs = [(place[w], k) for k, s in enumerate(read[i]) for w in s if w in place]
        columns.append((np.array([p for p, _ in pairs], dtype=np.int64), np.array([k for _, k in pairs], dtype=np.int64)))
    weights, bias = toxicity.fit_columns(columns, np.array([len(read[i]) for _, i in known]), y, len(chosen))
    out = []
    for found in read:
        clean = 1.0
        for s in found:
            clean *= 1 - 1 / (1 + np.exp(-(bias + sum(weights[place[w]] for w in s if w in place))))
        out.append(1 - clean)
    return np.array(out)
