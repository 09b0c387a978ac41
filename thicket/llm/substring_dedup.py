"""Substring dedup: repeated word windows as edges of a De Bruijn graph, compacted to paths by joins and verified at their sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import Scratch, WordCache, distinct_words, frugal, gather, mix, slices, word_hash

#: Words of a window (an edge: two nodes of one word less), and of the shorter runs whose least hash picks a window's bucket.
WINDOW, SEED_WORDS = 13, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task looks at together.
BATCH = 600_000


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * _BASE + h[j : len(h) - n + 1 + j]
    return mix(out)


class WordHashes:
    """Hashes of the words of texts; words are runs of bytes other than ASCII blanks."""

    def __init__(self):
        self.known = WordCache(word_hash)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of a column of texts, and each text's number of words."""
        words, at, counts = distinct_words(texts, pc.ascii_split_whitespace)
        return np.array(self.known.of(words), dtype=np.int64)[at].view(np.uint64), counts


def _repeats(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that also occur in a document with a smaller id: which, and the first place of the edge (document, start)."""
    order = np.lexsort((start, doc, h))
    sh = h[order]
    run = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]]) if len(sh) else np.zeros(0, dtype=np.int64)
    first = np.repeat(order[run], np.diff(np.r_[run, len(sh)]))
    later = doc[order] > doc[first]
    return order[later], doc[first[later]], start[first[later]]


def compact(doc, start, n, src, at):
    """Joins path pieces end to end: (document, start, edges, source document, source start), all as arrays.

    Two pieces are one path if the second goes on, in the document and in the source, where the first ends.
    """
    order = np.lexsort((start, at - start, src, doc))
    doc, start, n, src, at = (x[order] for x in (doc, start, n, src, at))
    if not len(doc):
        return doc, start, n, src, at
    new = np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | ((at - start)[1:] != (at - start)[:-1]) | (start[1:] != (start + n)[:-1])]
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.add.reduceat(n, heads), src[heads], at[heads]


_BLOB = "bucket int, doc binary, start binary, n binary, edge binary, src binary, at binary"
_PIECES = ("doc", "start", "n", "src", "at")


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray], edges: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a bucket with the columns' values packed; ``edges`` holds ``n`` hashes for each value."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=np.int64)
    out = {"bucket": pa.array(bucket[cuts[:-1]].astype(np.int32))}
    if edges is not None:
        n = columns["n"]
        offset = (np.cumsum(n) - n)[order]
        size = n[order]
        ends = np.cumsum(size)
        edges = edges[np.repeat(offset - (ends - size), size) + np.arange(len(edges))]
        edge_cuts = np.r_[0, ends][cuts]
    for name in ("doc", "start", "n", "edge", "src", "at"):
        if name == "edge" and edges is not None:
            out[name] = pa.array([edges[a:z].tobytes() for a, z in zip(edge_cuts, edge_cuts[1:])], pa.binary())
        elif name in columns:
            col = columns[name][order].astype("<u4" if name in ("start", "at") else "<u2" if name == "n" and edges is not None else "<i8")
            out[name] = pa.array([col[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())
        else:
            out[name] = pa.array([None] * (len(cuts) - 1), pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _unpack(table: pa.Table, edges: bool) -> dict[str, np.ndarray]:
    kinds = {"doc": "<i8", "start": "<u4", "n": "<u2" if edges else "<i8", "edge": "<u8", "src": "<i8", "at": "<u4"}
    out = {}
    for name, kind in kinds.items():
        if (name == "edge") == edges or (name not in ("edge", "src", "at")):
            parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
            out[name] = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
            if name != "edge":
                out[name] = out[name].astype(np.int64)
    return out


def _least_seeds(h: np.ndarray) -> np.ndarray:
    """For each window of a row of words the least hash of its runs of ``SEED_WORDS`` words."""
    seed = _rolling(h, SEED_WORDS)
    least = seed[: len(h) - WINDOW + 1].copy()
    for j in range(1, WINDOW - SEED_WORDS + 1):
        np.minimum(least, seed[j : len(h) - WINDOW + 1 + j], out=least)
    return least


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents whose words stand one after the other: the places where a window begins, and the document of each."""
    ends, size = np.cumsum(lengths), np.maximum(lengths - WINDOW + 1, 0)
    return gather(ends - lengths, size), np.repeat(np.arange(len(lengths)), size)


def _edges_of(ids: np.ndarray, lengths: np.ndarray, h: np.ndarray, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges of some documents, in ascending order of id: those that may be first occurrences by bucket, the others as pieces."""
    places, number = _windows(lengths)
    if not len(places):
        return
    edge, least = _rolling(h, WINDOW)[places], _least_seeds(h)[places]
    doc, start = ids[number], places - (np.cumsum(lengths) - lengths)[number]
    again, src, at = _repeats(edge, doc, start)
    if len(again):
        found = compact(doc[again], start[again], np.ones(len(again), dtype=np.int64), src, at)
        # A negative number of edges: the place is the first that this task knows of.
        yield _blobs(found[0] % buckets, dict(zip(_PIECES, (*found[:2], -found[2], *found[3:]))))
    keep = np.ones(len(edge), dtype=bool)
    keep[again] = False
    edge, least, number, start = edge[keep], least[keep], number[keep], start[keep]
    if not len(edge):
        return
    # Windows of a seed that is very common are dealt out by their own hash.
    bucket = (np.where(np.isin(least, hot), edge, least) % np.uint64(buckets)).astype(np.int64)
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1)]
    heads = np.flatnonzero(new)
    n = np.diff(np.r_[heads, len(edge)])
    if n.max() >= 1 << 16:  # a run of one repeated word: parts of it go to the same bucket
        heads = np.union1d(heads, np.arange(0, len(edge), 1 << 15))
        n = np.diff(np.r_[heads, len(edge)])
    yield _blobs(bucket[heads], {"doc": ids[number[heads]], "start": start[heads], "n": n}, edge)


#: Bytes of text whose edges one bucket may have; one document in so many is looked at for common seeds, of which so many are kept.
BUCKET_BYTES, SAMPLED, HOT_SEEDS = 16_000_000, 64, 100_000


def dealing(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of buckets, which grows with the texts, and the seeds so common that one would overfill its bucket.

    The seeds are found in a sixty-fourth of the documents. They decide where an edge is looked up and nothing else: all tasks use
    the same list, so a seed that was missed makes a bucket larger but loses no edge.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for first, n in slices(b.column(0)):
                h, counts = hashes.of(b.column(0).slice(first, n))
                places, _ = _windows(counts)
                found, number = np.unique(_least_seeds(h)[places], return_counts=True) if len(places) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number)], names=["seed", "n"])

    # Words have six bytes or so: a quarter of a bucket's windows, as far as the sample goes.
    least = max(16, size // 6 // SAMPLED // buckets // 4)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(frugal(seeds), "seed long, n long")
    common = some.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "seed").limit(HOT_SEEDS)
    return buckets, np.sort(np.array([r.seed for r in common.collect()], dtype=np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, scratch: Scratch, batch: int = BATCH) -> DataFrame:
    """Runs of edges of each document that also occur in one with a smaller id: ``doc``, ``src`` and lists ``start``, ``words``, ``at``.

    Edges go to the bucket of their least seed, so that neighbours mostly stay together; an edge met in several documents of a
    task goes out once, for the smallest id, which keeps passages that very many documents share from filling one bucket. Each
    bucket finds the first place of its edges, the edge's place in the graph; neighbours with neighbouring places travel on as one.
    Edges that a task settled by itself are then traced through their source to that first place, so that an edge has only one.
    """
    buckets, hot = dealing(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, lengths, words, size = [], [], [], 0

        def flush():
            doc, length, h = np.concatenate(ids), np.concatenate(lengths), np.concatenate(words)
            order = np.argsort(doc, kind="stable")
            yield from _edges_of(doc[order], length[order], h[gather((np.cumsum(length) - length)[order], length[order])], buckets, hot)

        for b in batches:
            for first, n in slices(b.column(1)):
                h, counts = hashes.of(b.column(1).slice(first, n))
                ids.append(b.column(0).slice(first, n).to_numpy())
                lengths.append(counts)
                words.append(h)
                size += len(h)
                if size >= batch:
                    yield from flush()
                    ids, lengths, words, size = [], [], [], 0
        if ids:
            yield from flush()

    def resolve(table: pa.Table) -> pa.Table:
        out = []
        filled = table.column("edge").is_valid()
        local = _unpack(table.filter(table.column("edge").is_null()), False)
        if len(local["doc"]):
            out.append(tuple(local[c] for c in _PIECES))
        x = _unpack(table.filter(filled), True)
        if len(x["edge"]):
            doc, n = np.repeat(x["doc"], x["n"]), x["n"]
            start = np.repeat(x["start"] - (np.cumsum(n) - n), n) + np.arange(len(x["edge"]))
            again, src, at = _repeats(x["edge"], doc, start)
            out.append(compact(doc[again], start[again], np.ones(len(again), dtype=np.int64), src, at))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(5)]
        return pa.Table.from_batches([_blobs(cols[0] % buckets, dict(zip(_PIECES, cols)))]) if len(cols[0]) else _EMPTY

    def join(table: pa.Table) -> pa.Table:
        x, out = _unpack(table, False), []
        for settled in (True, False):
            at = (x["n"] > 0) == settled
            doc, start, n, src, place = compact(*(np.abs(x[c][at]) if c == "n" else x[c][at] for c in _PIECES))
            packed = _packed(doc, src, start, n + (WINDOW - 1), place)
            out.append(packed.append_column("settled", pa.array(np.full(packed.num_rows, settled))))
        return pa.concat_tables(out)

    rows = docs.where("doc_id is not null").select("doc_id", "text")
    pieces = rows.mapInArrow(frugal(scan), _BLOB).groupBy("bucket").applyInArrow(resolve, _BLOB)
    found = scratch.keep(pieces.groupBy("bucket").applyInArrow(join, f"{_SPANS}, settled boolean"), "found")
    settled = found.where("settled").drop("settled")
    known = settled.groupBy(F.col("doc").alias("source")).agg(F.collect_list(F.struct("src", "start", "words", "at")).alias("known"))
    local = found.where("not settled").drop("settled")
    traced = local.join(known, local["src"] == known["source"], "left").select(*local.columns, "known").mapInArrow(frugal(_trace), _SPANS)
    return scratch.keep(settled.unionAll(traced), "spans")


#: What a document has of a source: a row for each pair of them, with the places of all their spans.
_SPANS = "doc long, src long, start array<long>, words array<long>, at array<long>"
_LISTS = ("start", "words", "at")


def _lists(edges: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    offsets = pa.array(edges.astype(np.int32))
    return {name: pa.ListArray.from_arrays(offsets, pa.array(np.asarray(values, dtype=np.int64))) for name, values in columns.items()}


def _packed(doc: np.ndarray, src: np.ndarray, start: np.ndarray, words: np.ndarray, at: np.ndarray) -> pa.Table:
    """Spans as a row for each document and source."""
    order = np.lexsort((start, src, doc))
    doc, src = doc[order], src[order]
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
    return pa.table({"doc": doc[heads], "src": src[heads], **_lists(np.append(heads, len(doc)), {"start": start[order], "words": words[order], "at": at[order]})})


def _as_lists(spans: DataFrame) -> DataFrame:
    """Spans that come one a row, packed."""
    if isinstance(spans.schema["start"].dataType, ArrayType):
        return spans
    each = F.collect_list(F.struct(*_LISTS)).alias("x")
    return spans.groupBy("doc", "src").agg(each).select("doc", "src", *(F.col(f"x.{c}").alias(c) for c in _LISTS))


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    """A row's list of whole numbers; a list is never turned into Python objects for a whole batch."""
    item = column[i]
    return item.values.to_numpy() if item.is_valid else np.zeros(0, dtype=np.int64)


def _batch(rows: list[tuple], names: tuple[str, ...] = ("doc", "src", *_LISTS)) -> pa.RecordBatch:
    """Packed rows: a number for each plain column, then an array for each list."""
    plain = len(names) - len(_LISTS)
    cols = list(zip(*rows)) if rows else [()] * len(names)
    edges = np.append(0, np.cumsum([len(x) for x in cols[plain]])) if rows else np.zeros(1, dtype=np.int64)
    lists = _lists(edges, {n: np.concatenate(c) if rows else np.zeros(0, dtype=np.int64) for n, c in zip(names[plain:], cols[plain:])})
    return pa.RecordBatch.from_pydict({**{n: pa.array(c, pa.int64()) for n, c in zip(names, cols[:plain])}, **lists})


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans whose source is the first that a task knew of, moved to where that source's own spans say that its edges come from."""
    for b in batches:
        out: list[tuple] = []
        for i, (doc, src) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            start, words, at = (_numbers(b.column(c), i) for c in (2, 3, 4))
            begin, end, source, place = [], [], [], []
            if b.column(5)[i].is_valid:
                for k in b.column(5)[i].as_py():
                    begin += k["start"]
                    end += [x + w - (WINDOW - 1) for x, w in zip(k["start"], k["words"])]
                    place += k["at"]
                    source += [k["src"]] * len(k["start"])
            order = np.argsort(np.array(begin, dtype=np.int64), kind="stable").tolist()
            found: list[tuple[int, int, int, int]] = []  # source, start, words, place
            for s, w, here in zip(start.tolist(), words.tolist(), at.tolist()):
                move, last = s - here, here + w - (WINDOW - 1)
                for k in order:
                    lo, hi = max(here, begin[k]), min(last, end[k])
                    if lo < hi:
                        if here < lo:
                            found.append((src, here + move, lo - here + WINDOW - 1, here))
                        found.append((source[k], lo + move, hi - lo + WINDOW - 1, place[k] + lo - begin[k]))
                        here = hi
                if here < last:
                    found.append((src, here + move, last - here + WINDOW - 1, here))
            of, *columns = (np.array(c, dtype=np.int64) for c in zip(*found))
            out += [(doc, int(s), *(c[of == s] for c in columns)) for s in np.unique(of)]
        yield _batch(out)


_EMPTY = pa.table({"bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("doc", "start", "n", "edge", "src", "at")}})


def _by_source(spans: DataFrame) -> DataFrame:
    """For each source the distinct stretches asked for: ``src``, ``at``, ``words``; no more of them than pairs of its words.

    A batch names each stretch once before the shuffle.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            src = np.repeat(b.column(0).to_numpy(), size)
            at, words = (pc.list_flatten(b.column(c)).to_numpy() for c in (1, 2))
            order = np.lexsort((words, at, src))
            src, at, words = src[order], at[order], words[order]
            new = np.r_[True, (src[1:] != src[:-1]) | (at[1:] != at[:-1]) | (words[1:] != words[:-1])] if len(src) else np.zeros(0, dtype=bool)
            src, at, words = src[new], at[new], words[new]
            heads = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"src": pa.array(src[heads]), **_lists(np.append(heads, len(src)), {"at": at, "words": words})})

    named = spans.select("src", "at", "words").mapInArrow(frugal(once), "src long, at array<long>, words array<long>")
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("at", "words"))))
    return named.groupBy("src").agg(pairs.alias("asked")).select("src", F.col("asked.at").alias("at"), F.col("asked.words").alias("words"))


def source_runs(asked: DataFrame) -> DataFrame:
    """The edges of each source, as maximal runs: ``src``, ``at``, ``n``."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for i, src in enumerate(b.column(0).to_pylist()):
                begin, end = _union(_numbers(b.column(1), i), _numbers(b.column(2), i))
                out += zip([src] * len(begin), begin.tolist(), (end - begin).tolist())
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["src", "at", "n"])

    return asked.select("src", "at", "words").mapInArrow(union, "src long, at long, n long")


def _union(at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of edges that make up some stretches of words: first edge, and the one after the last."""
    order = np.argsort(at, kind="stable")
    begin, end = at[order], np.maximum.accumulate((at + words - (WINDOW - 1))[order])
    heads = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return begin[heads], end[np.r_[heads[1:], len(end)] - 1]


def compacted(scratch: Scratch, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Compacts the De Bruijn graph of the repeated edges: ``src``, ``at``, ``n``, ``unitig``, ``offset``.

    Nodes are runs of 12 words, the edges those windows that occur in several documents; each edge has one place, that of its
    first occurrence, so that its number of places is a node's degree. Runs of edges in a source are cut at nodes with several
    ways in or out, by a join of the nodes' places with their degrees. Where a node has one way in, which ends a run, and one way
    out, which begins another, the two are one path; such chains are followed by joins that double the distance each time. A row is
    the part of a path that stands in one source; ``offset`` counts the path's edges before it.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for first, rows in slices(b.column(1)):
                h, counts = hashes.of(b.column(1).slice(first, rows))
                if len(h) < WINDOW:
                    continue
                node, edges = _rolling(h, WINDOW - 1).view(np.int64), np.append(0, np.cumsum(counts))
                out = {c: [] for c in ("src", "pos", "node", "ins", "outs")}
                for i in range(rows):
                    begin, end = _union(_numbers(b.column(2), first + i), _numbers(b.column(3), first + i))
                    fits = np.minimum(end, counts[i] - (WINDOW - 1)) > begin  # else another row with this id
                    begin, end = begin[fits], np.minimum(end, counts[i] - (WINDOW - 1))[fits]
                    pos = gather(begin, end - begin + 1).astype(np.int64)
                    out["src"].append(np.full(len(pos), b.column(0)[first + i].as_py()))
                    out["pos"].append(pos)
                    out["node"].append(node[edges[i] + pos])
                    out["ins"].append((~np.isin(pos, begin)).astype(np.int8))
                    out["outs"].append((~np.isin(pos, end)).astype(np.int8))
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in out.items()})

    places = scratch.keep(sources.mapInArrow(frugal(nodes), "src long, pos long, node long, ins byte, outs byte"), "nodes")
    degrees = places.groupBy("node").agg(F.sum("ins").alias("in_degree"), F.sum("outs").alias("out_degree"), F.count("*").alias("places")).where("places > 1")
    shared = scratch.keep(places.join(degrees, "node"), "shared-nodes")
    scratch.drop(places)
    cuts = shared.where("ins = 1 and outs = 1").select("src", "pos")
    bounds = runs.select("src", F.col("at").alias("pos"), F.lit(1).alias("open")).unionAll(runs.select("src", (F.col("at") + F.col("n")).alias("pos"), F.lit(0).alias("open")))
    # A cut within a run goes on; at a run's ends its own bounds tell.
    bounds = bounds.unionAll(cuts.select("src", "pos", F.lit(2).alias("open"))).groupBy("src", "pos").agg(F.min("open").alias("open"))
    after = Window.partitionBy("src").orderBy("pos")
    paths = bounds.select("src", F.col("pos").alias("at"), (F.lead("pos").over(after) - F.col("pos")).alias("n"), "open").where("open > 0")
    paths = scratch.keep(paths.select(F.monotonically_increasing_id().alias("path"), "src", "at", "n"), "paths")
    # Simple nodes: one way in, the end of one run, and one way out, the start of another.
    simple = shared.where("in_degree = 1 and out_degree = 1 and places = 2").select("src", "pos", "node", "ins")
    ended = simple.where("ins = 1").select("node", "src", F.col("pos").alias("end")).join(paths.select("src", (F.col("at") + F.col("n")).alias("end"), F.col("path").alias("up"), "n"), ["src", "end"])
    begun = simple.where("ins = 0").select("node", "src", F.col("pos").alias("at")).join(paths.select("src", "at", "path"), ["src", "at"])
    links = scratch.keep(ended.select("node", "up", "n").join(begun.select("node", "path"), "node").select("path", "up", "n").where("path != up"), "links")
    return paths.join(_chains(scratch, links), "path", "left").select("src", "at", "n", F.coalesce("unitig", "path").alias("unitig"), F.coalesce("offset", F.lit(0)).alias("offset"))


def _chains(scratch: Scratch, links: DataFrame) -> DataFrame:
    """For links from a path to the one before it (``path``, ``up``, and the latter's edges ``n``): the first path of the chain and
    the edges before. Each round doubles the distance; a ring, which has no first path, is left open: its paths stay by themselves."""
    state = links.select("path", "up", F.col("n").cast("long").alias("offset"))
    total, reach = state.count(), 1
    while reach < 2 * total:
        above = state.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("offset").alias("more"))
        state = scratch.keep(state.join(above, "up", "left").select("path", F.coalesce("up2", "up").alias("up"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "chains")
        reach *= 2
        if not state.join(state.select(F.col("path").alias("up")), "up", "left_semi").take(1):
            break
    return state.join(state.select(F.col("path").alias("up")), "up", "left_anti").select("path", F.col("up").alias("unitig"), "offset")


#: Columns that ``remove_repeats`` makes; an input column of such a name gives way to it.
MADE = ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, batch: int = BATCH) -> DataFrame:
    """Removes every word covered by a window of 13 words that also starts in a document with a smaller id.

    Words are runs of bytes other than ASCII blanks. Returns one row a row: ``doc_id``, ``n_words``, ``n_removed``,
    ``kept_sha256`` (of the kept words joined by one space) and, with ``with_text``, ``spans`` (start and length in words),
    ``kept_text`` (the kept words so joined, or the text as it was if none is removed) and the other columns, but for those that
    have the name of one of these. Null texts have no words (``kept_text`` null); rows without an id neither lose words nor count
    as a source; rows that share an id do not remove each other's words; an empty table gives an empty result. Repeated edges
    are found by hashes and compacted to paths (``compacted``); what a document has of a path removes words only where the words
    at its coordinates are those at the path's coordinates in its source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = _as_lists(repeated_spans(rows, scratch, batch))
    scratch.free_shuffles()
    asked = scratch.keep(_by_source(spans), "asked")
    # Joined by sorting at any size, as all joins here that carry texts.
    sources = scratch.keep(rows.join(asked.hint("merge"), rows["doc_id"] == asked["src"]).select("src", "text", "at", "words"), "sources")
    paths = compacted(scratch, sources, source_runs(asked))
    paths = paths.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("paths")).select("src", F.col("paths.at").alias("path"), F.col("paths.n").alias("edges"))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each span has of each path, by the source's coordinates."""
        for b in batches:
            out: list[tuple] = []
            for i, (doc, src) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                start, words, at, path, edges = (_numbers(b.column(c), i) for c in range(2, 7))
                end, path_end = at + words - (WINDOW - 1), path + edges
                # Paths of a source follow each other: those that meet a span are a run of them.
                first, last = np.searchsorted(path_end, at, side="right"), np.searchsorted(path, end, side="left")
                k, span = gather(first, np.maximum(last - first, 0)), np.repeat(np.arange(len(at)), np.maximum(last - first, 0))
                begin = np.maximum(at[span], path[k])
                out.append((doc, src, start[span] + begin - at[span], np.minimum(end[span], path_end[k]) - begin + (WINDOW - 1), begin))
            yield _batch(out)

    parts = scratch.keep(spans.join(paths, "src").select(*spans.columns, "path", "edges").mapInArrow(frugal(intersect), _SPANS), "parts")
    scratch.free_shuffles()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, (src, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()))):
                words = (text.as_py() or b"").split()
                asked = [(a, n) for a, n in zip(_numbers(b.column(2), i).tolist(), _numbers(b.column(3), i).tolist()) if a + n <= len(words)]
                rows.append((src, [a for a, _ in asked], [n for _, n in asked], [xxhash.xxh3_128_digest(b" ".join(words[a : a + n])) for a, n in asked]))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["src", "p_at", "p_words", "digest"])

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part the digest of the words at its source's coordinates."""
        for b in batches:
            rows: list[tuple] = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                start, words, at, p_at, p_words = (_numbers(b.column(c), i).tolist() for c in (2, 3, 4, 5, 6))
                wanted, proven, digest = set(zip(at, words)), {}, b.column(7)[i].values
                for k, key in enumerate(zip(p_at, p_words)):
                    if key in wanted:
                        proven[key] = digest[k].as_py()
                own = [(s, n, proven[a, n]) for s, n, a in zip(start, words, at) if (a, n) in proven]
                rows.append((doc, *map(list, zip(*own))) if own else (doc, [], [], []))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "start", "words", "digest"])

    named = _by_source(parts).hint("merge")
    lists = "array<long>, {} array<long>, digest array<binary>"
    proof = scratch.keep(sources.select("src", "text").join(named, "src").select("src", "text", "at", "words").mapInArrow(frugal(digests), "src long, p_at " + lists.format("p_words")), "proof")
    claimed = parts.join(proof, "src").select(*parts.columns, "p_at", "p_words", "digest").mapInArrow(frugal(claim), "doc long, start " + lists.format("words"))
    zipped = F.flatten(F.collect_list(F.arrays_zip("start", "words", "digest"))).alias("claims")
    claims = scratch.keep(claimed.groupBy("doc").agg(zipped), "claims")
    scratch.only(claims)
    scratch.free_shuffles()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
            for text, claims in zip(b.column(1).cast(pa.binary()), b.column(2)):
                text, claims = text.as_py(), claims.as_py()
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for c in claims or ():
                    a, n = c["start"], c["words"]
                    if a + n <= len(words) and xxhash.xxh3_128_digest(b" ".join(words[a : a + n])) == c["digest"]:
                        gone[a] += 1
                        gone[a + n] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                changed = bool(covered.any())
                kept = b" ".join([words[i] for i in np.flatnonzero(~covered)] if changed else words)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(covered.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0])).reshape(-1, 2)
                    out["spans"].append([{"start": a, "words": z - a} for a, z in edges.tolist()])
                    out["kept_text"].append(kept.decode() if changed else text and text.decode())
            arrays = [b.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            if with_text:
                arrays += [pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), pa.array(out["kept_text"], pa.string())]
                arrays += [b.column(i) for i in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(MADE[: 6 if with_text else 4]) + b.schema.names[3:] * with_text)

    extra = [c for c in docs.columns if c not in (id_col, text_col, *MADE)] if with_text else []
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(extra)))
    joined = whole.join(claims.hint("merge"), whole["doc_id"] == claims["doc"], "left").select("doc_id", "text", "claims", *(f"x_{i}" for i in range(len(extra))))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", spans array<struct<start: long, words: long>>, kept_text string" + "".join(f", x_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    out = joined.mapInArrow(frugal(apply), schema)
    return out.toDF(*MADE[: 6 if with_text else 4], *extra)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The columns of ``docs``, in their order and whatever their names, with the kept text in place of the text.

    ``length_col`` names a column that holds the text's length, which is set anew where words are gone. See ``remove_repeats``.
    """
    names = docs.columns
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)), F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    out = remove_repeats(numbered, "key", "body", with_text=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text"))
    columns = {text_col: lambda c: F.col("kept_text"), length_col: lambda c: F.coalesce(length.cast(docs.schema[length_col].dataType), F.col(c))}
    return out.select(*(columns.get(c, F.col)(f"c_{i}").alias(c) for i, c in enumerate(names)))
