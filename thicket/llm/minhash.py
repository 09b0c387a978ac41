"""MinHash near-dedup with b-bit signatures; links are confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordCache, distinct_words, frugal, gather, mix, slices, word_hash
from .components import components, forest

#: Hash functions, rows of a band, and low bits kept of each minimum. 32 bands of 4 miss a pair at 0.8 once in 2 * 10**7.
HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
#: Pairs are confirmed on full sets if the estimate reaches the threshold less six standard errors of the estimate.
_WIDTH = 6
#: Members of a key up to which pairs are listed; beyond, members of a group from which on it has chunks of its own, members of a
#: chunk of signatures and of a tile of full sets.
FEW, FAMILY, CHUNK, TILE = 16, 512, 2048, 512
_CHUNK = 4096


class Shingles:
    """Sets of hashed word shingles; words are runs of bytes other than ASCII blanks, with A-Z lower-cased."""

    def __init__(self, size: int = 2):
        self.size = size
        self.known = WordCache(word_hash)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text the sorted distinct 64-bit hashes of its shingles; a shorter text has its whole sequence as one."""
        words, at, counts = distinct_words(pc.ascii_lower(pc.fill_null(texts, "")), pc.ascii_split_whitespace)
        h = np.array(self.known.of(words), dtype=np.int64)[at].view(np.uint64)
        whole, edges = self._combined(h, self.size), np.append(0, np.cumsum(counts))
        for a, n in zip(edges.tolist(), counts.tolist()):
            yield np.unique(whole[a : a + n - self.size + 1] if n >= self.size else self._combined(h[a : a + n], n))

    @staticmethod
    def _combined(h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        if not 0 < n <= len(h):
            return np.zeros(0, dtype=np.uint64)
        x = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            x = mix(x + h[i : len(h) - n + 1 + i])
        return x


_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = _RNG.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _CHUNK):
        low = np.minimum(low, (x[i : i + _CHUNK, None] * _MULTIPLY + _ADD).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    rows = low.reshape(BANDS, ROWS).T.astype(np.uint64)
    return mix((rows * _BAND).sum(axis=0, dtype=np.uint64) ^ _SALT).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    per = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


WORDS = HASHES * BITS // 64


def estimate(a: str, b: str):
    """Similarity from two packed signatures: the share of equal groups of bits, less that of chance collisions."""
    low = 0
    for i in range(0, 64, BITS):
        low |= 1 << i
    low -= 1 << 64 if low >> 63 else 0
    unequal = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(low)))
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def signatures(docs: DataFrame, size: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``cls`` (128-bit hash of the set, null if it is empty), ``bands``, ``s0``...: the packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for b in batches:
            n, cls, bands, sig = [], [], [], []
            for x in (x for first, rows in slices(b.column(1)) for x in shingles.each(b.column(1).slice(first, rows))):
                n.append(len(x))
                if len(x):
                    low = minima(x)
                    cls.append(xxhash.xxh3_128_digest(x.tobytes()))
                    bands.append(band_keys(low))
                    sig.append(packed(low))
                else:
                    cls.append(None)
                    bands.append(None)
                    sig.append(np.zeros(WORDS, dtype=np.int64))
            sig = np.array(sig, dtype=np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(sig[:, i]) for i in range(WORDS))], names=names)

    names = ["doc_id", "n_shingles", "cls", "bands", *(f"s{i}" for i in range(WORDS))]
    schema = "doc_id long, n_shingles long, cls binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``items``, the full set, of the classes in ``wanted`` (``node``, ``rep``, ``cls``), made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for b in batches:
            nodes, sets = [], []
            found = (x for first, rows in slices(b.column(2)) for x in shingles.each(b.column(2).slice(first, rows)))
            for node, cls, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found):
                if xxhash.xxh3_128_digest(x.tobytes()) == cls:  # else another row with this id
                    nodes.append(node)
                    sets.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(wanted.select("node", "rep", "cls"), "rep").select("node", "cls", "text")
    return rows.mapInArrow(frugal(run), "node long, items array<long>").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of at least ``threshold``, directly or through others.

    Returns one row a row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the group), ``kept`` (id = component_id).
    Rows with equal sets are one class; classes that share a band key are candidates; candidates whose b-bit estimate is not
    clearly too low are confirmed on full sets. Within a band key the classes are first compared with one head each, which joins
    most. Afterwards all pairs that share a key but are not yet in one group are compared, so nothing is capped: those of small
    keys one by one, all others by chunks of signatures and then, as far as the estimate leaves them possible, by tiles of full
    sets, which give forests of their links and never a list of pairs. Rows without words are linked with nothing; rows that share an id are one document; rows without
    an id have no component and are kept; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(signatures(docs, size, id_col, text_col), "signatures")
    sig = [f"s{i}" for i in range(WORDS)]
    known = rows.where("cls is not null and doc_id is not null")
    least = known.groupBy("cls").agg(F.min(F.struct("doc_id", "n_shingles", *sig, "bands")).alias("x"))
    classes = scratch.keep(least.select(F.monotonically_increasing_id().alias("node"), "cls", F.col("x.doc_id").alias("rep"), *(f"x.{c}" for c in ("n_shingles", *sig, "bands"))), "classes")
    info = classes.select("node", F.struct("n_shingles", *sig).alias("i"))
    bands = classes.select("node", F.explode("bands").alias("key"))

    margin = _WIDTH * float(np.sqrt(_variance(threshold)))
    n1, n2 = F.col("x.n_shingles"), F.col("y.n_shingles")
    close = (F.least(n1, n2) >= threshold * F.greatest(n1, n2)) & (estimate("x", "y") >= threshold - margin)

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (``a``, ``b``), those that size and estimate leave possible."""
        with_a = pairs.join(info.select(F.col("node").alias("a"), F.col("i").alias("x")), "a")
        return with_a.join(info.select(F.col("node").alias("b"), F.col("i").alias("y")), "b").where(close).select("a", "b", estimate("x", "y").alias("e"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "rep", "cls"), "node")
        sets = scratch.keep(shingle_sets(docs, wanted, size, id_col, text_col), f"sets-{name}")
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        common = F.size(F.array_intersect("x", "y"))
        linked = common * 100 >= F.lit(round(threshold * 100)) * (F.size("x") + F.size("y") - common)
        out = scratch.keep(both.where(linked).select("a", "b"), f"links-{name}")
        scratch.drop(sets)
        scratch.free_shuffles()
        return out

    # Band keys of one class alone join nothing. The head of a key is its member with most company over all of its keys: in a
    # group made from one text that is the text itself, which its copies resemble more than each other.
    counts = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    multi = scratch.keep(bands.join(counts, "key").select("key", "node", "n"), "shared-keys")
    scratch.free_shuffles()
    company = F.sum("n").over(Window.partitionBy("node")).alias("company")
    heads = multi.select("key", "node", company).groupBy("key").agg(F.max_by("node", F.struct("company", F.negate("node").alias("node"))).alias("head"))
    near_head = multi.join(heads, "key").where("head != node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    stars = scratch.keep(likely(near_head), "stars")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    best = stars.select("e", ends.alias("p")).groupBy("p.x").agg(F.max_by("p.y", F.struct("e", F.negate("p.y").alias("y"))).alias("y"))
    best = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = confirmed(scratch.keep(best, "best"), "first")
    # Rows that share an id but not a set are one document.
    shared = known.groupBy("doc_id").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2")).where("c1 != c2").select("doc_id")
    same = known.join(shared, "doc_id").select("doc_id", "cls").join(classes.select("cls", "node"), "cls")
    same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    links = links.unionAll(same)

    first = components(scratch, links)
    grouped = multi.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("n")).where("g1 != g2").select("key", "n")
    members = scratch.keep(grouped.join(mixed, "key"), "mixed")
    small = members.where(F.col("n") <= FEW).join(info, "node").select("key", "group", "node", "i")
    x, y = (small.select("key", *(F.col(c).alias(f"{c}_{k}" if c != "i" else k) for c in ("group", "node", "i"))) for k in "xy")
    few = x.join(y, "key").where((F.col("node_x") < F.col("node_y")) & (F.col("group_x") != F.col("group_y")) & close)
    few = few.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    few = scratch.keep(few, "few")
    found = confirmed(few, "rest").unionAll(_by_tiles(scratch, members.where(F.col("n") > FEW), classes, lambda wanted: shingle_sets(docs, wanted, size, id_col, text_col), threshold, margin))
    links = scratch.keep(links.unionAll(found), "all-links")

    final = components(scratch, links)
    scratch.only(rows, classes, final)
    group = classes.join(final, "node", "left").select("cls", "rep", F.coalesce("component", "node").alias("group"))
    smallest = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = group.join(smallest, "group").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(of_class, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _by_tiles(scratch: Scratch, members: DataFrame, classes: DataFrame, sets_of, threshold: float, margin: float) -> DataFrame:
    """Confirmed links across groups within keys that have many members, as forests: ``a``, ``b``.

    The members of a key are dealt to chunks of about ``CHUNK``, those of a large group to chunks of its own. Chunks meet in pairs,
    but for two chunks of the same group; what comes of a pair is no pairs of members, but the members that some pair needs which
    size and estimate leave possible, by tiles of at most ``TILE`` a side. Their full sets are fetched, and the pairs that are still
    possible are confirmed tile by tile. A pair that shares several keys is looked at in the first of them.
    """
    of_group = members.groupBy("key", "group").agg(F.count("*").alias("of_group"))
    pooled = of_group.where(F.col("of_group") <= FAMILY).groupBy("key").agg(F.sum("of_group").alias("rest"))
    own = F.xxhash64("group", F.pmod(F.xxhash64("node"), F.ceil(F.col("of_group") / CHUNK)), F.lit("own"))
    chunk = F.when(F.col("of_group") > FAMILY, own).otherwise(F.xxhash64(F.pmod(F.xxhash64("group"), F.ceil(F.col("rest") / CHUNK)), F.lit("pooled")))
    sig = [f"s{i}" for i in range(WORDS)]
    dealt = members.join(of_group, ["key", "group"]).join(pooled, "key", "left").select("key", chunk.alias("chunk"), "group", "node")
    dealt = dealt.join(classes.select("node", "n_shingles", *sig, "bands"), "node")

    def pack(t: pa.Table) -> pa.Table:
        group = t.column("group").to_numpy()
        columns = {"nodes": t.column("node").to_numpy(), "groups": group, "sizes": t.column("n_shingles").to_numpy(), "sigs": np.stack([t.column(c).to_numpy() for c in sig], axis=1), "bands": np.array(t.column("bands").to_pylist(), dtype=np.int64)}
        return pa.table({"key": t.column("key")[:1], "chunk": t.column("chunk")[:1], "lo": [group.min()], "hi": [group.max()], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}})

    packs = scratch.keep(dealt.groupBy("key", "chunk").applyInArrow(pack, "key long, chunk long, lo long, hi long, nodes binary, groups binary, sizes binary, sigs binary, bands binary"), "chunks")
    one = packs.select("key", F.col("chunk").alias("c1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = packs.select("key", F.col("chunk").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = one.join(two, "key").where("c1 <= c2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").select("key", "c1", "c2")
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("chunk"))

    def survivors(t: pa.Table) -> pa.Table:
        by = {r["chunk"]: r for r in t.to_pylist()}
        key, c1, c2 = (t.column(c)[0].as_py() for c in ("key", "c1", "c2"))
        left, right = (_Members(*(np.frombuffer(by[c][k], np.int64) for k in ("nodes", "groups", "sizes", "sigs", "bands"))) for c in (c1, c2))
        out: list[tuple[int, int, int, np.ndarray]] = []
        for i, a in enumerate(range(0, len(left.node), TILE)):
            for j, b in enumerate(range(0, len(right.node), TILE)):
                if c1 == c2 and j < i:
                    continue
                x, y = left.part(slice(a, a + TILE)), right.part(slice(b, b + TILE))
                u, v = x.possible(y, key, threshold, margin)
                out += [(i, j, side, m.part(np.unique(w))) for side, m, w in ((0, x, u), (1, y, v)) if len(w)]
        rows = [len(m.node) for *_, m in out]
        tile = {name: np.repeat(np.array([o[k] for o in out], dtype=np.int32), rows) for k, name in enumerate(("t1", "t2", "side"))}
        total = sum(rows)
        return pa.table({"key": np.full(total, key), "c1": np.full(total, c1), "c2": np.full(total, c2), **tile, **{c: np.concatenate([np.zeros(0, np.int64), *(getattr(m, c) for *_, m in out)]) for c in ("node", "group")}})

    tile = ["key", "c1", "c2", "t1", "t2"]
    asked = sides.join(packs, ["key", "chunk"]).groupBy("key", "c1", "c2").applyInArrow(survivors, "key long, c1 long, c2 long, t1 int, t2 int, side int, node long, group long")
    asked = scratch.keep(asked, "possible")
    wanted = asked.select("node").distinct().join(classes.select("node", "rep", "cls"), "node")
    sets = scratch.keep(sets_of(wanted).join(classes.select("node", "n_shingles", *sig, "bands"), "node"), "sets-tiles")
    rows = asked.join(sets, "node")

    def confirm(t: pa.Table) -> pa.Table:
        both = _Members(*(t.column(c).to_numpy() for c in ("node", "group", "n_shingles")), np.stack([t.column(c).to_numpy() for c in sig], axis=1), np.array(t.column("bands").to_pylist(), dtype=np.int64))
        side = t.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u, v = both.part(left).possible(both.part(right), t.column("key")[0].as_py(), threshold, margin)
        return _confirmed_links(both.node, t.column("items").combine_chunks(), left[u], right[v], threshold)

    return scratch.keep(rows.groupBy(*tile).applyInArrow(confirm, "a long, b long"), "tile-links")


@dataclass
class _Members:
    """Members of a key: node, group, size of the set, packed signature and band keys, a row each."""

    node: np.ndarray
    group: np.ndarray
    size: np.ndarray
    sig: np.ndarray
    bands: np.ndarray

    def __post_init__(self):
        self.sig, self.bands = self.sig.reshape(-1, WORDS).view(np.uint64), self.bands.reshape(-1, BANDS)

    def part(self, at) -> _Members:
        return _Members(self.node[at], self.group[at], self.size[at], self.sig[at].view(np.int64), self.bands[at])

    def possible(self, other: _Members, key: int, threshold: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (by row) across groups that size and estimate leave possible and whose first common key this is."""
        low, chance = np.uint64(sum(1 << i for i in range(0, 64, BITS))), 2.0**-BITS
        x = self.sig[:, None, :] ^ other.sig[None, :, :]
        folded = x
        for k in range(1, BITS):
            folded = folded | (x >> np.uint64(k))
        unequal = np.bitwise_count(folded & low).sum(axis=2, dtype=np.int64)
        e = ((1 - unequal / HASHES) - chance) / (1 - chance)
        a, b = self.size[:, None], other.size[None, :]
        i, j = np.nonzero((e >= threshold - margin) & (self.group[:, None] != other.group[None, :]) & (np.minimum(a, b) >= threshold * np.maximum(a, b)))
        first = np.empty(len(i), dtype=bool)
        for k in range(0, len(i), 16_384):
            at = slice(k, k + 16_384)
            shared = self.bands[i[at]] == other.bands[j[at]]
            first[at] = self.bands[i[at], shared.argmax(axis=1)] == key
        return i[first], j[first]


def _confirmed_links(node: np.ndarray, sets, x: np.ndarray, y: np.ndarray, threshold: float) -> pa.Table:
    """Of pairs of rows those whose full sets are similar enough, as a forest."""
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    items, offset, percent, ends = sets.values.to_numpy(), sets.offsets.to_numpy(), round(threshold * 100), []
    known, items = np.unique(items[offset[0] : offset[-1]], return_inverse=True)
    offset = offset - offset[0]
    size = np.diff(offset)
    has = np.zeros(len(known), dtype=bool)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
        k, others = x[at[0]], y[at]
        has[items[offset[k] : offset[k + 1]]] = True
        n = size[others]
        common = np.add.reduceat(has[items[gather(offset[others].astype(np.int64), n)]].astype(np.int64), np.cumsum(n) - n)
        has[items[offset[k] : offset[k + 1]]] = False
        linked = others[common * 100 >= percent * (size[k] + n - common)]
        if len(linked):
            ends.append((np.full(len(linked), node[k]), node[linked]))
    u, v = forest(*(np.concatenate(z) for z in zip(*ends))) if ends else (node[:0], node[:0])
    return pa.table({"a": np.minimum(u, v)[u != v], "b": np.maximum(u, v)[u != v]})


def _variance(similarity: float) -> float:
    """Of the estimate, at a true similarity."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * similarity
    return equal * (1 - equal) / HASHES / (1 - chance) ** 2
