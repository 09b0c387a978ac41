"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Fixed value: the published pattern by which byte-level BPE cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts that can't be cut at single spaces and line breaks: with other white space, runs of it, or special tokens spelled out.
_UNSAFE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{2}|<\||\A[ \n]|[ \n]\z"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE file (tokenizers JSON), applied to many words at once."""

    def __init__(self, path: str, entries: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [vocab[c] for c in symbols]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        made: dict[int, int] = {}
        for (a, b), (rank, new) in self.merge.items():
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge uses a token that only a later merge makes; ranks can't be applied in ascending order")
            made.setdefault(new, rank)
        self.pair_of = [pair for pair in self.merge]
        self.new_of = [new for _, new in self.merge.values()]
        #: For each id the ids beside it that it merges with, and the ranks of these merges.
        self.rights: dict[int, dict[int, int]] = {}
        self.lefts: dict[int, dict[int, int]] = {}
        for rank, (a, b) in enumerate(self.pair_of):
            self.rights.setdefault(a, {})[b] = self.lefts.setdefault(b, {})[a] = rank
        #: The symbol of each byte and the rank of each pair of bytes, -1 without; 255, in no UTF-8, is the gap.
        self.symbol = np.array([*self.byte_id[:255], -1], dtype=np.int64)
        self.byte_rank = np.array([[self.rights.get(a, {}).get(b, -1) for b in self.symbol.tolist()] for a in self.symbol.tolist()], dtype=np.int64)
        back = {c: b for b, c in enumerate(symbols)}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.listed = {i: f"{i}," for i in self.token_bytes}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.entries = entries
        self.word_ids: dict[str, tuple[int, ...]] = {}
        self.first: dict[str, tuple[str, int, bytes]] = {}
        self.spaced: dict[str, tuple[str, int, bytes]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words, by one index over all of them.

        All words stand in one row of symbols, parted by gaps. The index maps each pair that has a rank to all its positions.
        Active ranks are taken in ascending order; each is applied at all its positions from left to right, which makes and
        breaks pairs only beside them, and the new pairs' lists join the index.
        """
        data = np.frombuffer(b"".join([w.encode() + b"\xff" for w in words]), dtype=np.uint8)
        n, ranks = len(data), self.byte_rank[data[:-1], data[1:]]
        sym, after, before = self.symbol[data].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        active, first = np.unique(ranks[places], return_index=True)
        index = {rank: part.tolist() for rank, part in zip(active.tolist(), np.split(places, first[1:]))}
        active, none = active.tolist(), {}  # in ascending order, and so a heap
        while active:
            rank = heapq.heappop(active)
            (left, right), new = self.pair_of[rank], self.new_of[rank]
            lefts, rights = self.lefts.get(new, none), self.rights.get(new, none)
            places = index.pop(rank)
            places.sort()
            for i in places:
                if sym[i] != left:
                    continue  # an earlier merge took this symbol
                j = after[i]
                if sym[j] != right:
                    continue
                sym[i], sym[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]  # before the first symbol it is the last, a gap
                if (r := lefts.get(sym[h])) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(active, r)
                if (r := rights.get(sym[k])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(active, r)
        made = np.array(sym, dtype=np.int64)
        ends = np.cumsum(made >= 0)[made == -1].tolist()
        ids = made[made >= 0].tolist()
        return [tuple(ids[a:z]) for a, z in zip([0, *ends], ends)]

    def _cut(self, pieces: list[str], lead: str) -> list[list[str]]:
        """The words of pieces with what stands before them: those after a space, which hold no white space, are cut as one text."""
        if not lead:
            return [self.words.findall(p) for p in pieces]
        words = self.words.findall(lead + lead.join(pieces)) if pieces else []
        at = [i for i, w in enumerate(words) if w[0] == lead]
        return [words[a:z] for a, z in zip(at, [*at[1:], len(words)])]

    def _ids(self, pieces: list[str], lead: str = "") -> list[list[int]]:
        cut = self._cut(pieces, lead)
        new = [w for w in {w for ws in cut for w in ws} if w not in self.word_ids]
        if len(self.word_ids) + len(new) > self.entries:
            self.word_ids.clear()
            new = list({w for ws in cut for w in ws})
        for i in range(0, len(new), 20_000):
            self.word_ids.update(zip(new[i : i + 20_000], self.encode_words(new[i : i + 20_000])))
        return [[i for w in ws for i in self.word_ids[w]] for ws in cut]

    def encode(self, text: str) -> list[int]:
        """Ids of one text; special tokens spelled out in it are taken as such, as the tokenizers library does."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._ids([part])[0]
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return "".join(map(self.listed.__getitem__, ids)), len(ids), self.decode_bytes(ids)

    def _known(self, pieces: list[str], cache: dict, lead: str) -> list[tuple[str, int, bytes]]:
        try:
            return list(map(cache.__getitem__, pieces))
        except KeyError:
            wanted = set(pieces)
            missing = [p for p in wanted if p not in cache]
            if len(self.first) + len(self.spaced) + len(missing) > self.entries:
                self.first.clear()
                self.spaced.clear()
                missing = list(wanted)
            for p, ids in zip(missing, self._ids(missing, lead)):
                cache[p] = self._entry(ids)
            return list(map(cache.__getitem__, pieces))

    def encode_batch(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text the entries (decimal ids, their number, bytes they decode to) of its pieces, in order.

        Texts are cut at single spaces and line breaks, where words always end, so that repeated pieces are looked up; texts with
        other white space, or with special tokens spelled out, are encoded whole.
        """
        line_break = self._entry(self._ids(["\n"])[0])
        plans, heads, rest = [], [], []
        unsafe = pc.match_substring_regex(pa.array(texts, pa.string()), _UNSAFE).to_pylist()
        for text, whole in zip(texts, unsafe):
            if whole:
                plans.append(self._entry(self.encode(text)))
                continue
            counts = []
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                heads.append(head)
                rest += tail
                counts.append(len(tail))
            plans.append(counts)
        heads, rest = self._known(heads, self.first, ""), self._known(rest, self.spaced, " ")
        out, h, r = [], 0, 0
        for plan in plans:
            if isinstance(plan, tuple):
                out.append([plan])
                continue
            entries = []
            for n in plan:
                entries.append(heads[h])
                entries += rest[r : r + n]
                entries.append(line_break)
                h, r = h + 1, r + n
            out.append(entries[:-1])
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PairIndexBpe:
    """One codec a worker process and file."""
    return PairIndexBpe(path)


#: The columns that ``encode_decode`` can return.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_BATCH_CHARS = 1_000_000


def encode_decode(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids again; one row a row, with the id and the ``OUTPUTS`` asked for.

    Null texts count as empty: no ids, and an empty decoded text. Null or repeated ids are rows like any other; other columns are
    ignored; without rows there are none in the result. ``ids_sha256`` is over the decimal ids joined by commas,
    ``decoded_sha256`` over the decoded text in UTF-8. Nothing is shuffled; a worker holds about a million characters at a time
    and a cache of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for b in batches:
            texts, at = b.column(1), 0
            while at < b.num_rows:
                part, chars, begin = [], 0, at
                while at < b.num_rows and chars < _BATCH_CHARS:
                    part.append(texts[at].as_py() or "")
                    chars += len(part[-1])
                    at += 1
                cols: dict[str, list] = {name: [] for name in outputs}
                for entries in bpe.encode_batch(part):
                    ids, counts, data = zip(*entries) if entries else ((), (), ())
                    listed = "".join(ids)[:-1]
                    decoded = b"".join(data)
                    if "decoded" in cols or "decoded_sha256" in cols:
                        decoded = decoded.decode("utf-8", "replace")
                    for name, column in cols.items():
                        if name == "n_tokens":
                            column.append(sum(counts))
                        elif name == "ids":
                            column.append([int(i) for i in listed.split(",")] if listed else [])
                        elif name == "decoded":
                            column.append(decoded)
                        else:
                            column.append(hashlib.sha256((listed if name == "ids_sha256" else decoded).encode()).hexdigest())
                kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
                arrays = [b.column(0).slice(begin, at - begin), *(pa.array(c, kinds[OUTPUTS[n]]) for n, c in cols.items())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *cols])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n} {OUTPUTS[n]}" for n in outputs)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def decode_ids(ids: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes arrays of ids: the id column and ``text``; null arrays give a null text, bytes that aren't UTF-8 U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(frugal(run), f"doc_id {ids.schema[id_col].dataType.simpleString()}, text string")
