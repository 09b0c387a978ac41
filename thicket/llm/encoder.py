"""Token ids from the installed tokenizers library, with each distinct piece of a batch of texts encoded once."""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_symbols
from .common import WordCache, gather

#: Letters of which none composes with another or changes its number of code points in lower case, then ASCII punctuation but for
#: apostrophes and underscores: both kinds of tokenizer end a word between the two, and nowhere within either.
_PLAIN = r"\A(?P<line>\n?)(?P<body>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-^`{-~]*)\z"
#: Texts whose blanks bear on the ids of a byte-level tokenizer: other than single spaces and line breaks between words.
_BLANKS = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n]{2}|\A[ \n]|[ \n]\z"


#: Bytes that the words kept with their ids may take, and twice those of one generation of the cache of other pieces.
CACHE = 20_000_000


class WordTable:
    """Ids of words as arrays: words are looked up many at a time, and those not seen for longest give way at a bound in bytes."""

    #: Bytes of a word's place, number of ids, last use and offset.
    _ROW = 28

    def __init__(self, ids_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.ids_of, self.limit, self.now = ids_of, limit, 0
        self.words = pa.array([], pa.string())
        self.flat, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words, and where in them each of the distinct words given begins and how many it has."""
        self.now += 1
        at = pc.index_in(words, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not known.all():
            new = words.filter(pa.array(~known))
            at[~known] = len(self.words) + np.arange(len(new))
            flat, size = self.ids_of(new.to_pylist())
            self.words = pa.concat_arrays([self.words, new])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.append(self.size, size)
            self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
        self.used[at] = self.now
        flat, start = self.flat, np.cumsum(self.size) - self.size
        found = flat, start[at], self.size[at]
        cost = pc.binary_length(self.words).to_numpy(zero_copy_only=False) + 4 * self.size + self._ROW
        if cost.sum() > self.limit:
            newest = np.argsort(-self.used, kind="stable")
            kept = np.sort(newest[np.cumsum(cost[newest]) <= self.limit // 2])
            self.flat = flat[gather(start[kept], self.size[kept])]
            self.words, self.size, self.used = self.words.take(pa.array(kept)), self.size[kept], self.used[kept]
        return found


class CachedEncoder:
    """Encodes whole texts with a tokenizers file, many at a time.

    Texts are cut at single spaces and line breaks, where these tokenizers always end a word; the distinct pieces of a slice are
    found by Arrow. One that is one plain word and punctuation is parted into the two, and the distinct words among these that
    are not kept in a table go through the library's model; any other piece goes through the library's whole tokenizer once.
    Texts where such a cut could change an id (runs of blanks in a byte-level file, special tokens spelled out) go to the library
    whole. The table and the cache of other pieces are bounded in bytes.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        #: Whether blanks are dropped and letters lower-cased, as the file's normalizer does, or both kept.
        self.folds = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("A") == "a"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: The characters that stand for bytes; a line break parts words.
        self.letters = {i: c for i, c in enumerate(byte_symbols()) if i != 10}
        self.words = WordTable(self._words, cache)
        self.pieces = WordCache(self._piece, cache // 2)
        self.tails: dict[str, bytes] = {"": b""}
        self.newline = b"" if self.folds else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, with the space before them if the file keeps it, and how many each has."""
        ids, size = [], []
        for word in "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n") if words else []:
            tokens = self.model.tokenize(word)
            size.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(ids, dtype="<u4"), np.array(size, dtype=np.int64)

    def _tail(self, tail: str) -> bytes:
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        if tail not in self.tails:
            self.tails[tail] = array("I", [t.id for t in self.model.tokenize(tail)]).tobytes()
        return self.tails[tail]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: after a line break if it starts with one, else after a space."""
        if not piece:
            return b""
        return self._whole(piece if self.folds or piece[0] == "\n" else " " + piece)

    def _parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where in them those of its line break, word and punctuation begin and how many these are."""
        cut = pc.extract_regex(pieces, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        line, body, tail = cut.filter(pa.array(plain)).flatten()
        first = pc.equal(line, "\n")
        words = pc.utf8_lower(body) if self.folds else pc.binary_join_element_wise(pc.if_else(first, "", " "), body, "")
        words, tails = words.dictionary_encode(), tail.dictionary_encode()
        flat, start, size = self.words.of(words.dictionary)
        other = [self.newline, *map(self._tail, tails.dictionary.to_pylist()), *self.pieces.of(pieces.filter(pa.array(~plain)).to_pylist())]
        other_size = np.array([len(x) for x in other], dtype=np.int64) // 4
        other_start = len(flat) + np.cumsum(other_size) - other_size
        starts, sizes = np.zeros((len(pieces), 3), dtype=np.int64), np.zeros((len(pieces), 3), dtype=np.int64)
        word, tail = words.indices.to_numpy(), tails.indices.to_numpy() + 1
        starts[plain] = np.stack([np.full(len(word), other_start[0]), start[word], other_start[tail]], axis=1)
        sizes[plain] = np.stack([first.to_numpy(zero_copy_only=False) * other_size[0], size[word], other_size[tail]], axis=1)
        starts[~plain, 1], sizes[~plain, 1] = other_start[len(tails.dictionary) + 1 :], other_size[len(tails.dictionary) + 1 :]
        return np.concatenate([flat, np.frombuffer(b"".join(other), dtype="<u4")]), starts, sizes

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (32-bit) of all texts, one after the other, and where each text's begin, with the end of the last; null as empty."""
        texts = pc.fill_null(texts, "")
        unsafe = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            unsafe |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.folds:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            unsafe |= pc.match_substring_regex(texts, _BLANKS).to_numpy(zero_copy_only=False)
            # The first word of a text has no space before it: it is taken as one after a line break, whose id is then left out.
            cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = cut.values.dictionary_encode()
        flat, starts, sizes = self._parts(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = flat[gather(starts[at].ravel(), sizes[at].ravel())]
        edges = np.append(0, np.cumsum(sizes.sum(axis=1)[at]))[cut.offsets.to_numpy()]
        if not self.folds:
            ids = np.delete(ids, edges[:-1])
            edges = edges - np.arange(len(edges))
        if unsafe.any():
            parts = [np.frombuffer(self._whole(texts[i].as_py()), dtype="<u4") if unsafe[i] else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]
            ids = np.concatenate(parts)
            edges = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, edges

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, little-endian unsigned 32-bit."""
        return self.encode_array(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder a worker process and file."""
    return CachedEncoder(path)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
