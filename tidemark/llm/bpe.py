"""BPE encoding and decoding: distinct words in a trie, encodings of shared prefixes computed once.

The encoding of a word is known by its last token and the encoding of the prefix before it, and of the
tokens that end a prefix just one does not merge with the last token of what is before. So each node of
the trie needs one step, whatever number of words pass through it.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, whole

CACHE_WORDS = 100_000  # words whose encodings a worker keeps
PAIRS = 300_000  # neighbouring tokens that a worker keeps
CACHE_CHARS = 64  # longer words are not kept from one batch to the next

# fixed values: the pattern of words, as the vocabulary's file states it, and the same for lower-case ASCII
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0c0-9a-z]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _frozen(node: dict) -> dict:
    """Symbols to pairs of what is below and the token that is spelled so far, or None."""
    return {symbol: (_frozen(below), below.get("")) for symbol, below in node.items() if symbol}


class Vocabulary:
    """Tokens and merges of a word-based BPE file: lower case, words closed by a suffix, no unknown token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: token for token, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: token for token, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()

        parts = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in parts]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        # of each token: what it looks like at its right (left) edge while it is built, with the rank that ends it
        never = len(merges)
        self.right = {i: [(i, never)] for i in self.ids.values()}
        self.left = {i: [(i, never)] for i in self.ids.values()}
        self.reached = {i for token, i in self.ids.items() if len(token.removesuffix(self.suffix) or token) == 1}
        for rank, (a, b, made) in enumerate(merges):
            if made in self.reached:
                continue  # an earlier merge makes it
            self.right[made] += [(b, rank), *self.right[b][1:]]
            self.left[made] += [(a, rank), *self.left[a][1:]]
            if a in self.reached and b in self.reached and self._stay_apart(a, b, rank):
                self.reached.add(made)
        # the tokens within words and those that close one, spelled from their last symbol
        inner: dict = {}
        closing: dict = {}
        for token, i in self.ids.items():
            if i in self.reached:
                bare = token.removesuffix(self.suffix)
                node = inner if bare == token or not bare else closing
                for symbol in reversed(bare or token):
                    node = node.setdefault(symbol, {})
                node[""] = i
        self.inner, self.closing = _frozen(inner), _frozen(closing)
        self.apart: dict[tuple[int, int], bool] = {}

    def _stay_apart(self, a: int, b: int, until: int) -> bool:
        """Whether nothing merges over the border of a and b before ``until``, when they are built side by side.

        An inner edge is there until its own merge; equal merges go from left to right.
        """
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                rank = self.rank.get((x, y))
                if rank is not None and rank < until and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def adjacent(self, a: int, b: int) -> bool:
        """Whether a and b next to each other stay two tokens."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self._stay_apart(a, b, len(self.rank))
        return known

    def _last(self, prefix: str, ends: dict, states: list) -> tuple[int, int]:
        """The last token (id, length) of a prefix; states[k] is that of its first k symbols."""
        found, depth = [], len(prefix)
        at, apart = depth, self.apart
        for symbol in reversed(prefix):
            below = ends.get(symbol)
            if below is None:
                break
            at -= 1
            ends, token = below
            if token is not None:
                found.append((token, at))
        while found:
            token, at = found.pop()
            before = states[at]
            if before is None:
                return token, depth - at
            known = apart.get((before[0], token))
            if known or known is None and self.adjacent(before[0], token):
                return token, depth - at
        raise ValueError(f"no token ends {prefix!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words. Insert all into a trie and go through it depth first."""
        trie: dict = {}
        symbol_of = self.symbols.__getitem__
        for word in words:
            node = trie
            # printable ASCII stands for itself
            for symbol in word if word.isascii() and word.isprintable() else map(symbol_of, word.encode()):
                below = node.get(symbol)
                if below is None:
                    below = node[symbol] = {}
                node = below
            node[""] = word  # no symbol is empty
        out: dict[str, list[int]] = {}
        states: list = [None]  # of the prefixes on the path from the root, by their length
        todo = [(below, 1, symbol) for symbol, below in trie.items()]
        path = ""
        last_of, inner, closing = self._last, self.inner, self.closing
        while todo:
            node, depth, symbol = todo.pop()
            path = path[: depth - 1] + symbol
            del states[depth:]
            word = node.pop("", None)
            if word is not None:
                token, length = last_of(path, closing, states)
                ids, at = [token], depth - length
                while at:
                    token, length = states[at]
                    ids.append(token)
                    at -= length
                ids.reverse()
                out[word] = ids
            if node:  # longer words pass
                states.append(last_of(path, inner, states))
                depth += 1
                for symbol, below in node.items():
                    todo.append((below, depth, symbol))
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text, with special tokens as they are."""
        if "<|" not in text:
            return split_words(text)
        parts = self.split_special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else split_words(part))]

    def encode(self, texts: list[str], cache: dict[str, list[int]]) -> list[list[int]]:
        """Ids of each text. ``cache`` has words known from before and takes up new ones that are short."""
        split = [self.pieces(text) for text in texts]
        words = set(chain.from_iterable(split))
        new = words.difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            for word in cache.keys() - words:  # those that come again stay
                del cache[word]
        special = new.intersection(self.special)
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles; looking for them in all its nodes takes a tenth of the time
        try:
            cache |= self.encode_words(new - special)
        finally:
            if collecting:
                gc.enable()
        cache |= {word: [self.special[word]] for word in special}
        found = [list(chain.from_iterable(map(cache.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > CACHE_CHARS:
                del cache[word]
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, special ones too; the file names no decoder. Unknown ids are left out."""
        return " ".join(token for token in map(self.tokens.get, ids) if token is not None)


def split_words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()  # each character by itself, also at the end of a word
    # characters newer than the tables that the vocabulary was made with are neither letters nor numbers
    later = {ord(c): "\u2022" for c in set(text) if not c.isascii() and unicodedata.category(c) == "Cn"}
    if not later:
        return WORDS.findall(text)
    return [text[found.start() : found.end()] for found in WORDS.finditer(text.translate(later))]


@lru_cache(2)
def vocabulary(path: str) -> tuple[Vocabulary, dict[str, list[int]]]:
    """A vocabulary and the words that this worker has encoded by it; both stay with the worker."""
    return Vocabulary(path), {}


SLICE_BYTES = 2 << 20


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of so many rows that their texts come to SLICE_BYTES, whatever batches they come in."""
    keys, texts, held = [], [], 0
    for batch in batches:
        start = 0
        for at, text in enumerate(batch.column(1).to_pylist()):
            texts.append(text)
            held += len(text)
            if held > SLICE_BYTES:
                yield pa.concat_arrays([*keys, batch.column(0).slice(start, at + 1 - start)]), texts
                keys, texts, held, start = [], [], 0, at + 1
        if start < batch.num_rows:
            keys.append(batch.column(0).slice(start))
    if texts:
        yield pa.concat_arrays(keys), texts


def bpe_encode(docs: DataFrame, key: str, text: str, path: str, decoded: str | None = None) -> DataFrame:
    """(key, n_tokens, ids) of whole texts, and with ``decoded`` the decoded ids in a column of that name.

    Lower-cases after NFC, drops white space, splits words by the file's pattern; special tokens written in
    a text become their ids. ``path`` has to be readable by all executors. Nothing is shuffled. A worker
    encodes the distinct words of a slice of texts at a time and keeps up to CACHE_WORDS short ones.

    A null or empty text has no tokens. Rows that repeat a key, null keys and other columns do no harm; one
    row per input row comes out.
    """
    small_batches(docs.sparkSession)
    fields = [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []
    names = [field.name for field in fields]

    def work(batches):
        words, cache = vocabulary(path)
        for keys, texts in _slices(batches):
            found = words.encode(texts, cache)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
            columns = [keys, pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(pa.array(map(words.decode, found), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key), whole(F.col(text))).mapInArrow(work, T.StructType(fields))


def bpe_decode(encoded: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text) of token ids; null ids are an empty text, ids that the vocabulary lacks are left out."""
    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])

    def work(batches):
        words, _ = vocabulary(path)
        for batch in batches:
            texts = [words.decode(found or ()) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(key, ids).mapInArrow(work, schema)
