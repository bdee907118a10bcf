"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

The ends of a text's tokens are running sums of their bytes. A dictionary per tokenizer takes each end to the index
after its token; the keys that both have, sorted, cut both lists of ids into groups, and each cut links the two tokens
that end there. How often two ids are linked is counted over the corpus.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import byte_symbols
from tidemark.llm.common import small_batches, whole, written
from tidemark.operators.spread import spread_join

BROADCAST_PAIRS = 500_000  # linked id pairs, three numbers each, that are sent to all executors

# fixed values: the pattern of words that the vocabulary's kind of pre-tokenizer has built in
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """A byte-level BPE file. Its merges have to be in the order of their ids, so that an id is a token's rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("normalizer") or spec["pre_tokenizer"] != {**spec["pre_tokenizer"], "type": "ByteLevel", "use_regex": True}:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
        special = {token["content"] for token in spec["added_tokens"]}
        ids = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [ids["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"merges are not in the order of ids: {path}")
        self.bytes = {i: bytes(map(byte.__getitem__, token)) for token, i in ids.items()}
        ranks = {token: i for i, token in self.bytes.items()}
        self._encode = tiktoken.Encoding("ids as ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it; names of special tokens are plain text."""
        return [self._encode(" " + text) for text in texts]


class PieceTokenizer:
    """A SentencePiece model that puts a space before a text by itself."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            code = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self._model.is_byte(i) else None
            self.bytes[i] = bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Tokens:
    """What alignment asks of a tokenizer's ids: their bytes, number of bytes and text."""

    def __init__(self, tokenizer: ByteTokenizer | PieceTokenizer):
        self.encode = tokenizer.encode
        size = max(tokenizer.bytes) + 1
        self.bytes = [tokenizer.bytes.get(i, b"") for i in range(size)]
        if any(not token for token in tokenizer.bytes.values()):
            raise ValueError("a token without bytes would end with the one before it")
        self.lengths = list(map(len, self.bytes))
        self.names = list(map(str, range(size)))


@lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> tuple[Tokens, Tokens]:
    return Tokens(ByteTokenizer(path_a)), Tokens(PieceTokenizer(path_b))


def align(a: Tokens, b: Tokens, ids_a: list[int], ids_b: list[int]) -> tuple[list[int], list[int]]:
    """The indices after the tokens of either list that end together, in order."""
    at_a = dict(zip(accumulate(map(a.lengths.__getitem__, ids_a)), range(1, len(ids_a) + 1)))
    at_b = dict(zip(accumulate(map(b.lengths.__getitem__, ids_b)), range(1, len(ids_b) + 1)))
    both = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, both)), list(map(at_b.__getitem__, both))


def group_text(names_a: list[str], names_b: list[str], cuts_a: list[int], cuts_b: list[int]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    groups, i, j = [], 0, 0
    for m, n in zip(cuts_a, cuts_b):
        one = names_a[i] if m - i == 1 else ",".join(names_a[i:m])
        other = names_b[j] if n - j == 1 else ",".join(names_b[j:n])
        groups.append(f"{one}|{other}")
        i, j = m, n
    return ";".join(groups)


SLICE_BYTES = 1 << 20


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, text in enumerate(texts):
        held += len(text)
        if held > SLICE_BYTES:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align_tokens(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, links, times) of whole texts, one row per input row; nothing is shuffled.

    ``path_a`` is a byte-level BPE file, ``path_b`` a SentencePiece model that puts a space before a text; both have to be
    readable by all executors. A is given the text with a space before it. Special tokens written in a text are plain
    text. ``groups`` has the ids of each group as text, A's before B's; ``links`` has the distinct id pairs (a shifted by
    32 bits, plus b) whose tokens end together, and ``times`` how often they do.

    A text that is null or empty, or that either tokenizer changes, so that its tokens' bytes are not those of the text
    with a space before it, has no tokens. Repeated rows and keys, null keys and other columns do no harm.
    """
    small_batches(docs.sparkSession)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            docs.schema[key],
            *[T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups")],
            T.StructField("groups", T.StringType()),
            T.StructField("links", longs),
            T.StructField("times", longs),
        ]
    )

    def one(a: Tokens, b: Tokens, text: str, ids_a: list[int], ids_b: list[int]) -> tuple:
        raw = b" " + text.encode()
        if not text or b"".join(map(a.bytes.__getitem__, ids_a)) != raw or b"".join(map(b.bytes.__getitem__, ids_b)) != raw:
            return 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        cuts_a, cuts_b = align(a, b, ids_a, ids_b)
        groups = group_text([a.names[i] for i in ids_a], [b.names[i] for i in ids_b], cuts_a, cuts_b)
        ends = [np.asarray(ids, np.int64)[np.asarray(cuts, np.int64) - 1] for ids, cuts in ((ids_a, cuts_a), (ids_b, cuts_b))]
        links, times = np.unique(ends[0] << 32 | ends[1], return_counts=True)
        return len(ids_a), len(ids_b), len(cuts_a), groups, links, times

    def listed(parts) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), pa.array(np.concatenate(parts).astype(np.int64)))

    def work(batches):
        a, b = tokenizers(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _slices(texts):
                part = texts[start:end]
                found = [one(a, b, *row) for row in zip(part, a.encode(part), b.encode(part), strict=True)]
                n_a, n_b, n_groups, groups, links, times = zip(*found)
                columns = [batch.column(0).slice(start, end - start), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]]
                columns += [pa.array(groups, pa.string()), listed(links), listed(times)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(key), whole(F.col(text))).mapInArrow(work, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, count, best): how often each id pair is linked in the corpus, and whether no id of A is linked to its id of
    B more often. Sums are made in the tasks first; a row per id pair and task is shuffled."""
    each = aligned.select(F.explode(F.arrays_zip("links", "times")).alias("_l"))
    counts = each.groupBy(F.col("_l.links").alias("link")).agg(F.sum("_l.times").alias("count"))
    counts = written(counts.withColumn("_b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1))), "link-counts")
    most = counts.groupBy("_b").agg(F.max("count").alias("_most"))  # a row per id of B
    return counts.join(most, "_b").select("link", "count", (F.col("count") == F.col("_most")).alias("best"))


def score_links(aligned: DataFrame, row: str, counts: DataFrame) -> DataFrame:
    """(row, n_links, n_best, count_sum) of ``aligned`` rows that have links; ``row`` tells them apart.

    n_best is the number of links whose pair is the best of its id of B, count_sum the sum of the pairs' counts over all
    links. The counts are sent to all executors if they are few enough, else joined by pair, spread where it is frequent.
    """
    each = aligned.select(row, F.explode(F.arrays_zip("links", "times")).alias("_l"))
    each = each.select(row, F.col("_l.links").alias("link"), F.col("_l.times").alias("_times"))
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        scored = each.join(F.broadcast(counts), "link")
    else:
        scored = spread_join(each, counts, ["link"], "inner", [row])
    times = F.col("_times")
    return scored.groupBy(row).agg(
        F.sum(times).alias("n_links"),
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"),
        F.sum(times * F.col("count")).alias("count_sum"),
    )
