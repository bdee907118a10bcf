"""Substring dedup: Rabin-Karp hashes of all windows of words, counted, merged into removal intervals.

A window's hash is the polynomial of its words' hashes modulo 2^64; all windows of a text come from one running
sum. Hashes of windows that cannot repeat are not sent anywhere: each window has a mark, the least hash of the
runs of MARK words in it, and equal windows have equal marks. Neighbours mostly share theirs, so marks are few; a
mark that occurs under one key only leaves no window that another key has. The hashes of all other windows are
counted. A window is known by its mark and its own hash, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, whole, with_ids, written
from tidemark.operators.spread import fits_broadcast, spread_join

WINDOW = 50
SEED = 42
BASE = 0x9E3779B97F4A7C15  # of the polynomial; odd, so that it has an inverse modulo 2^64
SLICE_BYTES = 4 << 20  # texts that are hashed together
BATCH_WINDOWS = 1 << 18  # windows that a worker hands on at a time


def mark_words(window: int) -> int:
    """Words of the runs whose least hash marks a window."""
    return (window + 1) // 2


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest slice so far has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(n + 1, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """xxh64 of each word; distinct words are hashed once."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()]


def rolling(hashes: np.ndarray, sizes: tuple[int, ...], powers: Powers) -> list[np.ndarray]:
    """For each size the Rabin-Karp hash of every run of so many neighbours, by the run's start."""
    n = len(hashes)
    powers.upto(n)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers.down[:n], dtype=np.uint64, out=upto[1:])
    return [(upto[k:] - upto[: n + 1 - k]) * powers.up[k - 1 : n] if n >= k else np.empty(0, np.uint64) for k in sizes]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    if reach < width:
        values = np.minimum(values[: len(values) - (width - reach)], values[width - reach :])
    return values


def windows(texts: list[bytes], window: int, powers: Powers) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Per text its words, and by start the mark and the hash (int64) of each of its windows."""
    words = [text.split() for text in texts]  # of bytes: ASCII white space only
    short = mark_words(window)
    runs, whole_windows = rolling(word_hashes(list(chain.from_iterable(words))), (short, window), powers)
    marks = least_of(runs, window - short + 1) if len(whole_windows) else whole_windows
    start = 0
    for own in words:
        end = max(start, start + len(own) - window + 1)
        yield own, marks[start:end].view(np.int64), whole_windows[start:end].view(np.int64)
        start += len(own)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, text in enumerate(texts):
        held += len(text)
        if held > SLICE_BYTES:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind))


def _outlines(rows: DataFrame, window: int) -> DataFrame:
    """(_id, _key, _n, _same, _marks): number of words, digest of their sequence, distinct marks. One pass over the texts."""

    def work(batches):
        powers = Powers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in _slices(texts):
                found = [(len(w), hashlib.sha256(b" ".join(w)).digest(), np.unique(m)) for w, m, _ in windows(texts[start:end], window, powers)]
                counts, digests, marks = map(list, zip(*found, strict=True))
                columns = [batch.column(i).slice(start, end - start) for i in (0, 1)]
                columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), _lists(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "_n", "_same", "_marks"])

    schema = T.StructType(
        [
            T.StructField("_id", T.LongType()),
            T.StructField("_key", rows.schema["_key"].dataType),
            T.StructField("_n", T.LongType()),
            T.StructField("_same", T.BinaryType()),
            T.StructField("_marks", T.ArrayType(T.LongType())),
        ]
    )
    return rows.select("_id", "_key", "_raw").mapInArrow(work, schema)


def _marked_windows(rows: DataFrame, window: int) -> DataFrame:
    """(_id, _key, _start, _mark, _hash) of the windows of ``rows`` whose mark is in ``_shared``."""

    def work(batches):
        powers = Powers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in _slices(texts):
                starts, marks, hashes = [], [], []
                for at, (_, mark, own) in enumerate(windows(texts[start:end], window, powers), start):
                    kept = np.flatnonzero(np.isin(mark, batch.column(3)[at].values.to_numpy()))
                    starts.append(kept)
                    marks.append(mark[kept])
                    hashes.append(own[kept])
                of = np.repeat(np.arange(start, end), list(map(len, starts)))
                parts = [np.concatenate(x).astype(np.int64) for x in (starts, marks, hashes)]
                for at in range(0, len(of), BATCH_WINDOWS):
                    here = slice(at, at + BATCH_WINDOWS)
                    columns = [batch.column(i).take(pa.array(of[here])) for i in (0, 1)]
                    columns += [pa.array(part[here]) for part in parts]
                    yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "_start", "_mark", "_hash"])

    schema = T.StructType(
        [
            T.StructField("_id", T.LongType()),
            T.StructField("_key", rows.schema["_key"].dataType),
            *[T.StructField(name, T.LongType()) for name in ("_start", "_mark", "_hash")],
        ]
    )
    return rows.select("_id", "_key", "_raw", "_shared").mapInArrow(work, schema)


def _beside(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join by ``_id``, unique on both sides; whole texts are shuffled only if ``found`` does not fit a broadcast."""
    return rows.join(F.broadcast(found) if fits_broadcast(found) else found, "_id", how)


def removal_spans(rows: DataFrame, outlines: DataFrame, window: int) -> DataFrame:
    """(_id, _spans): the places (start, end) of words to remove, maximal and in order, of those of ``rows`` that have
    any and are not whole copies; ``outlines`` are theirs."""
    marks = outlines.where("_key is not null").select("_id", "_key", F.explode("_marks").alias("_mark"))
    per_mark = marks.groupBy("_mark").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    per_mark = written(per_mark.where("_least < _most").select("_mark", "_rows"), "window-marks")
    shared = spread_join(marks, per_mark.select("_mark"), ["_mark"], "left_semi", ["_id"], per_mark)
    # no longer than the text that they are of
    shared = written(shared.groupBy("_id").agg(F.collect_set("_mark").alias("_shared")), "window-shared")
    found = written(_marked_windows(_beside(rows, shared, "inner"), window), "windows")

    on = ["_mark", "_hash"]
    counted = found.groupBy(*on).agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    repeated = written(counted.where("_least < _most").select(*on, "_least", "_rows"), "windows-repeated")
    gone = spread_join(found, repeated.drop("_rows"), on, "inner", ["_id", "_start"], repeated.select(*on, "_rows"))
    gone = gone.where("_least < _key").groupBy("_id").agg(F.array_sort(F.collect_set("_start")).alias("_starts"))
    # a start opens an interval if the one before is more than a window away
    starts = F.col("_starts")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(starts, 1, F.size(starts) - 1))
    far = lambda a, b: F.coalesce(a - b > window, F.lit(True))
    opens = F.filter(F.zip_with(starts, before, lambda a, b: F.when(far(a, b), a)), lambda a: a.isNotNull())
    after = F.concat(F.slice(starts, 2, F.size(starts) - 1), F.array(F.lit(None).cast("long")))
    ends = F.filter(F.zip_with(starts, after, lambda a, b: F.when(far(b, a), a + window)), lambda a: a.isNotNull())
    return gone.select("_id", F.arrays_zip(opens.alias("start"), ends.alias("end")).alias("_spans"))


def _without(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_words, n_removed, spans, kept) of rows with their ``_spans``; ``_copy`` stands for a span over all words."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = T.StructType(
        [
            T.StructField(key, rows.schema["_key"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))),
            T.StructField("kept", T.StringType()),
        ]
    )

    def work(batches):
        for batch in batches:
            counts, removed, spans, texts = [], [], [], []
            for raw, copy, gone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = raw.split()
                gone = [{"start": 0, "end": len(words)}] if copy else gone or []
                kept, at = [], 0
                for one in gone:
                    kept += words[at : one["start"]]
                    at = one["end"]
                kept += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                spans.append(gone)
                texts.append(b" ".join(kept).decode("utf-8", "replace"))
            columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.select("_key", "_raw", "_copy", "_spans").mapInArrow(work, schema)


def drop_windows(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a row with a smaller ``key``.

    Returns one row per input row: key, n_words, n_removed, spans (maximal intervals of removed words, from 0, end
    excluded) and kept (the other words joined by one space). Words are runs of anything but ASCII white space,
    unchanged. Windows are judged on the input, not on what is left.

    A null text has no words. Rows that repeat a key do not take words from each other. A row with a null key takes no
    words from others and loses none. Texts with fewer words than a window lose none. Other columns, whatever their
    names, are ignored; an empty table gives no rows.

    Texts of equal words are compared once: of a group only the rows with the least key take part, and all others lose
    all their words, as each of their windows starts there.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(key).alias("_key"), whole(F.col(text)).cast("binary").alias("_raw"))
    rows = with_ids(named, "_key")
    outlines = written(_outlines(rows, window), "window-outlines")
    enough = outlines.where((F.col("_n") >= window) & F.col("_key").isNotNull())
    first = enough.groupBy("_same").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    groups = written(first.where("_rows > 1"), "window-copies")
    named_copies = enough.select("_id", "_key", "_same")
    copies = spread_join(named_copies, groups.drop("_rows"), ["_same"], "inner", ["_id"], groups.select("_same", "_rows"))
    copies = written(copies.where("_key > _first").select("_id", F.lit(True).alias("_copy")), "window-copies-of")
    alone = _beside(outlines.where(F.col("_n") >= window).select("_id", "_key", "_marks"), copies.select("_id"), "left_anti")
    spans = written(removal_spans(rows, written(alone, "window-alone"), window), "window-spans")
    changes = spans.select("_id", "_spans", F.lit(False).alias("_copy"))
    none = F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans")
    changes = written(changes.unionByName(copies.select("_id", none, "_copy")), "window-changes")
    return _without(_beside(rows, changes, "left").withColumn("_copy", F.coalesce("_copy", F.lit(False))), key)
