"""Removal of repeated passages: every byte covered by a string of WINDOW bytes that also starts elsewhere.

Anchors bring equal strings together. Of the GRAM-byte strings in a window the one with the smallest hash is
its anchor, wherever the window stands, so equal windows have equal anchors; consecutive windows share one, and
a segment is the bytes of all windows that do. Segments whose anchor occurs once are unique. The others are
dealt to shards by their anchor, equal segments once with their number, and each shard's suffix array is sorted
by induction; a window is repeated if its suffix shares WINDOW bytes with a neighbour in the order.

An anchor with very many different segments (a line that stands in a large part of all documents) would make
its shard too large. The windows of such anchors are dealt out one by one, by a hash of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import whole, with_ids, written
from tidemark.llm.suffix_array import permuted_prefixes, suffix_array
from tidemark.operators.spread import spread_join

WINDOW = 200
GRAM = 64
PIECE = 1 << 20  # bytes of a text that are looked at together
SHARD_BYTES = 1 << 20  # a shard's segments on average
HOT_SEGMENTS = 8192  # different segments of an anchor that one shard takes
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def rolling_hashes(raw: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """64-bit hashes of all substrings of a length, out of those of the powers of two below it."""
    mask = (1 << 64) - 1
    power, level, step = raw.astype(np.uint64) * np.uint64(multiplier) + np.uint64(length), 1, multiplier
    out, done = None, 0
    while True:
        if length & level:
            if out is None:
                out, done = power[: len(raw) - level + 1], level
            else:
                n = len(raw) - done - level + 1
                out = out[:n] * np.uint64(step) + power[done : done + n]
                done += level
        if done == length:
            break
        n = len(raw) - 2 * level + 1
        power = power[:n] * np.uint64(step) + power[level : level + n]
        step = step * step * 5 + 1 & mask | 1
        level *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(MULTIPLIERS[1])
    return out ^ (out >> np.uint64(29))


def anchors(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, hash) of all runs of windows with the same anchor, piece by piece."""
    low = np.uint64((1 << 21) - 1)
    wide = window - gram + 1
    for start in range(0, max(0, len(raw) - window + 1), PIECE):
        part = np.frombuffer(raw, np.uint8, min(PIECE + window - 1, len(raw) - start), start)
        hashes = rolling_hashes(part, gram, MULTIPLIERS[0])
        # equal hashes: the rightmost counts, wherever the window stands
        keys = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
        n = len(part) - window + 1
        blocks = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(keys)] = keys
        blocks = blocks.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (low - (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], n) - 1
        yield first + start, last + start, hashes[place[first]].view(np.int64)


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(_id, _a, _b, _h, _c): runs of windows, the hash of their anchor and that of their bytes."""

    def work(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for first, last, hashes in anchors(raw, window, gram):
                    cuts = map(slice, first.tolist(), (last + window).tolist())
                    content = np.fromiter(map(xxhash.xxh3_64_intdigest, map(raw.__getitem__, cuts)), np.uint64, len(first))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), key, np.int64)), pa.array(first.astype(np.int32)),
                         pa.array(last.astype(np.int32)), pa.array(hashes), pa.array(content.view(np.int64))],
                        names=["_id", "_a", "_b", "_h", "_c"],
                    )

    rows = docs.select("_id", F.col("_text").cast("binary"))
    return rows.mapInArrow(work, "_id long, _a int, _b int, _h long, _c long")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (_id, _a, _b, _h, _c, _n, _hot) with the bytes of each segment, from the texts."""

    names = ["_h", "_c", "_n", "_hot", "_bytes"]

    def work(batches):
        for batch in batches:
            for raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = [[cut[name] for cut in cuts] for name in names[:-1]]
                parts = [raw[cut["_a"] : cut["_b"]] for cut in cuts]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                arrays = [pa.array(c, kind) for c, kind in zip([*columns, parts], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    cuts = wanted.groupBy("_id").agg(F.collect_list(F.struct("_a", "_b", *names[:-1])).alias("_cuts"))
    rows = docs.select("_id", F.col("_text").cast("binary").alias("_raw")).join(cuts, "_id")
    return rows.select("_raw", "_cuts").mapInArrow(work, "_h long, _c long, _n long, _hot boolean, _bytes binary")


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


SPANS = "_h long, _c long, _spans array<struct<start:int,end:int>>"


def repeated_in_shard(parts: list[bytes], copies: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment the byte ranges of its windows that occur twice or more, by one suffix array of all."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    raw = np.frombuffer(b"".join(part + b"\0" for part in parts), np.uint8)
    closing = ends - 1
    inside = np.ones(len(raw), bool)
    inside[closing] = False
    used = np.unique(raw[inside])
    if len(used) > 254:
        raise ValueError("texts in UTF-8 have fewer different bytes")
    letters = np.zeros(256, np.uint8)
    letters[used] = np.arange(len(used), dtype=np.uint8) + 2
    text = letters[raw]
    text[closing] = 1
    text = np.append(text, np.uint8(0))
    most = int(sizes.max()) + 1
    order = suffix_array(text)
    before, shared = permuted_prefixes(text, order, starts, most)
    long = np.flatnonzero(shared >= window)
    twice = np.zeros(len(text), bool)
    twice[long] = True
    twice[before[long]] = True
    out = []
    for start, size, n in zip(starts.tolist(), sizes.tolist(), copies, strict=True):
        if n > 1:
            out.append([(0, size)])
        else:
            found = _runs(twice[start : start + size - window + 1])
            out.append([(a, b - 1 + window) for a, b in zip(*found, strict=True)])
    return out


def _by_shards(segments: DataFrame, window: int) -> DataFrame:
    total = segments.agg(F.sum(F.length("_bytes"))).first()[0] or 0
    shards = max(1, round(total / SHARD_BYTES))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", "_c"], kind="stable")
        spans = repeated_in_shard(part["_bytes"].tolist(), part["_n"].tolist(), window)
        return pd.DataFrame({"_h": part["_h"], "_c": part["_c"], "_spans": spans})

    return segments.groupBy(F.pmod(F.xxhash64("_h"), F.lit(shards))).applyInPandas(work, SPANS)


def _by_windows(segments: DataFrame, window: int) -> DataFrame:
    """The same for segments of hot anchors, window by window."""

    def hashes(batches):
        for batch in batches:
            for h, c, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = np.frombuffer(raw, np.uint8)
                one, two = (rolling_hashes(text, window, m).view(np.int64) for m in MULTIPLIERS)
                rows = len(one)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(rows, x, np.int64)) for x in (h, c, n)), pa.array(np.arange(rows, dtype=np.int32)),
                     pa.array(one), pa.array(two)],
                    names=["_h", "_c", "_n", "_at", "_w1", "_w2"],
                )

    given = segments.select("_h", "_c", "_n", "_bytes")
    each = written(given.mapInArrow(hashes, "_h long, _c long, _n long, _at int, _w1 long, _w2 long"), "hot-windows")
    counts = each.groupBy("_w1", "_w2").agg(F.sum("_n").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    twice = counts.where("_copies > 1")
    weights = twice.select("_w1", "_w2", "_rows")
    found = spread_join(each, twice.select("_w1", "_w2"), ["_w1", "_w2"], "left_semi", ["_c", "_at"], weights)
    span = F.struct(F.col("_at").alias("start"), (F.col("_at") + window).alias("end"))
    return found.groupBy("_h", "_c").agg(F.collect_list(span).alias("_spans"))  # a segment's windows


def repeated_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(_id, _spans): byte ranges of the texts (_id, _text) that repeated windows cover; they may overlap."""
    segments = written(_segments(docs, window, gram), "segments")
    found = segments.groupBy("_h").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_c").alias("_least"), F.max("_c").alias("_most")
    )
    found = found.where("_rows > 1").select("_h", "_rows", (F.col("_least") != F.col("_most")).alias("_mixed"))
    found = written(found, "repeated-anchors")
    kept = spread_join(segments, found.drop("_rows"), ["_h"], "inner", ["_id", "_a"], found.select("_h", "_rows"))
    kept = written(kept, "repeated-segments")

    mixed = kept.where("_mixed")
    one = F.min(F.struct("_id", "_a", "_b")).alias("_one")
    distinct = written(mixed.groupBy("_h", "_c").agg(one, F.count(F.lit(1)).alias("_n")), "distinct-segments")
    hot = distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT_SEGMENTS)
    distinct = spread_join(distinct, hot.select("_h", F.lit(True).alias("_hot")), ["_h"], "left", ["_c"], hot)
    is_hot = F.coalesce("_hot", F.lit(False)).alias("_hot")
    wanted = distinct.select("_one._id", "_one._a", (F.col("_one._b") + window).alias("_b"), "_h", "_c", "_n", is_hot)
    texts = written(_cut_out(docs, wanted), "segment-texts")
    spans = _by_shards(texts.where("not _hot"), window).unionByName(_by_windows(texts.where("_hot"), window))
    spans = written(spans.where(F.size("_spans") > 0), "segment-spans")
    copies = distinct.select("_h", "_c", F.col("_n").alias("_rows"))
    placed = spread_join(mixed.select("_id", "_a", "_h", "_c"), spans, ["_h", "_c"], "inner", ["_id", "_a"], copies)
    moved = F.transform("_spans", lambda s: F.struct((s["start"] + F.col("_a")).alias("start"), (s["end"] + F.col("_a")).alias("end")))
    plain = F.array(F.struct(F.col("_a").alias("start"), (F.col("_b") + window).alias("end")))
    every = placed.select("_id", moved.alias("_spans")).unionByName(
        kept.where(~F.col("_mixed")).select("_id", plain.alias("_spans"))
    )
    return every.groupBy("_id").agg(F.flatten(F.collect_list("_spans")).alias("_spans"))  # of one document


def _without(raw: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """A text without the spans, and the number of runs that they make up."""
    gone = np.zeros(len(raw) + 1, np.int32)
    np.add.at(gone, [s["start"] for s in spans], 1)
    np.add.at(gone, [s["end"] for s in spans], -1)
    keep = np.cumsum(gone[:-1]) == 0
    runs = len(_runs(~keep)[0])
    return np.frombuffer(raw, np.uint8)[keep].tobytes(), runs


def drop_repeats(docs: DataFrame, key: str, text: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): texts in UTF-8 without the bytes of repeated strings.

    A byte goes if a string of ``window`` bytes that covers it also starts at another place of any text, the same
    one included, as the texts were given; strings do not run over the ends of texts. ``kept`` is binary, since
    characters can be cut. Nothing is left over of several equal texts.

    A null text is empty; texts shorter than the window stay. Null or repeated keys do no harm: such tables get
    row numbers of their own (with_ids). Other columns are ignored; an empty table gives no rows. A key may have any
    name; one of a result's column gives two columns of that name, the key first.
    """
    if gram > window:
        raise ValueError("an anchor has to fit into the window")
    rows = with_ids(docs.select(F.col(key).alias("_key"), whole(F.col(text)).alias("_text")), "_key")
    spans = repeated_spans(rows, window, gram)
    kind = T.StructField("_key", docs.schema[key].dataType)
    schema = T.StructType(
        [kind, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
         T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    )

    def work(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            results = [_without(raw, found) if found else (raw, 0) for raw, found in zip(raws, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raws), pa.int64()),
                 pa.array((len(raw) - len(kept) for raw, (kept, _) in zip(raws, results, strict=True)), pa.int64()),
                 pa.array((n for _, n in results), pa.int64()), pa.array((kept for kept, _ in results), pa.binary())],
                names=schema.names,
            )

    joined = rows.select("_id", "_key", F.col("_text").cast("binary").alias("_raw")).join(spans, "_id", "left")
    return joined.select("_key", "_raw", "_spans").mapInArrow(work, schema).withColumnRenamed("_key", key)
