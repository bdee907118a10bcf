"""SimHash near-dedup: fingerprints of shingles, linked by meeting in the middle of the Hamming ball.

Two fingerprints at most 3 bits apart have a variant in common that one reaches by flipping at most one
bit and the other by at most two. Every fingerprint emits the variants within one flip (65). Only a pair
exactly 3 apart needs two flips on one side, and it has unlike parities, so only fingerprints of even
parity emit them; and as two of any three bits lie in the same half of the fingerprint, the pairs of bits
within a half are enough (992 of 2016). Two flips within a half leave the other half as it is: variants are
shuffled on that half, so these are emitted where they meet the others, and only their origins travel.
A half that very many fingerprints share is cut: the other half, folded to a few bits by exclusive or, says
to which part a variant goes, and two flips change no more than two of these bits, so that an origin is
repeated for a few parts only.

All fingerprints within one flip of a variant are at most 2 apart, and those two flips away are at most 3
from them, so each links to the least of the former: links grow with the variants, not with their square,
and none between components is lost.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, whole, written
from tidemark.llm.components import components
from tidemark.operators.spread import lookup_join, spread_join

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BLOCK = 255 * 256  # hashes whose bits are counted at a time


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


ONE_FLIP = [0, *[_signed(1 << i) for i in range(BITS)]]
HALVES = (range(BITS // 2), range(BITS // 2, BITS))
TWO_FLIPS = [np.array([_signed(1 << i | 1 << j) for i in half for j in half if i < j], np.int64) for half in HALVES]
BUCKET = 1024  # fingerprints that meet in a group, on average
# A half is folded to so many bits if its load makes up to so many buckets. All variants that meet are even, so that
# half of the values of the bits are in use. The last one is for all loads: no more than 2 ** 16 variants of a half
# fold to the same 16 bits.
FOLDS = {2: 2, 4: 8, 8: 128, 16: None}


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64, one or a row of them each) have each bit, the highest bit first."""
    hashes = hashes.reshape(len(hashes), -1)
    width = BITS * hashes.shape[1]
    counts = np.zeros(width, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].astype(">u8").view(np.uint8)
        bits = np.unpackbits(part, axis=1)
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text in UTF-8; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        cuts = map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        found = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed))
        hashes = np.fromiter(found, np.uint64, len(words) - shingle + 1)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of whole texts, one row per input row; nothing is shuffled."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def work(batches):
        for batch in batches:
            found = [fingerprint(raw, shingle) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=schema.names)

    rows = docs.select(F.col(key), whole(F.col(text)).cast("binary").alias("_raw"))
    return rows.mapInArrow(work, schema)


def _odd(fp: Column) -> Column:
    return F.bit_count(fp) % 2 == 1


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` at most RADIUS bits apart that keep all components."""

    # the least fingerprint within one flip of each variant
    emitted = fps.select("fp", F.explode(F.lit(ONE_FLIP)).alias("_flips"))
    # variants hardly repeat, so nothing is gained by aggregating before the shuffle; no more than 65 share one
    around = emitted.select(F.col("fp").bitwiseXOR(F.col("_flips")).alias("variant"), "fp")
    around = around.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    alike = around.select(F.col("fp").alias("u"), F.col("least").alias("v"))
    # A variant two flips from an even fingerprint is even. One condition, so that no part of it is pushed below
    # the window and both uses share the shuffle.
    least = around.where(F.when(F.col("fp") == F.col("least"), ~_odd(F.col("variant"))))
    far, even = meeting(fps.where(~_odd(F.col("fp"))), least.select("variant", "least"), fps)
    three = far.groupBy(*PLACE).cogroup(even.groupBy(*PLACE)).applyInPandas(_meet, "u long, v long")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return alike.unionByName(three).where((F.col("u") != F.col("v")) & (apart <= RADIUS))


PLACE = ["_half", "_bucket", "_bits", "_code"]


def meeting(far: DataFrame, near: DataFrame, fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``far`` (fp) and ``near`` (variant, least) for each half that can be flipped, with the PLACE where a
    fingerprint's variants two flips away meet equal ones: a bucket by the half that stays, cut by the other one."""
    hot = written(hot_halves(fps), "hot-halves")
    buckets = max(1, fps.count() // BUCKET)
    bits = F.coalesce("_bits", F.lit(0))

    def placed(rows: DataFrame, number: str) -> DataFrame:
        halves = rows.select("*", F.inline(_halves(F.col(number))))
        halves = lookup_join(halves, hot, ["_half", "_kept"], "left", [number])
        bucket = F.pmod(F.xxhash64("_kept"), F.lit(buckets))
        code = F.coalesce(*[F.when(bits == n, _folded(F.col("_flipped"), n)) for n in FOLDS], F.lit(0).cast("long"))
        return halves.select(*rows.columns, "_half", bucket.alias("_bucket"), bits.alias("_bits"), code.alias("_code"))

    reached = F.coalesce(*[F.when(F.col("_bits") == n, F.lit(_two_changes(n))) for n in FOLDS], F.lit([0]).cast("array<bigint>"))
    repeated = placed(far, "fp").withColumn("_change", F.explode(reached))
    code = F.col("_code").bitwiseXOR(F.col("_change")).alias("_code")
    return repeated.select("fp", "_half", "_bucket", "_bits", code), placed(near, "variant")


def _halves(number: Column) -> Column:
    """For each half that can be flipped its number, the one that stays, and itself."""
    high, low = F.shiftrightunsigned(number, BITS // 2), number.bitwiseAND(F.lit((1 << BITS // 2) - 1))
    parts = lambda half, kept, flipped: F.struct(F.lit(half).alias("_half"), kept.alias("_kept"), flipped.alias("_flipped"))
    return F.array(parts(0, high, low), parts(1, low, high))


def hot_halves(fps: DataFrame) -> DataFrame:
    """(_half, _kept, _bits): halves where more than a bucket's load meets, and the bits to fold the other one to.

    A fingerprint puts half of its variants one flip away, 32, where its own half stays, and one to each half that is a flip away.
    """
    side = BITS // 2
    counts = fps.select(F.inline(_halves(F.col("fp")))).groupBy("_half", "_kept").agg(F.count(F.lit(1)).alias("_rows"))
    flips = [0, *[1 << i for i in range(side)]]
    reached = counts.where(F.col("_rows") > BUCKET).withColumn("_flip", F.explode(F.lit(flips).cast("array<bigint>")))
    load = F.sum(F.col("_rows") * F.when(F.col("_flip") == 0, side).otherwise(1)) / (side * BUCKET)
    loads = reached.groupBy("_half", F.col("_kept").bitwiseXOR(F.col("_flip")).alias("_kept")).agg(load.alias("_load"))
    bits = F.coalesce(*[F.when(F.col("_load") <= most, n) for n, most in FOLDS.items() if most], F.lit(max(FOLDS)))
    return loads.where("_load > 1").select("_half", "_kept", bits.alias("_bits"))


def _folded(half, bits: int):
    """A half (column or array) folded to fewer bits; each is the parity of every ``bits``-th one."""
    xor, shift = (Column.bitwiseXOR, F.shiftrightunsigned) if isinstance(half, Column) else (np.bitwise_xor, np.right_shift)
    width = BITS // 4
    while width >= bits:
        half = xor(half, shift(half, width))
        width //= 2
    mask = (1 << bits) - 1
    return half.bitwiseAND(F.lit(mask)) if isinstance(half, Column) else half & mask


def _two_changes(bits: int) -> list[int]:
    """What two flips can change of a folded half: nothing, or two bits."""
    return [0, *[1 << i | 1 << j for i in range(bits) for j in range(i)]]


def _flipped_half(numbers: np.ndarray, half: int) -> np.ndarray:
    return numbers >> BITS // 2 & (1 << BITS // 2) - 1 if half else numbers & (1 << BITS // 2) - 1


def _meet(place: tuple, far: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """Link each fingerprint of a place to the least one around any of its variants two flips away that belong there."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(far) and len(near):
        half, _, bits, code = (int(x) for x in place)
        order = np.argsort(near["variant"].to_numpy())
        variants, least = near["variant"].to_numpy()[order], near["least"].to_numpy()[order]
        fps, flips = far["fp"].to_numpy(), TWO_FLIPS[half]
        change = _folded(_flipped_half(fps, half), bits) ^ code if bits else np.zeros(len(fps), np.int64)
        made = _folded(_flipped_half(flips, half), bits) if bits else np.zeros(len(flips), np.int64)
        for value in np.unique(change):
            some, wanted = fps[change == value], flips[made == value]
            for start in range(0, len(some), 512):
                block = some[start : start + 512, None]
                emitted = (block ^ wanted).ravel()
                at = np.minimum(np.searchsorted(variants, emitted), len(variants) - 1)
                hit = np.flatnonzero(variants[at] == emitted)
                us.append(np.repeat(block.ravel(), len(wanted))[hit])
                vs.append(least[at[hit]])
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def near_dedup(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id): documents whose fingerprints are linked, directly or over others, at 3 bits or fewer.

    component_id is the smallest key of the component. Texts are lower-cased in A-Z; words are runs of
    anything but ASCII white space; shingles count as often as they occur; a text of fewer words is one
    shingle. A null text or one without words has the fingerprint 0, which is linked like any other.
    Rows that repeat a key, and rows with a null key, are linked like others; a component of null keys
    only has a null component_id. Other columns are ignored; an empty table gives no rows. A key may have any name;
    one of a result's column gives two columns of that name, the key first.
    """
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = written(fingerprints(texts, "_key", "_text", shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    nodes = written(nodes, "fingerprint-nodes")
    linked = components(near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    nodes = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = nodes.groupBy("component").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    counts = named.select("component", "_rows")
    labels = spread_join(nodes.drop("_rows"), named.drop("_rows"), ["component"], "inner", ["fp"], counts)
    weight = nodes.select("fp", "_rows")
    out = spread_join(rows, labels.select("fp", "component_id"), ["fp"], "inner", ["_key"], weight)
    return out.select(F.col("_key").alias(key), "fp", "component_id")
