"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (2 to 4, blended) that both have, over the root
of the product of how many each has. Landmarks give Nyström features of it, and one-versus-rest kernel
ridge regression the weights. A text's scores are the products of its presence vector with the landmarks'
vectors and of these with the weights; the last two factors are the same for all texts and are multiplied
once, so that a batch of texts takes one matrix product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, whole

NGRAMS = (2, 3, 4)
DIM_BITS = 16  # n-grams are hashed to so many bits
SAMPLE = 400  # labelled texts per language that the fit expects to use
LANGUAGES = 1024  # more than this are refused, as the driver solves for all of them
LANDMARKS = 256
RIDGE = 1e-2
BATCH = 32
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str) -> np.ndarray | None:
    """Which n-grams a text has: their hashes, sorted; None for a text without letters.

    Letters are lower-cased, runs of anything else are one space, and so are both ends.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as the space
    codes = np.where(letter, codes, 32)[keep]
    codes = np.concatenate([[32], codes, [32]] if letter[-1] else [[32], codes]).astype(np.uint32)
    seen = np.zeros(1 << DIM_BITS, bool)
    rolled = codes
    for n in range(2, max(NGRAMS) + 1):
        if n > len(codes):
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in NGRAMS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            seen[mixed >> np.uint32(32 - DIM_BITS)] = True
    return seen.nonzero()[0].astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # n-gram by language
    bias: np.ndarray

    def score(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """Best language and a score from 0 to 1 for each text."""
        out: list[tuple[str, float]] = []
        rows = np.zeros((BATCH, 1 << DIM_BITS), np.float32)
        for start in range(0, len(texts), BATCH):
            found = [presence(text) for text in texts[start : start + BATCH]]
            rows[: len(found)] = 0
            for row, grams in zip(rows, found, strict=False):
                if grams is not None:
                    row[grams] = 1 / np.sqrt(len(grams))
            values = rows[: len(found)] @ self.weights + self.bias
            for grams, value in zip(found, values, strict=True):
                if grams is None or not self.languages:
                    out.append((UNKNOWN, 0.0))
                else:
                    best = int(value.argmax())
                    out.append((self.languages[best], float(np.clip((value[best] + 1) / 2, 0, 1))))
        return out


def solve(samples: Sequence[Sequence[int]], languages: Sequence[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fit on presence vectors (lists of n-grams) and their languages."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((1 << DIM_BITS, 1), np.float32), np.zeros(1, np.float32))
    grams = [np.asarray(s, np.int32) for s in samples]
    # landmarks are taken from each language in turn
    turn = np.empty(len(grams), np.int64)
    for name in names:
        own = [i for i, language in enumerate(languages) if language == name]
        turn[own] = np.arange(len(own))
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    # a landmark at a time, since all of them as a matrix would be large for a driver
    sizes = np.array([len(g) for g in grams])
    every, starts = np.concatenate(grams), np.cumsum(sizes) - sizes
    kernel = np.empty((len(grams), len(chosen)))
    for column, i in enumerate(chosen):
        seen = np.zeros(1 << DIM_BITS, bool)
        seen[grams[i]] = True
        kernel[:, column] = np.add.reduceat(seen[every], starts, dtype=np.int64) / np.sqrt(sizes * sizes[i])
    among = kernel[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    used = values > 1e-6 * values.max()
    root = vectors[:, used] / np.sqrt(values[used])
    features = kernel @ root
    goal = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    if len(names) == 1:
        goal[:] = 1.0
    mean, offset = features.mean(axis=0), goal.mean(axis=0)
    centred = features - mean
    inner = centred.T @ centred + ridge * np.eye(centred.shape[1])
    slope = np.linalg.solve(inner, centred.T @ (goal - offset))
    weights = np.zeros((1 << DIM_BITS, len(names)))
    for i, alpha in zip(chosen, root @ slope, strict=True):
        weights[grams[i]] += alpha / np.sqrt(sizes[i])
    return LanguageModel(names, weights.astype(np.float32), (offset - mean @ slope).astype(np.float32))


def fit_languages(
    docs: DataFrame, text: str, lang: str, draw: Column, sample: int = SAMPLE, languages: int = LANGUAGES
) -> LanguageModel:
    """Fit on a bounded sample of labelled texts: about ``sample`` of each language, all of them if it has fewer.

    ``draw`` is a long, evenly spread over all its values, that decides which rows are in the sample; rows of a language
    with the same draw count once, so that with a hash of the text copies do not crowd out other texts. Rows without a
    language, a text or letters are left out. Every language is learned; more than ``languages`` of them are an error.
    Presence vectors are made on the executors; the driver gets ``sample`` of them a language, each of at most 2 to the
    power DIM_BITS n-grams.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("texts")).limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return solve([], [])
    reach = [(row["lang"], min(1.0, sample / max(1, row["texts"])) * 2.0**63) for row in counts]
    reach = F.create_map(*[F.lit(value) for pair in reach for value in pair])[F.col("lang")]
    taken = rows.where(F.abs(F.col("draw").cast("double")) <= reach)
    # copies of a drawn text are drawn too: they meet in the tasks first
    taken = taken.groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def grams(batches):
        for batch in batches:
            found = [presence(t) for t in batch.column(1).to_pylist()]
            kept = [i for i, g in enumerate(found) if g is not None]
            langs = batch.column(0).take(pa.array(kept, pa.int64()))
            packed = pa.array([found[i].tobytes() for i in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([langs, packed], names=["lang", "grams"])

    drawn = taken.select("lang", "text").mapInArrow(grams, "lang string, grams binary")
    found = sorted((r.lang, bytes(r.grams)) for r in drawn.collect())
    order = np.random.default_rng(0).permutation(len(found))
    return solve([np.frombuffer(found[i][1], np.int32) for i in order], [found[i][0] for i in order])


def predict_languages(docs: DataFrame, key: str, text: str, model: LanguageModel, carry: Sequence[str] = ()) -> DataFrame:
    """(key, columns of ``carry``, lang_pred, score) of whole texts, one row per input row; nothing is shuffled.

    A null text, or one without letters, is ``und`` with score 0, and so is any text for a model that was
    fitted on nothing. Null or repeated keys and other columns do no harm.
    """
    small_batches(docs.sparkSession)
    kept = [key, *carry]
    fields = [docs.schema[name] for name in kept]
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))  # of a fixed size

    def work(batches):
        ready = LanguageModel(*shared.value)
        for batch in batches:
            found = ready.score(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[field.name for field in fields])

    return docs.select(*kept, whole(F.col(text)).alias("".join(kept) + "_")).mapInArrow(work, T.StructType(fields))
