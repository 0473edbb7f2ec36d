"""Target-distribution importance resampling: documents whose hashed n-grams resemble a target's are drawn without replacement.

Features are runs of one to three words, counted in ``BUCKETS`` buckets by CRC-32. A bucket's gain is the scaled logarithm of its
share in the target over its share in the documents; a document's weight is the sum of the gains of its features, and a score
adds Gumbel noise derived from its doc_id, so that the highest scores are a weighted draw without replacement.

The cutoff of the draw is found without sorting all scores: a quantile sketch brackets it, exact counts outside the bracket
validate or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import giving_back, numbered, saved, small_batches, text_blocks

#: Fixed values of the contract.
BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 42
#: Relative rank error of the first sketch; the bracket reaches twice as far to either side.
SKETCH_ERROR = 0.001

_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _IS_WORD[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)
#: Words up to so many bytes are hashed column by column, longer ones by zlib.
_SHORT = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map with tables t[4, 256] of a state's four bytes."""
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


_CRC = _crc_table()
#: _ZEROS[n]: what n zero bytes do to a CRC state, up to _SHORT + 1 of them; _DOUBLED[k]: 2 ** k zero bytes.
_ZEROS = np.empty((_SHORT + 2, 4, 256), np.uint32)
_ZEROS[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
for _n in range(1, _SHORT + 2):
    _ZEROS[_n] = _CRC[_ZEROS[_n - 1] & 255] ^ (_ZEROS[_n - 1] >> np.uint32(8))
_DOUBLED = [_ZEROS[1]]
while len(_DOUBLED) < 32:
    _DOUBLED.append(_apply(_DOUBLED[-1], _DOUBLED[-1]))
_FLAT = _ZEROS.ravel()


def advance(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states after n more zero bytes each. CRC is linear, so that the state after bytes b is this one xor b's own remainder."""
    state = state.copy()
    long = np.flatnonzero(n > _SHORT + 1)
    if len(long):
        for k, t in enumerate(_DOUBLED):
            hit = long[(n[long] >> k) & 1 == 1]
            state[hit] = _apply(t, state[hit])
        n = n.copy()
        n[long] = 0
    at = n.astype(np.int64) << 10
    return _FLAT[at + (state & 255)] ^ _FLAT[at + 256 + ((state >> 8) & 255)] ^ _FLAT[at + 512 + ((state >> 16) & 255)] ^ _FLAT[at + 768 + (state >> 24)]


def _remainders(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC state of each word, begun at zero."""
    order = np.argsort(-np.minimum(lengths, _SHORT + 1), kind="stable")
    long = int(np.searchsorted(-lengths[order], -_SHORT, "left"))
    out = np.zeros(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[long:]
    at, size, state = starts[order], lengths[order], np.zeros(len(order), np.uint32)
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # words longer than i come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + i]) & 255] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, [(text, bucket) of all its runs of 1, 2 and 3 words]) for a block of texts in UTF-8."""
    n = len(data)
    data = _LOWER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = _IS_WORD[data]
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    size = ends - starts
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    text = np.repeat(np.arange(len(words)), words)
    rest = _remainders(data, starts, size)
    first = advance(np.full(len(size), _ONES), size) ^ rest
    after_space = advance(np.full(len(size), _CRC[32]), size) ^ rest
    out, state = [], first
    for k in range(3):
        if k:
            if len(state) <= 1:
                break
            state = advance(state[:-1], size[k:] + 1) ^ after_space[k:]
        same = text[: len(state)] == text[k:]
        out.append((text[: len(state)][same], (state[same] ^ _ONES) % np.uint32(BUCKETS)))
    return words, out


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts(text) in each bucket. Tasks add up before the shuffle; at most ``BUCKETS`` rows come to the driver."""
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0)):
                for _, bucket in features(data, offsets)[1]:
                    total += np.bincount(bucket, minlength=BUCKETS)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(giving_back(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (smoothed share in the target / smoothed share in the source)) of each bucket."""
    total_s, total_t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total_s + BUCKETS) / ((s + 1.0) * (total_t + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs(doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts = []
            for _, data, offsets in text_blocks(batch.column(1)):
                words, runs = features(data, offsets)
                weight = np.zeros(len(words), np.int64)
                for text, bucket in runs:
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    weight += np.diff(sums[np.searchsorted(text, np.arange(len(words) + 1))])
                counts.append((words, words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0), weight))
            columns = [np.concatenate([c[i] for c in counts]) if counts else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id, seed: int = SEED):
    """floor(1000 x a Gumbel variable derived from the id); null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def bracket(scores: DataFrame, k: int, n: int, error: float = SKETCH_ERROR) -> tuple[int, int, int]:
    """(lo, hi, above): fewer than k of the n rows of scores(score) lie above hi, namely above, and at least k at or above lo.

    A sketch proposes the bracket around the k-th highest score; exact counts validate it, else its error is doubled. From half on
    the bracket is the whole range, so that it ends whatever the sketch says.
    """
    while True:
        whole = error >= 0.5
        if whole:
            lo, hi = scores.agg(F.min("score"), F.max("score")).first()
        else:
            p = 1 - k / n
            lo, hi = scores.stat.approxQuantile("score", [max(0.0, p - 2 * error), min(1.0, p + 2 * error)], error)
            lo, hi = math.floor(lo), math.ceil(hi)
        above, reached = scores.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score") >= lo)).first()
        if above < k <= reached or whole:
            return lo, hi, above
        error *= 2


def draw(scored: DataFrame, percent: int = 5, error: float = SKETCH_ERROR) -> DataFrame:
    """scored(doc_id, n_words, n_features, weight, score) with rank: 1, 2, ... of the drawn rows, null for all others.

    Of the N rows with a score and at least ``LEAST_WORDS`` words, floor(percent * N / 100) of the highest scores are drawn, ties to
    the smaller doc_id, then to fewer features. scored must be a stored table: it is read several times.
    """
    able = F.coalesce((F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull(), F.lit(False))
    pool = scored.where(able)
    n = pool.count()
    k = percent * n // 100
    blank = F.lit(None).cast("bigint").alias("rank")
    if k == 0:
        return scored.select("*", blank)
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    lo, hi, above = bracket(pool, k, n, error)
    inner = numbered(pool.where(F.col("score").between(lo, hi)), order, "number")
    drawn = F.col("number") <= k - above
    inner = inner.select(*scored.columns, F.when(drawn, F.col("number") + above).alias("rank"))
    outer = numbered(pool.where(F.col("score") > hi), order, "rank").select(*scored.columns, "rank")
    rest = scored.where(~able | (F.col("score") < lo)).select("*", blank)
    return outer.unionByName(inner).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs(doc_id, text); target(text) tells what to resemble.

    Null and empty texts have no words, weight 0 and are never drawn. A null doc_id has no score: it is counted into the shares,
    but not into N, and never drawn. Rows that repeat a doc_id are judged each by itself; equal rows take consecutive ranks. Other
    columns aren't read. Empty tables give an empty result; without a target all gains follow from its smoothing alone.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(saved(scored), percent)
