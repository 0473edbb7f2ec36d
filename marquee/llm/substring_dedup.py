"""Substring deduplication by seed and extend over winnowed anchors.

Every window of ``length`` words elects one anchor, the leftmost least hash among its k-word grams, so that equal windows
elect equal anchors. The windows that elect one anchor overlap; the words they cover are its span. Anchors that occur in
two documents seed matches. Where a whole span recurs, all its windows match the first document with that span. Where the
spans around an anchor differ, the match is extended both ways only as far as the windows agree: of each distinct span the
first document's windows are compared. Adjacent matching windows merge into maximal repeats.

Null and empty texts have no words and come back with zero counts and the hash of the empty string. Texts shorter than
a window lose nothing. A repeat within one document alone stays. Rows that repeat a doc_id are one document to the
matching (nothing is removed because of a row with the same doc_id) and each gets its own row. Rows without a doc_id
keep all their words and seed nothing. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import block_words, giving_back, grams, mix, saved, small_batches, text_blocks

GRAM = 5
_SECOND = np.uint64(0xA0761D6478BD642F)


def _windows(hashes: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """(start, text, anchor, span, first hash, second hash) of each window within one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(text[:n] == text[length - 1 :])
    gram = grams(hashes, k)
    span = length - k + 1
    at = start + (np.lib.stride_tricks.sliding_window_view(gram, span)[start].argmin(axis=1) if len(start) else start)
    one, two = grams(hashes, length)[start], grams(mix(hashes ^ _SECOND), length, _SECOND)[start]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    end = np.append(new[1:], len(at)) - 1
    whole = mix(one[new] + two[end] * _SECOND + (end - new).astype(np.uint64))
    whole = np.repeat(whole, end - new + 1)
    return start, text[start], (gram[at] >> np.uint64(16)).view(np.int64), whole.view(np.int64), one.view(np.int64), two.view(np.int64)


def _spans(length: int, k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, data, offsets in text_blocks(batch.column("text")):
                _, _, hashes, bounds = block_words(data, offsets)
                _, text, anchor, span, _, _ = _windows(hashes, bounds, length, k)
                if len(anchor):
                    new = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (text[1:] != text[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(span[new]), pa.array(ids[first + text[new]].astype(np.int64))], ["anchor", "span", "doc_id"])

    return run


def _seeded(length: int, k: int):
    """The windows of a text that lie in the given spans."""

    def run(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("spans")
            for first, data, offsets in text_blocks(batch.column("text")):
                _, _, hashes, bounds = block_words(data, offsets)
                _, text, _, span, one, two = _windows(hashes, bounds, length, k)
                cut = np.searchsorted(text, np.arange(len(offsets)))
                rows = [np.zeros((0, 3), np.int64)]
                for i in range(len(offsets) - 1):
                    a, b = cut[i], cut[i + 1]
                    if a < b:
                        hit = a + np.flatnonzero(np.isin(span[a:b], spans[first + i].values.to_numpy()))
                        rows.append(np.stack([one[hit], two[hit], np.full(len(hit), ids[first + i], np.int64)], axis=1))
                found = np.concatenate(rows)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, c].copy()) for c in range(3)], ["one", "two", "doc_id"])

    return run


def _cut(length: int, k: int):
    def run(batches):
        for batch in batches:
            spans, windows = batch.column("spans"), batch.column("windows")
            out = {"n_words": [], "n_removed": [], "kept_text": [], "removed_spans": []}
            for first, data, offsets in text_blocks(batch.column("text")):
                starts, ends, hashes, bounds = block_words(data, offsets)
                start, text, _, span, one, two = _windows(hashes, bounds, length, k)
                cut = np.searchsorted(text, np.arange(len(offsets)))
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    x, y = cut[i], cut[i + 1]
                    bad = np.zeros(y - x, bool)
                    if spans[first + i].is_valid and len(spans[first + i]):
                        bad |= np.isin(span[x:y], spans[first + i].values.to_numpy())
                    if windows[first + i].is_valid and len(windows[first + i]):
                        pairs = windows[first + i].values
                        ones, twos = pairs.field("one").to_numpy(), pairs.field("two").to_numpy()
                        known = set(zip(ones.tolist(), twos.tolist(), strict=True))
                        for j in np.flatnonzero(np.isin(one[x:y], ones)):
                            bad[j] |= (one[x + j], two[x + j]) in known
                    hit = start[x:y][bad] - a
                    step = np.zeros(b - a + 1, np.int64)
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + length, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[1], keep, [1]]).astype(np.int8)))
                    kept = (np.flatnonzero(keep) + a).tolist()
                    out["n_words"].append(b - a)
                    out["n_removed"].append(b - a - len(kept))
                    out["kept_text"].append(b" ".join([raw[starts[j] : ends[j]] for j in kept]).decode())
                    out["removed_spans"].append(turn.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string()), pa.array(out["removed_spans"], pa.list_(pa.int64()))],
                ["doc_id", *out],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 13, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed_spans (word positions: start, end, start, ...) of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = docs.where("doc_id IS NOT NULL")
    spans = seen.mapInArrow(giving_back(_spans(length, k)), "anchor long, span long, doc_id long")
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "span") for n, f in (("lo", F.min), ("hi", F.max))]
    seeds = spans.groupBy("anchor").agg(*ends).where("lo_doc_id < hi_doc_id").select("anchor", (F.col("lo_span") < F.col("hi_span")).alias("differ"))
    seeded = saved(spans.join(seeds, "anchor").select("anchor", "span", "differ", "doc_id"))
    # Equal spans have one anchor; with it as part of the key, two spans are confused only where it and their 64-bit hash agree.
    firsts = seeded.groupBy("anchor", "span").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("differ").alias("differ"))
    whole = seeded.join(firsts.where("lo < hi").select("anchor", "span", "lo"), ["anchor", "span"]).where("doc_id > lo").select("doc_id", "span")
    open_ = firsts.where("differ").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("span").alias("spans"))
    windows = saved(seen.join(open_, "doc_id").mapInArrow(giving_back(_seeded(length, k)), "one long, two long, doc_id long"))
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("one", "two", "lo")
    parts = windows.join(least, ["one", "two"]).where("doc_id > lo").select("doc_id", F.lit(None).cast("long").alias("span"), F.struct("one", "two").alias("window"))
    found = whole.withColumn("window", F.lit(None).cast("struct<one:bigint,two:bigint>")).unionByName(parts)
    found = found.groupBy("doc_id").agg(F.collect_set("span").alias("spans"), F.collect_set("window").alias("windows"))
    return docs.join(found, "doc_id", "left").mapInArrow(giving_back(_cut(length, k)), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<long>")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = 13) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for tests on few rows with distinct doc_id."""
    import re

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first: dict[tuple, int] = {}
    for d, w in split.items():
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = {i for j in range(len(w) - length + 1) if first[tuple(w[j : j + length])] < d for i in range(j, j + length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
