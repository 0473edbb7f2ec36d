"""Best-fit packing of tokenized documents by hierarchical residual rounds.

Each partition tokenizes its documents and packs the pieces best fit, longest first. Sequences with at most ``SLACK``
free places are final. The others become items of a tree: eight neighbouring partitions' items are packed best fit again,
then eight of those groups, up to the root. An item keeps its inner order, so a piece's place is the sum of its offsets.
Lengths alone travel up the tree. A tree node of more than ``ITEMS`` items is packed in several parts of about that size,
dealt by a hash of the bin, and all underfull sequences of all parts go on to the next round, so no task's input grows with
the data. What best fit loses to this: up to ``SLACK`` places a sequence that is called final, and sequences that stay
underfull at the root in different parts.

A document is its token ids and then ``end_id``; a null or empty text is the end id alone. Only documents longer than the
capacity are cut, into pieces of the capacity and a last one that may be shorter. Rows that repeat a doc_id (or have none)
are documents of their own with the same doc_id. An empty table gives an empty layout. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import give_back, saved, small_batches

if TYPE_CHECKING:
    import pandas as pd

CAPACITY, SLACK, FAN_IN, ITEMS = 4096, 16, 8, 200_000
#: Word parts that a worker remembers, about 40 bytes each.
REMEMBERED = 250_000
#: Bytes of text that are encoded at once (and one text at least).
TEXT_AT_ONCE = 1_500_000
#: Pieces that are packed at once within a partition.
AT_ONCE = 200_000
#: Latin letters and then marks: the tokenizer splits such a chunk between the two, and lower case is all it changes.
_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<b>[!-&(-/:;=?@\[-`{|}~]*)$"


class Encoder:
    """Token ids of whole texts. Spaces and line ends bound tokens, so each distinct word part between them is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # one model in memory
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = (np.zeros(0, t) for t in ("<u4", np.int64, np.int64))

    def _learn(self, keys: pa.Array, at_once: int = 20_000) -> None:
        """Encodes new keys: word parts, or whole chunks behind a line end."""
        odd = pc.starts_with(keys, "\n")
        ids, sizes = [self.ids], [self.sizes]
        plain, chunks = keys.filter(pc.invert(odd)), keys.filter(odd)
        for i in range(0, len(plain), at_once):
            some = plain.slice(i, at_once).to_pylist()
            e = self.bare.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, "<u4"))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        for i in range(0, len(chunks), at_once):
            got = [e.ids for e in self.whole.encode_batch([c[1:] for c in chunks.slice(i, at_once).to_pylist()], add_special_tokens=False)]
            ids.append(np.array([x for g in got for x in g], "<u4"))
            sizes.append(np.array([len(g) for g in got], np.int64))
        self.known = pa.concat_arrays([self.known, plain, chunks])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array without nulls, and where each text's begin (and the last one's end)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary
        parts = pc.extract_regex(names, _PLAIN)
        plain = pc.and_(pc.is_valid(parts), pc.less(pc.utf8_length(names), 100))
        first = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "a")), pc.binary_join_element_wise("\n", names, ""))
        second = pc.if_else(plain, pc.struct_field(parts, "b"), "")
        keys = pa.concat_arrays([first, second]).dictionary_encode()
        del parts, first, second
        if len(self.known) > REMEMBERED:
            self._forget()
        place = pc.index_in(keys.dictionary, self.known)
        if place.null_count:
            self._learn(keys.dictionary.filter(pc.is_null(place)))
            place = pc.index_in(keys.dictionary, self.known)
        both = place.to_numpy()[keys.indices.to_numpy()].reshape(2, -1)
        at = both[:, coded.indices.to_numpy()].T.ravel()  # two parts a chunk
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[2 * (bounds - bounds[0])]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first into the fullest bin that has room."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        place[i], offset[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return place, offset


_LOCAL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, bin long, offset long, fill long"


def _local(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.string()).fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(doc_ids):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_AT_ONCE, "right")))
                ids, bounds = enc.encode(texts.slice(at, to - at))
                for d, a, b in zip(doc_ids[at:to], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    raw = ids[a:b].tobytes() + end
                    for k in range(0, len(raw), 4 * capacity):
                        piece = raw[k : k + 4 * capacity]
                        yield d, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), piece if keep_ids else None
                at = to

    def packed(got, part, first):
        length = np.array([g[3] for g in got], np.int64)
        place, offset = best_fit(length, capacity)
        fill = np.bincount(place, length).astype(np.int64)
        columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        columns += [pa.array(np.full(len(got), part, np.int32)), pa.array((part << 32) + first + place), pa.array(offset), pa.array(fill[place])]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _LOCAL.split(", ")]), len(fill)

    def run(batches):
        part, first, got = TaskContext.get().partitionId(), 0, []
        for row in rows(batches):
            got.append(row)
            if len(got) == AT_ONCE:
                out, n = packed(got, part, first)
                yield out
                first, got = first + n, []
        if got:
            yield packed(got, part, first)[0]
        give_back()

    return run


def _merge(capacity: int):
    """Packs the items (bin, fill) of a tree node; each one's host is the item at the start of its sequence."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # not in the workers that encode

        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        fill = frame["fill"].to_numpy()
        place, offset = best_fit(fill, capacity)
        host = np.zeros(place.max() + 1, np.int64)
        host[place[offset == 0]] = frame["bin"].to_numpy()[offset == 0]
        total = np.bincount(place, fill).astype(np.int64)
        keep = total < capacity - SLACK
        return pd.DataFrame({"bin": frame["bin"], "part": frame["part"], "host": host[place], "at": offset, "total": total[place], "open": keep[place]})

    return run


def _dealt(items: DataFrame, width: int, most: int) -> DataFrame:
    """items with node and deal: so many of one node and deal as one task takes. There are at most as many nodes as partitions."""
    nodes = items.withColumn("node", F.expr(f"part div {width}"))
    deals = nodes.groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias("deals"))
    return nodes.join(F.broadcast(deals), "node").withColumn("deal", F.pmod(F.xxhash64("bin", F.lit(width)), F.col("deals"))).drop("deals")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False, items_at_once: int = ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs(doc_id, text), and with keep_ids its ids.

    tokenizer: path of a tokenizer file whose pre-tokenizer parts words at spaces and at the border of letters and marks.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = saved(docs.mapInArrow(_local(tokenizer, capacity, end_id, keep_ids), _LOCAL))
    items = pieces.where(f"offset = 0 AND fill < {capacity - SLACK}").select("bin", "part", "fill")
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    where = items.select("bin", F.col("bin").alias("host"), F.lit(0).cast("long").alias("at"))
    width = 1
    while width < parts:
        width *= FAN_IN
        groups = _dealt(items, width, items_at_once).groupBy("node", "deal")
        merged = saved(groups.applyInPandas(_merge(capacity), "bin long, part int, host long, at long, total long, open boolean"))
        step = merged.select(F.col("bin").alias("host"), F.col("host").alias("next"), F.col("at").alias("more"))
        where = saved(where.join(step, "host", "left").select("bin", F.coalesce("next", "host").alias("host"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
        items = merged.where("at = 0 AND open").select("bin", "part", F.col("total").alias("fill"))
    placed = pieces.join(where, "bin", "left")
    out = placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("host", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"), "ids")
    return out if keep_ids else out.drop("ids")
