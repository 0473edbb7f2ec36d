"""Vector code compression: product quantization in whole numbers, assigned by Orchard's search.

Every codebook entry keeps a list of the other entries by distance. A part starts at one entry and goes down its list; an entry
that is nearer becomes the current one and its list is gone down from the start, entries met before are skipped by a mark, and
once the list's next entry is farther from the current one than twice the part's distance, the triangle inequality rules out all
that follow. The comparison is strict on squared whole numbers, so that ties are seen and go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import saved, small_batches

#: Components are floor(SCALE * x).
SCALE = 4096
#: Whole-number components stay below this size, so that no sum of squares of a row overflows.
LARGEST = 1 << 26
#: Label sums are broadcast up to this many; labels of more rows than a share of 1 / LABELS are fewer than this, too.
LABELS = 100_000


class Lists:
    """An entry table with its neighbour lists: order[c] are all entries by distance from c (c itself first), far[c] the squared distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        square = (gap * gap).sum(axis=2)
        np.fill_diagonal(square, -1)  # so that an entry comes first in its own list also if others equal it
        self.order = np.argsort(square, axis=1, kind="stable")
        self.far = np.maximum(np.take_along_axis(square, self.order, 1), 0)
        self.start = int(np.argmin(self.far.sum(axis=1)))


def orchard(lists: Lists, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row of parts; all rows go on with their own search side by side."""
    n, k = len(parts), len(lists.entries)
    now = np.full(n, lists.start)
    gap = parts - lists.entries[lists.start]
    best = (gap * gap).sum(axis=1)
    met = np.zeros((n, k), bool)
    met[:, lists.start] = True
    at = np.ones(n, np.int64)  # position 0 is the entry itself
    open_ = np.arange(n if k > 1 else 0)
    while len(open_):
        c, p = now[open_], at[open_]
        going = lists.far[c, p] <= 4 * best[open_]
        open_, c, p = open_[going], c[going], p[going]
        other = lists.order[c, p]
        at[open_] += 1
        fresh = ~met[open_, other]
        who, other = open_[fresh], other[fresh]
        met[who, other] = True
        gap = parts[who] - lists.entries[other]
        square = (gap * gap).sum(axis=1)
        nearer = (square < best[who]) | ((square == best[who]) & (other < now[who]))
        moved = who[nearer]
        now[moved], best[moved], at[moved] = other[nearer], square[nearer], 1
        open_ = open_[at[open_] < k]
    return now, best


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """The components of a list column as whole numbers, a row a vector of width components."""
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), width)
    out = np.floor(values * SCALE)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"vector components must be below {LARGEST / SCALE:g} in size")
    return out.astype(np.int64)


def _assigned(whole: np.ndarray, books: list[Lists]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), a row a vector and a column a part."""
    step = whole.shape[1] // len(books)
    found = [orchard(book, whole[:, i * step : (i + 1) * step]) for i, book in enumerate(books)]
    return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """Codebooks [part, entry, component] of a stored table rows(vec_id, vec) of vectors of one length; None without a vec_id.

    A round is one pass over the rows: tasks add up sums and counts of their parts an entry, and parts x entries rows come to
    the driver. Codebooks start as the vectors of the smallest vec_ids (ties by the vector); fewer rows make fewer entries.
    """
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vec").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].vec)
    if width == 0 or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    step = width // parts
    start = _whole(pa.array([[float(x) for x in r.vec] for r in first]), width)
    books = start.reshape(len(first), parts, step).transpose(1, 0, 2).copy()
    names = [f"s{i}" for i in range(step)]
    for _ in range(rounds):
        lists = [Lists(b) for b in books]

        def run(batches, lists=lists):
            n = len(lists[0].entries)
            sums, counts = np.zeros((parts * n, step), np.int64), np.zeros(parts * n, np.int64)
            for batch in batches:
                whole = _whole(batch.column(0), width)
                index, _ = _assigned(whole, lists)
                cell = (index + np.arange(parts) * n).ravel()
                counts += np.bincount(cell, minlength=parts * n)
                np.add.at(sums, cell, whole.reshape(-1, step))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * n)), pa.array(counts), *(pa.array(sums[:, i].copy()) for i in range(step))], ["cell", "n", *names])

        totals = rows.select("vec").mapInArrow(run, ", ".join(["cell bigint", "n bigint", *(f"{c} bigint" for c in names)])).groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
        for row in totals.where("n > 0").collect():  # parts x entries rows
            books[row.cell // len(first), row.cell % len(first)] = [row[c] // row.n for c in names]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows(vec_id, label, vec); null code and error for vectors of another length than the codebooks'."""
    lists, width = [Lists(b) for b in books], books.shape[0] * books.shape[2]
    hexes = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches):
        for batch in batches:
            whole = _whole(batch.column(2), width)
            index, square = _assigned(whole, lists)
            code = ["".join(r) for r in hexes[index].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(square.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    fits = F.size("vec") == width
    coded = rows.where(fits).select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")
    return coded.unionByName(rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")))


def with_label_error(coded: DataFrame, most: int = LABELS) -> DataFrame:
    """A stored table coded(..., label, error) with label_error, the sum of error over rows of the same label, nulls together.

    Sums are one row a label. Up to most of them are broadcast; of more, those of labels with over 1 / most of all rows (fewer than
    most, by counting) are broadcast and the others joined by a shuffle, in which no label is frequent.
    """
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    labels, rows = sums.agg(F.count("*"), F.sum("n")).first()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(F.col("label").alias("__label"), "label_error")
        return left.join(right, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")

    if labels <= most:
        return joined(coded, F.broadcast(sums))
    common = sums.where(F.col("n") > F.lit(rows // most))
    names = F.broadcast(common.select(F.col("label").alias("__l")))
    rare = coded.join(names, F.col("label").eqNullSafe(F.col("__l")), "left_anti")
    return joined(coded, F.broadcast(common)).unionByName(joined(rare, sums.where(F.col("n") <= F.lit(rows // most))))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors(vec_id, label, <vector>).

    Rows with a null vector or a null or non-finite component are left out. A null vec_id is coded as any other, but starts no
    codebook; repeated rows are coded each. Vectors of another length than that of the smallest vec_id keep their row with
    null code and error and no part in the codebooks. If no row has a vec_id there are no codebooks: all these columns are null.
    Components of 16,384 or more in size raise a ValueError, and so do lengths that can't be cut. Other columns aren't read.
    """
    small_batches(vectors.sparkSession)
    rows = saved(usable(vectors.select("vec_id", "label", F.col(vector).alias("vec")), "vec"))
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vec").select(F.size("vec").alias("n")).first()
    if first is None:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("bigint").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    books = train(rows.where(F.size("vec") == first.n), parts, entries, rounds)
    out = with_label_error(saved(encode(rows, books)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
