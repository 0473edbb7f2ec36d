"""Helpers that the operators share: tables, work folders and word hashing."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
_SPACE_BYTES = np.array([9, 10, 11, 12, 13, 32])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local applications that have no shared one set.
_temporary: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Where that is unset, a temporary folder will do in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _temporary:
            _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="marquee-")
        base = _temporary[spark.sparkContext.applicationId]
    return f"{base.rstrip('/')}/marquee-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all work tables of this application; call it when the results are written."""
    _delete(spark, work_root(spark))


def saved(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there and lost executors lose nothing."""
    path = f"{work_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(table_: DataFrame) -> None:
    """Deletes what saved() wrote; only what was derived from it and saved itself may be used afterwards."""
    _delete(table_.sparkSession, table_.saved_path)


#: Rows of an Arrow batch. Rows are whole texts here; Spark's own limit of 10,000 can be hundreds of megabytes a worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession, times: int = 1) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * times


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as a worker stays for tasks of other kinds."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """run(batches) of mapInArrow, with give_back() after its last batch."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with out: 1, 2, ... by order. Rows are sorted by ranges and written once; the counts of the ranges, one row a partition, give the offsets."""
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for row in sorted(rows.groupBy(part.alias("p")).count().collect()):
        offsets.append((row.p, before))
        before += row["count"]
    offset = df.sparkSession.createDataFrame(offsets, "__p bigint, __before bigint")
    number = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("__before")
    return rows.withColumn("__p", part).join(F.broadcast(offset), "__p").withColumn(out, number).drop("__p", "__at", "__before")


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


# ---- word hashes over Arrow buffers, in blocks of whole texts ----

_BLOCK = 1 << 20
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[_SPACE_BYTES] = True
_powers: dict[int, np.ndarray] = {}
#: Sums modulo 2 ** 64 tell short words apart, but not long ones of a periodic build (the Thue-Morse words of 1,024 letters): words
#: of more bytes than this are hashed by BLAKE2.
_LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + 1), base)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= _BLOCK + 1:
            _powers[int(base)] = have
    return have[:n]


def text_blocks(column):
    """Yields (first row, bytes, offsets) of a string column, in blocks of about a megabyte and at least one text."""
    import pyarrow as pa

    column = column.cast(pa.string()) if column.type != pa.string() else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def block_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(starts, ends, hashes, bounds): each word's bytes and 64-bit hash; words bounds[i]:bounds[i + 1] are text i's."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    gap = np.ones(n + 2, bool)
    gap[1 : n + 1] = _IS_SPACE[data]
    inside = ~gap[1 : n + 1]
    starts = np.flatnonzero(inside & (gap[:n] | edge[:n]))
    ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * _power(_P, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_P_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        word = data[starts[i] : ends[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int, factor: np.uint64 = _Q) -> np.ndarray:
    """Hashes of each k consecutive words; the caller leaves out those that cross two texts."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * factor + hashes[i : i + m]
    return mix(out)
