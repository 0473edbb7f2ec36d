"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees with one priority queue a query.

Trees are fitted on a bounded sample of distinct vectors: a node is split by the direction between two of its sample points, at
the middle of the sample. Every row is then sent down all trees. A query walks the trees through one shared queue, in which a
branch waits with the largest distance by which the query missed it on the way, and takes leaves in that order until they hold
``effort`` rows. The effort is the least that reaches ``RECALL`` on a bounded sample of queries answered by brute force.

Leaves and the queries that visit them meet in blocks, whose inner products keep the best of each query; no vector is joined with
another one by one, and a leaf of many rows (copies can't be split) is dealt out over several blocks. The sample rows in the
leaves that a query visits give a bound which at least k of its rows reach: what lies below it isn't handed on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import saved, small_batches

#: Trees of the forest; rows a leaf aimed at, and the most leaves a tree has (trees are sent to all tasks: 8 MB of planes at 64 dimensions).
TREES, LEAF_ROWS, LEAVES = 16, 200, 1024
#: Rows that trees are fitted on, and bounds taken from, at most (sent to all tasks, too).
SAMPLE = 16_384
#: Queries that the effort is measured on, at most, and the recall that it has to reach on them (0.9 is asked for).
TRIALS, RECALL = 200, 0.94
#: Rows of a block, on average.
BLOCK = 1024
#: Found rows that a task gathers before it hands on the best of each query.
GATHER = 500_000


@dataclass
class Forest:
    """Nodes of all trees in one numbering. Inner nodes: plane, bound and two children; leaves: their number in leaf, else -1."""

    planes: np.ndarray
    bounds: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    roots: list[int]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree, [row, tree]."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            waiting = [(root, np.arange(len(x)))]
            while waiting:
                node, rows = waiting.pop()
                if self.leaf[node] >= 0:
                    out[rows, t] = self.leaf[node]
                    continue
                left = self._missed(node, x[rows]) <= 0
                waiting.extend([(self.children[node, 0], rows[left]), (self.children[node, 1], rows[~left])])
        return out

    def _missed(self, node: int, x: np.ndarray) -> np.ndarray:
        """Signed distance of each row from a node's plane, added up in one order whatever the rows beside it."""
        return (x * self.planes[node]).sum(axis=1) - self.bounds[node]

    def visits(self, x: np.ndarray, sizes: np.ndarray, effort: float) -> list[int]:
        """Leaves for one query x, best first, until they hold effort rows."""
        signed = (self.planes @ x - self.bounds).tolist()
        leaf, children, rows, out = self.leaf, self.children, 0, []
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        while queue and rows < effort:
            missed, node = heapq.heappop(queue)
            while leaf[node] < 0:
                d = signed[node]
                near, far = children[node] if d <= 0 else children[node][::-1]
                heapq.heappush(queue, (max(missed, abs(d)), far))
                node = near
            if sizes[leaf[node]]:
                out.append(int(leaf[node]))
                rows += sizes[leaf[node]]
        return out


def fit(sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 42) -> Forest:
    """A forest over distinct sample rows, of at most leaves leaves a tree."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    planes, bounds, children, leaf, roots, leaf_count = [], [], [], [], [], 0
    width = sample.shape[1] if sample.ndim == 2 else 0
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))

    def new() -> int:
        planes.append(np.zeros(width))
        bounds.append(0.0)
        children.append((-1, -1))
        leaf.append(-1)
        return len(leaf) - 1

    for _ in range(trees):
        roots.append(new())
        waiting = [(roots[-1], np.arange(len(sample)), 0)]
        while waiting:
            node, rows, level = waiting.pop()
            if level == depth or len(rows) < 2:
                leaf[node] = leaf_count
                leaf_count += 1
                continue
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = (a - b) / np.sqrt(((a - b) ** 2).sum())
            along = (sample[rows] * plane).sum(axis=1)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            planes[node], bounds[node] = plane, float(along[order[half - 1]] + along[order[half]]) / 2
            left = along <= bounds[node]
            children[node] = (new(), new())
            waiting += [(children[node][0], rows[left], level + 1), (children[node][1], rows[~left], level + 1)]
    return Forest(np.array(planes), np.array(bounds), np.array(children), np.array(leaf), roots)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id and vec, one row a vec_id, of the rows that take part; see search()."""
    x = F.col("vec")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(~odd & F.exists(x, lambda v: v != 0))
    repeated = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not repeated.isEmpty():
        once = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(once)
    first = rows.agg(F.min_by(F.size("vec"), "vec_id")).first()[0]
    return rows.where(F.size("vec") == F.lit(first or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1 if len(column) else 0)


def _some(df: DataFrame, rows: int, of: int, salt: int) -> DataFrame:
    """About rows of the of rows of df, and at most 1.3 times as many, told by a hash of their ids."""
    share = 1 << 40 if of <= rows else (1 << 40) * rows // of
    return df.where(F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 40)) < share).limit(int(1.3 * rows) + 10)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _rough(q: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Inner products but for rounding, -inf with a query's own row."""
    out = q @ rows.T
    out[own[:, None] == ids[None, :]] = -np.inf
    return out


def bounds(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, held: list[np.ndarray], k: int) -> np.ndarray:
    """For every query a score, but for rounding, that k of the rows held for it reach; -inf if it holds fewer."""
    out = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        rough = _rough(queries[at : at + 256], q_ids[at : at + 256], rows, ids)
        for i, one in enumerate(rough):
            mine = one[held[at + i]]
            if len(mine) >= k:
                out[at + i] = np.partition(mine, len(mine) - k)[len(mine) - k]
    return out


def best_pairs(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None):
    """(query id, row id, score) of each query's k best rows without its own, of those that reach its bound if given; ties to smaller ids, copies have equal scores."""
    out = []
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], q_ids[at : at + 256]
        rough = _rough(q, own, rows, ids)
        n = min(k, len(ids))
        least = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
        if bound is not None:
            least = np.maximum(least, bound[at : at + 256])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))  # more than rounding of the rough product
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        score = np.concatenate([exact(q[i[s : s + 100_000]], rows[j[s : s + 100_000]]) for s in range(0, len(i), 100_000)] or [np.zeros(0)])
        out.append(_best(own[i], ids[j], score, k))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best distinct ids of each query."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    again = np.zeros(len(query), bool)
    again[1:] = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1])  # an id has one score, so that it stands beside itself
    query, ids, score = query[~again], ids[~again], score[~again]
    begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(query)]])))
    return query[place < k], ids[place < k], score[place < k]


class _Gathered:
    """Found pairs of a task; once there are many, only the best of each query stay, and if these are many too they are handed on."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows = k, [], 0

    def add(self, found):
        self.parts.append(found)
        self.rows += len(found[0])
        if self.rows > GATHER:
            yield from self.all(GATHER // 2)

    def all(self, spare: int = 0):
        if self.parts:
            best = _best(*(np.concatenate([p[c] for p in self.parts]) for c in range(3)), self.k)
            self.parts, self.rows = ([best], len(best[0])) if len(best[0]) < spare else ([], 0)
            if not self.parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "vec_id", "score"])


_FOUND = "query_id bigint, vec_id bigint, score double"
_RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """query_id, vec_id, score, rank, leaves: the exact k nearest rows(vec_id, vec, leaves) of a bounded set of queries (ids, vectors)."""
    q_ids, q = queries

    def run(batches):
        kept = _Gathered(k)
        for batch in batches:
            yield from kept.add(best_pairs(q, q_ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k))
        yield from kept.all()

    found = _ranked(rows.select("vec_id", "vec").mapInArrow(run, _FOUND), k)
    return rows.select("vec_id", "leaves").join(F.broadcast(found), "vec_id")


def effort_for(forest: Forest, sizes: np.ndarray, trials: list[tuple[np.ndarray, np.ndarray]], recall: float = RECALL) -> float:
    """Rows to look through so that the trials, each a query and the leaves of its true neighbours [neighbour, tree], reach recall on average."""
    needed = []
    for x, leaves in trials:
        order = forest.visits(x, sizes, float("inf"))
        reached = np.full(len(sizes), np.inf)
        reached[order] = np.cumsum(sizes[order])
        needed.append(reached[leaves].min(axis=1))
    if not needed:
        return float(sizes.sum())
    # Each query counts the same, however many neighbours it has.
    rows, weight = np.concatenate(needed), np.concatenate([np.full(len(n), 1 / len(n)) for n in needed])
    order = np.argsort(rows, kind="stable")
    share = np.cumsum(weight[order]) / len(needed)
    return float(rows[order][min(int(np.searchsorted(share, recall)), len(rows) - 1)])


def _blocks(rows: DataFrame, keys: list[str], id_: str, out: str, *more: str) -> DataFrame:
    """One row a block: keys and out, a list of (id, vec, more)."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(id_).alias("id"), "vec", *more)).alias(out))


def search(vectors: DataFrame, queries, vector: str = "embedding", k: int = 20, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: k near rows by inner product of every row of vectors(vec_id, <vector>) that queries, a condition, holds for.

    Rows that are null, zero or hold null or non-finite components, and rows without a vec_id, take no part. Rows that repeat a
    vec_id count once, with the least of their vectors. Lengths other than that of the smallest vec_id take no part either.
    A query's own vec_id isn't among its rows; ties go to smaller vec_ids, and copies of a vector have equal scores. Fewer than k
    other rows are all found. An empty table gives an empty result. Other columns aren't read.
    """
    small_batches(vectors.sparkSession)
    rows = usable(vectors, vector)
    n = rows.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    sample = _some(rows, SAMPLE, n, 1).select("vec_id", "vec").toArrow()
    known, known_ids = _matrix(sample.column("vec").combine_chunks()), sample.column("vec_id").to_numpy()
    forest = fit(known, min(LEAVES, -(-n // LEAF_ROWS)), trees)
    known_leaves = forest.leaves_of(known)
    kind = rows.schema["vec"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            leaves = forest.leaves_of(_matrix(batch.column(1)))
            listed = pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["vec_id", "vec", "leaves"])

    index = saved(rows.mapInArrow(assign, f"vec_id bigint, vec {kind}, leaves array<int>"))
    sizes = np.zeros(int(forest.leaf.max()) + 1, np.int64)
    for leaf, count in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # at most trees x LEAVES rows
        sizes[leaf] = count
    asked = index.where(queries)
    n_asked = asked.count()
    if n_asked == 0:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    tried = _some(asked, TRIALS, n_asked, 2).select("vec_id", "vec").toArrow()
    trial_ids, trial = tried.column("vec_id").to_numpy(), _matrix(tried.column("vec").combine_chunks())
    truth: dict[int, list] = {}
    for row in brute_force(index, (trial_ids, trial), k).select("query_id", "leaves").collect() if len(trial) else []:  # trials x k rows
        truth.setdefault(row.query_id, []).append(row.leaves)
    effort = effort_for(forest, sizes, [(x, np.array(truth[i])) for i, x in zip(trial_ids.tolist(), trial, strict=True) if i in truth], recall)
    # Below k + 1 rows a query's leaves couldn't hold all that is asked for.
    effort = max(effort, float(trees * (k + 1)))

    def walk(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            found, held, visited = [], [], np.zeros(len(sizes), bool)
            for q in x:
                found.append(forest.visits(q, sizes, effort))
                visited[:] = False
                visited[found[-1]] = True
                held.append(np.flatnonzero(visited[known_leaves].any(axis=1)))
            bound = bounds(x, batch.column(0).to_numpy(), known, known_ids, held, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound), pa.array(found, pa.list_(pa.int32()))], ["query_id", "vec", "bound", "leaves"])

    walks = saved(asked.select("vec_id", "vec").mapInArrow(walk, f"query_id bigint, vec {kind}, bound double, leaves array<int>"))
    visitors = dict(walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())
    spark = vectors.sparkSession
    plan = F.broadcast(spark.createDataFrame([(i, int(-(-s // BLOCK)), -(-visitors[i] // BLOCK)) for i, s in enumerate(sizes) if s and i in visitors], "leaf int, blocks int, query_blocks int"))

    def part(id_: str, of: str):
        return F.pmod(F.xxhash64(id_), F.col(of)).cast("int")

    left = index.select("vec_id", "vec", F.explode("leaves").alias("leaf")).join(plan, "leaf").withColumn("block", part("vec_id", "blocks"))
    right = walks.select("query_id", "vec", "bound", F.explode("leaves").alias("leaf")).join(plan, "leaf").withColumn("part", part("query_id", "query_blocks"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = _blocks(left.repartition("leaf", "block"), ["leaf", "block"], "vec_id", "rows")
    right = _blocks(right.repartition("leaf", "block"), ["leaf", "block", "part"], "query_id", "queries", "bound")
    pairs = left.join(right.hint("merge"), ["leaf", "block"]).select("rows", "queries")

    def multiply(batches):
        kept = _Gathered(k)
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(1)[i].values, batch.column(0)[i].values
                yield from kept.add(best_pairs(_matrix(a.field("vec")), a.field("id").to_numpy(), _matrix(b.field("vec")), b.field("id").to_numpy(), k, a.field("bound").to_numpy()))
        yield from kept.all()

    found = pairs.mapInArrow(multiply, _FOUND).distinct()
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
