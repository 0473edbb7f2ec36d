"""Toxicity scores: a learned lexicon, misspellings caught by Levenshtein automata over its trie, and context windows.

fit() takes at most ``SAMPLE`` labelled training rows, those with the least hash of doc_id. Lexicon terms are words, and
stems that begin words, which occur in toxic documents in at least ``SUPPORT`` different surroundings (so that copies of
one text don't count) and hardly in others; the best ``TERMS`` are the model. A word is a run of letters, with single digits
or signs between letters as part of it. Each distinct word of a text runs through the trie once: the walk keeps the last two
rows of the Levenshtein automaton a node, counts a swap of neighbours as one edit, and leaves a branch as soon as no state is
within ``EDITS``. A term keeps its misspellings only if these are as rare in the clean training rows. Hits within quotation marks or beside a reporting word
count as quoted, others as abuse; a logistic model over both, the strongest term and the share of hits gives the score.

Null and empty texts have no hits and get the score of a text without any. Rows that repeat a doc_id are scored each.
Labels that repeat a doc_id count once, as toxic if any is; null labels are left out. With no usable labels (or only one
class of them) every text gets the share of toxic labels, or 0 with none. A null doc_id isn't held out. An empty table
gives an empty result. Other columns pass through if asked for.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import give_back, saved, small_batches

SAMPLE, SUPPORT, PRECISION, TERMS, EDITS, WINDOW, THRESHOLD = 10_000, 4, 0.8, 1000, 1, 6, 0.7
STEMS = (5, 6, 7)
REMEMBERED = 150_000
#: Texts that are scored at once.
AT_ONCE = 250
_WORD = re.compile(r"[^\W\d_]+(?:[\d*@$!#][^\W\d_]+)*")
# Fixed word lists.
REPORTING = frozenset("said says wrote writes called quoted quote word term dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
QUOTES = frozenset("\"“”„«»‘’")


class Trie:
    """Terms by letters, searched by a Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def near(self, word: str, edits: int) -> tuple[str, int] | None:
        """The nearest term within edits (the first by order if several are as near) and its distance; a swap of neighbours is one edit."""
        best: tuple[int, str] | None = None
        first = list(range(len(word) + 1))
        todo = [(self.root, "", first, first)]
        while todo:
            node, last, before, row = todo.pop()
            if (t := node.get("")) is not None and row[-1] <= edits and (best is None or (row[-1], t) < best):
                best = (row[-1], t)
            for c, child in node.items():
                if c:
                    new = [row[0] + 1]
                    for j, w in enumerate(word):
                        n = min(new[j] + 1, row[j + 1] + 1, row[j] + (w != c))
                        if j and last and w == last and word[j - 1] == c:
                            n = min(n, before[j - 1] + 1)
                        new.append(n)
                    if min(new) <= edits or min(row) < edits:
                        todo.append((child, c, row, new))
        return None if best is None else (best[1], best[0])


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    fuzzy: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=lambda: [0.0])

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The hits of one worker: each distinct word is looked up once and remembered."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(sorted(model.fuzzy))
        self.heads = {t[: len(t) // 2] for t in model.fuzzy}
        self.tails = {t[len(t) // 2 :] for t in model.fuzzy}
        # A swap at the middle leaves neither half whole.
        self.heads |= {t[: len(t) // 2 - 1] + t[len(t) // 2] for t in model.fuzzy}
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.stem_sizes = sorted({len(s) for s in model.stems})
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, float, int]] = {}

    def look_up(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of a word, if it is a hit."""
        m = self.model
        if word in m.words:
            return word, m.words[word], 0
        for n in self.stem_sizes:
            if word[:n] in m.stems:
                return word[:n], m.stems[word[:n]], 0
        # One edit but a swap at the middle leaves a term's first half whole at the word's start, or its second half at the end.
        if any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes):
            if (found := self.trie.near(word, EDITS)) is not None:
                return found[0], m.words[found[0]], found[1]
        return None

    def features(self, text: str) -> tuple[list[float], set[str]]:
        """The model's inputs, and the terms that the text has misspelled only."""
        lower = text.lower()
        distinct = set(_WORD.findall(lower))
        if len(self.known) > REMEMBERED:
            self.known, self.hits = set(), {}
        for w in distinct - self.known:
            if (hit := self.look_up(w)) is not None:
                self.hits[w] = hit
        self.known |= distinct
        mine = distinct & self.hits.keys()
        if not mine:
            return [1.0, 0.0, 0.0, 0.0, 0.0], set()
        abuse = quoted = strongest = 0.0
        found = list(_WORD.finditer(lower))
        for i, m in enumerate(found):
            if m[0] in mine:
                term, weight, edits = self.hits[m[0]]
                first, last = found[max(0, i - WINDOW)].start(), found[min(len(found) - 1, i + WINDOW)].end()
                before, after = lower[first : m.start()], lower[m.end() : last]
                told = any(found[j][0] in REPORTING for j in range(max(0, i - WINDOW), i))
                if (any(c in QUOTES for c in before) and any(c in QUOTES for c in after)) or told:
                    quoted += 1
                else:
                    abuse += 1.0 if edits == 0 else 0.7
                    strongest = max(strongest, weight if edits == 0 else 0.7 * weight)
        exact = {self.hits[w][0] for w in mine if self.hits[w][2] == 0}
        only = {self.hits[w][0] for w in mine} - exact
        return [1.0, math.log1p(abuse), strongest, math.log1p(quoted), math.sqrt(abuse / len(found))], only


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(batches):
    """term, kind, toxic and surroundings of each distinct word and stem of a text."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            w = _WORD.findall((text or "").lower())
            first: dict[tuple[str, int], int] = {}
            for i, x in enumerate(w):
                if 3 <= len(x) <= 40:
                    first.setdefault((x, 0), i)
                for n in STEMS:
                    if len(x) > n:
                        first.setdefault((x[:n], 1), i)
            near = [zlib.crc32(" ".join([*w[max(0, i - 1) : i], "", *w[i + 1 : i + 2]]).encode()) for i in first.values()]
            columns = [pa.array([t for t, _ in first], pa.string()), pa.array([k for _, k in first], pa.int32()), pa.array([toxic] * len(first), pa.int32()), pa.array(near, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "kind", "toxic", "near"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method; the first column, the constant, isn't held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge * max(1.0, len(y) / 100))
    hold[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled rows of docs that aren't held out; lexicon and rows of features, both bounded, come to the driver."""
    small_batches(docs.sparkSession)
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"))
    classes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(1, n1 + n0), 1e-6), 1 - 1e-6)
        return Model(weights=[math.log(share / (1 - share)) if n1 + n0 else -30.0])
    spread = rows.repartition(max(1, min(64, rows.sparkSession.sparkContext.defaultParallelism * 2)))
    counted = spread.select("text", "toxic").mapInArrow(_terms, "term string, kind int, toxic int, near long").groupBy("term", "kind", "toxic", "near").agg(F.count("*").alias("n"))
    pos, neg = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    terms = counted.groupBy("term", "kind").agg(pos.alias("pos"), neg.alias("neg"), F.sum("toxic").alias("places"))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1) / ((F.col("neg") + 0.5) / (n0 + 1)))
    good = terms.where(F.col("places") >= SUPPORT).where(F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg"))).withColumn("weight", weight)
    best = good.orderBy((F.col("weight") * F.sqrt("pos")).desc(), "term", "kind").limit(TERMS).collect()
    words = {r.term: r.weight for r in best if r.kind == 0}
    whole = {r.term: r.pos for r in best if r.kind == 0}
    # A stem must say more than the words of the lexicon that begin with it.
    stems = {r.term: r.weight for r in best if r.kind == 1 and r.pos > 1.5 * max((n for t, n in whole.items() if t.startswith(r.term)), default=0)}
    model = Model(words, stems, {t for t in words if len(t) >= 5})

    def features(batches):
        matcher = model.matcher()
        for batch in batches:
            got = [matcher.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([sorted(g[1]) for g in got], pa.list_(pa.string()))], ["toxic", "x", "only"])

    schema = "toxic int, x array<double>, only array<string>"
    loose = saved(spread.select("text", "toxic").mapInArrow(features, schema)).where("toxic = 0").select(F.explode("only").alias("term")).groupBy("term").count().where(F.col("count") > n0 / 2000).collect()
    model.fuzzy -= {r.term for r in loose}
    got = spread.select("text", "toxic").mapInArrow(features, schema).select("toxic", "x").collect()  # at most sample rows
    model.weights = _logistic(np.array([r.x for r in got]), np.array([r.toxic for r in got], float)).tolist()
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (doc_id unless told) of docs(doc_id, text, ...) with held_out, score and predicted; these replace columns of the same name."""
    small_batches(docs.sparkSession)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in ("held_out", "score", "predicted")]
    own = held_out(F.col("doc_id")) if "doc_id" in docs.columns else F.lit(False)

    def run(batches):
        matcher, w = model.matcher(), np.array(model.weights)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                x = np.array([matcher.features(t or "")[0][: len(w)] for t in some.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("own"), pa.array(p)], ["row", "own", "score"])
        del matcher
        give_back()

    rows = docs.select((F.struct(*keep) if keep else F.struct(F.lit(True))).alias("row"), own.alias("own"), "text")
    scored = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, own boolean, score double")
    return scored.select(*(F.col("row")[c].alias(c) for c in keep), F.col("own").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
