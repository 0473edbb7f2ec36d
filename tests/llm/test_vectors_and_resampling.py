import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from marquee.llm import projection_forest, queries, resampling, vector_codes


def _vectors(spark, rows, extra=False):
    schema = "vec_id long, embedding array<float>, label int" + (", score double, leaf int, vec string" if extra else "")
    return spark.createDataFrame([(*r, 0.5, 1, "v") if extra else r for r in rows], schema)


def _random(n, width=16, seed=3, copies=0):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, width)).astype(np.float32)
    m[n - copies :] = m[0]
    return m


# ---- approximate nearest neighbours ----


def _plain_neighbours(m, ids, asked, k):
    out = {}
    for i in asked:
        score = [math.fsum([]) for _ in ids]
        total = np.zeros(len(ids))
        for d in range(m.shape[1]):
            total += m[i, d].astype(float) * m[:, d].astype(float)
        score = sorted((-total[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])
        out[ids[i]] = [(r + 1, v, -s) for r, (s, v) in enumerate(score[:k])]
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_forest_recall_and_scores(spark, sf):
    got = _found(queries.QUERIES["op11_projection_forest"](spark, sf))
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    m, ids = np.array([r.embedding for r in rows], np.float64), [r.vec_id for r in rows]
    want = _plain_neighbours(m, ids, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    assert got.keys() == want.keys()
    place = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, v, s in found:
            total = 0.0
            for a, b in zip(m[place[q]].tolist(), m[place[v]].tolist(), strict=True):
                total += a * b
            assert s == total
    hit = sum(len({f[1] for f in got[q]} & {f[1] for f in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_forest_with_all_recall_equals_brute_force_on_copies(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "LEAF_ROWS", 10)
    monkeypatch.setattr(projection_forest, "BLOCK", 16)
    monkeypatch.setattr(projection_forest, "GATHER", 50)
    m = _random(300, copies=110)
    ids = list(range(0, 600, 2))
    got = _found(projection_forest.search(_vectors(spark, [(i, v.tolist(), 0) for i, v in zip(ids, m, strict=True)], extra=True), "vec_id % 20 = 0", k=7, recall=1.0))
    assert got == _plain_neighbours(m, ids, [i for i, v in enumerate(ids) if v % 20 == 0], 7)


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 2.0], 0), (20, [0.0, 2.0], 1), (20, [0.0, 1.0], 1), (40, None, 0), (60, [0.0, 0.0], 0), (80, [nan, 1.0], 0), (100, [inf, 1.0], 0), (120, [1.0, None], 0), (None, [1.0, 1.0], 0), (140, [1.0], 0), (3, [0.0, 1.0], None), (1, [0.0, 1.0], None), (160, [], 0)]
    got = _found(projection_forest.search(_vectors(spark, rows), "vec_id % 20 = 0", k=20))
    assert got == {0: [(1, 1, 0.0), (2, 3, 0.0), (3, 20, 0.0)], 20: [(1, 1, 1.0), (2, 3, 1.0), (3, 0, 0.0)]}
    assert projection_forest.search(_vectors(spark, []), "vec_id % 20 = 0").collect() == []
    assert projection_forest.search(_vectors(spark, [(0, [1.0], 0)]), "vec_id % 20 = 0").collect() == []
    assert projection_forest.search(_vectors(spark, [(1, [1.0], 0), (2, [1.0], 0)]), "vec_id % 20 = 0").collect() == []


def test_leaves_of_a_walk_come_by_missed_distance():
    m = _random(500, seed=9).astype(np.float64)
    forest = projection_forest.fit(m, 16, trees=4)
    leaves = forest.leaves_of(m)
    sizes = np.bincount(leaves.ravel(), minlength=int(forest.leaf.max()) + 1)
    order = forest.visits(m[7], sizes, float("inf"))
    assert set(leaves[7]) == set(order[:4]) and sorted(order) == sorted(np.flatnonzero(sizes).tolist())

    def missed(leaf):  # the largest wrong turn on the way from the root
        best = []
        for root in forest.roots:
            stack = [(root, 0.0)]
            while stack:
                node, most = stack.pop()
                if forest.leaf[node] == leaf:
                    best.append(most)
                elif forest.leaf[node] < 0:
                    d = float(forest.planes[node] @ m[7] - forest.bounds[node])
                    for side, child in enumerate(forest.children[node]):
                        stack.append((child, most if (d <= 0) == (side == 0) else max(most, abs(d))))
        return min(best)

    way = [missed(leaf) for leaf in order]
    assert way == sorted(way)


# ---- vector codes ----


def _plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = len(kept[0][1]) // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in sorted(kept, key=lambda r: r[0])[:entries]), strict=True)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[nearest(book, cut(v)[p])[1]].append(cut(v)[p])
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, book, strict=True)])
        books = new
    found = [(i, [nearest(b, x) for b, x in zip(books, cut(v), strict=True)], label) for i, v, label in kept]
    total = {}
    for _, f, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[label], digest) for i, f, label in found)


def _codes(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_vector_codes_equal_plain_ones(spark):
    m = _random(300, seed=5, copies=120)
    m[40:60] = m[40]
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(m)]
    assert _codes(vector_codes.compress(_vectors(spark, rows, extra=True))) == _plain_codes(rows)
    assert _codes(vector_codes.compress(_vectors(spark, rows[:9]))) == _plain_codes(rows[:9])


def test_label_errors_of_many_labels(spark):
    rows = [(i, i % 40 if i < 60 else None, 1, i) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, label int, code int, error long")
    want = sorted(map(tuple, vector_codes.with_label_error(table).select("vec_id", "label_error").collect()))
    assert sorted(map(tuple, vector_codes.with_label_error(table, most=5).select("vec_id", "label_error").collect())) == want and len(want) == 200


def test_orchard_finds_nearest_entries_with_ties():
    r = np.random.default_rng(2)
    entries = r.integers(-3, 4, (16, 3))
    entries[5] = entries[2]
    parts = r.integers(-4, 5, (2000, 3))
    square = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    index, best = vector_codes.orchard(vector_codes.Lists(entries), parts)
    assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
    index, best = vector_codes.orchard(vector_codes.Lists(entries[:1]), parts)
    assert (index == 0).all() and (best == square[:, 0]).all()


def test_vector_codes_odd_rows(spark):
    ok = [0.5] * 8
    rows = [(1, ok, 1), (1, ok, 1), (2, None, 1), (3, [float("nan")] + ok[1:], 1), (4, [None] + ok[1:], 1), (None, ok, 2), (5, [0.25] * 4, 2), (6, [], None)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(_vectors(spark, rows)).collect()}
    assert got == {(1, "00" * 8, 0, 0), (None, "00" * 8, 0, 0), (5, None, None, 0), (6, None, None, None)}
    assert vector_codes.compress(_vectors(spark, [])).collect() == []
    assert {tuple(r) for r in vector_codes.compress(_vectors(spark, [(None, ok, 1)])).collect()} == {(None,) * 5}
    with pytest.raises(ValueError, match="cut"):
        vector_codes.compress(_vectors(spark, [(1, [1.0] * 9, 0)]))
    with pytest.raises(Exception, match="below"):
        vector_codes.compress(_vectors(spark, [(1, [1e6] * 8, 0)])).collect()


# ---- resampling ----

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = _WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _plain_draw(docs, target, percent=5):
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in docs:
        np.add.at(s, _plain_features(x)[1], 1)
    for x in target:
        np.add.at(t, _plain_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, x in docs:
        n, f = _plain_features(x)
        weight = sum(gain[b] for b in f)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0)))
        rows.append([d, len(f), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgÄñ漢", k=r.randint(1, 8))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(15, 90))) for _ in range(400)]
    odd = [None, "", " .,- ", "a", "a B", "a-b-c", "x" * 5000 + " y " + "z" * 70, ("w" * 64 + " " + "v" * 65 + " ") * 15, "Ünï " * 3000, texts[0], texts[0]]
    return [*enumerate(texts + odd), (None, texts[3]), (7, texts[7]), (7, texts[9])], texts[:5] + ["", None]


def test_resampling_equals_plain_version(spark, corpus):
    docs, target = corpus
    table = spark.createDataFrame([(d, x, "clash", 1.0) for d, x in docs], "doc_id long, text string, bucket string, score double")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    assert _drawn(resampling.resample(table, wanted)) == _plain_draw(docs, target)
    assert _drawn(resampling.resample(table, wanted.limit(0), percent=50)) == _plain_draw(docs, [], 50)
    assert resampling.resample(table.limit(0), wanted).collect() == []


def test_bracket_is_validated_and_widened(spark):
    rows = [(i, 30, 90, 0, i // 3) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[4], r[0]))[:150]]
    for error in (0.001, 0.2, 0.6):
        assert [r.doc_id for r in resampling.draw(table, 5, error).where("rank IS NOT NULL").orderBy("rank").collect()] == want
    same = table.withColumn("score", table.n_words)
    assert [r.doc_id for r in resampling.draw(same).where("rank IS NOT NULL").orderBy("rank").collect()] == list(range(150))

    class Wrong:  # a sketch that is far off: only widening finds the cutoff
        def __init__(self, df):
            self.df, self.stat = df, self

        def approxQuantile(self, column, probabilities, error):
            return [1.0, 2.0]

        def agg(self, *columns):
            return self.df.agg(*columns)

    lo, hi, above = resampling.bracket(Wrong(table), 150, 3000)
    assert above == 0 and hi == 999 and lo == 0


def test_crc_of_joined_words():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcxyz", k=r.choice([1, 3, 63, 64, 65, 66, 130, 400]))) for _ in range(60))
    data = np.frombuffer(text.encode(), np.uint8)
    words, runs = resampling.features(data, np.array([0, len(data)]))
    assert words.tolist() == [60] and [b for _, bucket in runs for b in bucket.tolist()] == _plain_features(text)[1]
