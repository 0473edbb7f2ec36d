"""Document fingerprints by consistent weighted sampling.

A text's terms are its words; a term's weight is the number of characters that it covers. Sample k of a text is the term
with the least ln(c) - r (t - b) - r, where r and c are Gamma(2, 1) variates and b is uniform, all drawn from the hash of
term and k, and t = floor(ln(weight) / r + b). Two texts share sample k (term and t) with the probability of their
generalised Jaccard similarity, sum of least weights over sum of greatest, so the share of equal samples estimates it.

Everything is built-in column functions and aggregates. Documents are dealt by ranges of doc_id, so that each one's
neighbour in descending order lies in its own partition; of each range the first document of the next range is a member,
too. One row may be any length; no group is gathered.

Null texts count as empty. A text without words has no samples: it equals other such texts (likeness 1) and no others.
Rows that repeat a doc_id are ordered by text and each gets its row; a null doc_id comes last in the order. A single
document is its own neighbour, an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import SPACES, partitions

SAMPLES = 32


def _gamma_steps(n: int = 256) -> list[float]:
    """The middles of n equally likely parts of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x)."""
    out = []
    for i in range(n):
        u, x = (i + 0.5) / n, 1.0
        for _ in range(60):
            x = max(1e-6, x - (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x)))
        out.append(round(x, 5))
    return out


GAMMA = _gamma_steps()


def sample(term: Column, log_weight: Column, steps: Column, k: int) -> Column:
    """Sample k of a term as one long: its value in the high bits, its identity in the low 24. r is drawn from steps, c and b by their formulas."""
    bits = F.xxhash64(term, F.lit(k))

    def uniform(shift: int, width: int) -> Column:
        return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 1) * F.lit(2.0**-width)

    r = F.get(steps, bits.bitwiseAND(F.lit(len(GAMMA) - 1)).cast("int"))
    c = -F.ln(uniform(8, 20) * uniform(28, 20))
    beta = uniform(48, 16)
    t = F.floor(log_weight / r + beta)
    value = F.ln(c) - r * (t - beta) - r
    identity = term.bitwiseXOR(t).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(((value + 80) * F.lit(2.0**32)).cast("long"), 24).bitwiseOR(identity)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse = F.size(F.filter(F.array(*(F.lit(b[0]) for b in blocks[1:])).cast("array<bigint>"), lambda x: x <= key))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, b)).cast("array<bigint>") for b in blocks)), coarse + 1)
    return coarse * width + F.size(F.filter(fine, lambda x: x <= key))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with part, pos (place in part, by descending doc_id), extra and next_text; rows with extra belong to another part, too."""
    n = partitions(docs.sparkSession, 4)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    bounds = sorted({int(x) for x in docs.approxQuantile("key", [i / (3 * n) for i in range(1, 3 * n)], 0.0005)})
    docs = docs.withColumn("part", _range_of(F.col("key"), bounds))
    heads = docs.groupBy("part").agg(F.max("key").alias("key"))  # a row for each range
    after = F.lead("key").over(Window.orderBy(F.col("part").desc()))
    heads = heads.select("part", F.coalesce(after, F.max("key").over(Window.partitionBy())).alias("key"))
    extra = docs.drop("part").join(F.broadcast(heads), "key").withColumn("extra", F.lit(True))
    dealt = docs.withColumn("extra", F.lit(False)).unionByName(extra).repartition(n, "part")
    order = Window.partitionBy("part").orderBy("extra", F.col("key").desc(), "text")
    return dealt.select("part", "extra", "doc_id", "text", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the next."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def samples_of(texts: DataFrame, keys: list[str], sides: int, samples: int = SAMPLES) -> DataFrame:
    """The keys and s{side}_{k} of texts(keys, sides: array<string>), by a plain group-by of the exploded words."""
    side = texts.select(*keys, F.posexplode("sides").alias("side", "text"))
    word = side.select(*keys, "side", F.explode(F.split("text", SPACES)).alias("word"))
    term = word.select(*keys, "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), F.char_length("word").alias("size"))
    weight = term.groupBy(*keys, "side", "term").agg(F.sum("size").alias("weight")).withColumn("weight", F.ln("weight"))
    steps = F.split(F.lit(",".join(map(str, GAMMA))), ",").cast("array<double>")
    own = [(s, k, F.when(F.col("side") == s, sample(F.col("term"), F.col("weight"), steps, k))) for s in range(sides) for k in range(samples)]
    return weight.groupBy(*keys).agg(*(F.coalesce(F.min(x), F.lit(-1)).alias(f"s{s}_{k}") for s, k, x in own))


def signature(frame: DataFrame, side: int, samples: int = SAMPLES) -> Column:
    return F.array(*(frame[f"s{side}_{k}"] for k in range(samples)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def text_of(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and signature (array<bigint>) of every row of docs(doc_id, text), without its neighbours."""
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array(F.coalesce("text", F.lit(""))).alias("sides"))
    got = samples_of(keyed, ["doc_id", "row"], 1, samples)
    return got.select("doc_id", signature(got, 0, samples).alias("signature"))


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs(doc_id, text)."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["part", "pos", "extra", "doc_id", "n_chars", "edited_sha256"]
    facts = rows.select("part", "pos", "extra", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array("text", "edited").alias("sides"))
    got = samples_of(facts, keys, 2, samples)
    got = got.select(*keys, signature(got, 0, samples).alias("own"), signature(got, 1, samples).alias("other"))
    got = got.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("pos"))).where(~F.col("extra"))
    return got.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
