"""Secret scan: three base patterns, and a battery of randomness tests over token-like strings.

Base spans: ``assign``, ``access`` and ``hex`` matches, leftmost and non-overlapping per kind. The battery takes every other
run of 20 or more token characters with a digit and a letter, infers its encoding (hex, base 32 or base 64), and tests
whether it looks drawn evenly from that alphabet: chi-squared over equal parts of the alphabet, runs above and below its
middle, and serial correlation of neighbours. The three p-values are joined by Bonferroni's rule. Over all documents, and
within each length class (longer strings have more power, so each class has its own threshold), Benjamini and Hochberg's
procedure at level ``FDR`` rejects the strings that aren't random; the rest are spans of kind ``random``. So what is held
at ``FDR`` is the share of true keys among the strings turned away; false alarms are strings too even or too short for the
tests to reject. Ranks come from counts of p-values in ``BINS`` equal steps of their logarithm, a table whose size doesn't
depend on the data.

Everything is built-in column functions. Null and empty texts have no spans and the hash of the empty string. Repeated
rows give repeated results, an empty table an empty one. Columns that are kept pass through; in find() an output column
replaces a column of its name, redact() keeps every column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import saved

# Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
KINDS = ["assign", "access", "hex", "random"]
FDR, BINS, STEPS = 0.05, 400, 20
#: Upper ends of the length classes; the last class is open.
LENGTHS = [31, 47, 63, 127]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points; value is the group."""
    hits, values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(state["found"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("found"))

    kind = "array<struct<start:int,end:int,value:string>>"
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
    found = F.aggregate(zipped, begin, step)["found"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _p_value(codes: Column, size: Column) -> Column:
    """The joined p-value of an array of symbol numbers below size."""
    n = F.size(codes).cast("double")
    parts = F.when(n < 48, 4).when(n < 96, 8).otherwise(16)
    chi = let(parts, lambda m: let(
        F.aggregate(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.size(F.filter(codes, lambda c: F.floor(c * m / size) == j)).cast("double")), F.lit(0.0), lambda a, o: a + o * o) * m / n - n,
        lambda x: let(m - 1.0, lambda k: _tail((F.pow(x / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))),
    ))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.size(F.filter(codes, lambda c: c * 2 >= size)).cast("double")
    turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= size) != (p["b"] * 2 >= size))) + 1.0
    runs = let(F.struct(high.alias("h"), turns.alias("r")), lambda s: let(
        2 * s["h"] * (n - s["h"]), lambda x: F.when(x < 2 * n, 0.0).otherwise(2 * _tail(F.abs(s["r"] - x / n - 1) / F.sqrt(x * (x - n) / (n * n * (n - 1)) + 1e-12)))
    ))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
    serial = let(mean, lambda m: let(
        F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - m) * (c - m)),
        lambda v: F.when(v == 0, 0.0).otherwise(2 * _tail(F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - m) * (p["b"] - m)) / v) * F.sqrt(n))),
    ))
    return F.least(F.lit(1.0), 3 * F.least(chi, runs, serial))


def randomness(token: Column) -> Column:
    """The p-value of a token under even draws from its inferred alphabet."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "_-", "/+")
    lower = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lower(body)).otherwise(body)
    alphabet = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), ALPHABETS["hex"]).when(body.rlike("^[A-Z2-7]+$"), ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    whole = F.struct(lower.alias("body"), alphabet.alias("alphabet"))
    return let(whole, lambda s: let(F.transform(F.split(s["body"], ""), lambda c: F.call_function("instr", s["alphabet"], c) - 1), lambda codes: let(F.char_length(s["alphabet"]), lambda size: F.when(F.size(codes) < 16, 0.0).otherwise(_p_value(F.filter(codes, lambda c: c >= 0), size)))))


def _class(length: Column) -> Column:
    out = F.lit(0)
    for top in LENGTHS:
        out = out + (length > top).cast("int")
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS)).cast("int")


def _threshold(counted: DataFrame) -> dict[int, int]:
    """By length class, the least bin whose strings are rejected; at most five rows of counts come to the driver for each of BINS steps."""
    found: dict[int, list[tuple[int, int]]] = {}
    for r in counted.collect():  # at most (len(LENGTHS) + 1) * (BINS + 1) rows
        found.setdefault(r["class"], []).append((r["bin"], r["n"]))
    out = {}
    for c, rows in found.items():
        total, below = sum(n for _, n in rows), 0
        for b, n in sorted(rows, reverse=True):
            below += n
            if 10 ** (-b / STEPS) <= FDR * below / total:
                out[c] = b
    return out


def _scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns of keep), base and spans."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 6)
    base = F.array_sort(F.concat(spans(assign, 0), spans(matches(text, ACCESS), 1), spans(matches(text, HEX), 2)))
    tokens = F.filter(matches(text, RUN), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    out = docs.select(F.struct(*keep).alias("row"), base.alias("base"), tokens.alias("runs"))
    alone = F.filter("runs", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    out = out.withColumn("runs", F.transform(alone, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _class(m["end"] - m["start"]).alias("class"), _bin(randomness(m["value"])).alias("bin"))))
    out = saved(out)
    counted = out.select(F.explode("runs").alias("r")).groupBy(F.col("r.class").alias("class"), F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"))
    rejected = _threshold(counted)
    kept = F.filter("runs", lambda m: F.coalesce(*[F.when(m["class"] == c, m["bin"] < b) for c, b in rejected.items()], F.lit(True)))
    extra = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return out.select("row", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all unless told) of docs(text, ...), then base and spans: array<struct<start, kind, end>> by start, kind as listed in KINDS; these two replace columns of their names."""
    keep = docs.columns if keep is None else keep
    out = _scanned(docs, keep)
    return out.select(*(F.col("row")[c].alias(c) for c in keep if c.lower() not in ("base", "spans")), "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all its columns, with every span of text replaced by mark; overlapping spans become one."""
    found = _scanned(docs, docs.columns).withColumn("text", F.col("row")["text"])

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", begin, step)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(done, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.char_length("text") - d["at"]))))
    return found.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def battery(tokens: list[str]) -> list[bool]:
    """Which of a few tokens the battery and the false-discovery step call random, written out plainly, for tests."""
    import math

    def tail(z: float) -> float:
        return 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.07056 * z**3)))

    def p_value(token: str) -> float:
        body = token.rstrip("=").replace("_", "/").replace("-", "+")
        if all(c in "0123456789abcdef" for c in body) or all(c in "0123456789ABCDEF" for c in body):
            body, alphabet = body.lower(), ALPHABETS["hex"]
        else:
            alphabet = ALPHABETS["base32" if all(c in ALPHABETS["base32"] for c in body) else "base64"]
        codes, size = [alphabet.index(c) for c in body if c in alphabet], len(alphabet)
        n = len(codes)
        if len(body) < 16:
            return 0.0
        m = 4 if n < 48 else 8 if n < 96 else 16
        chi = sum(sum(c * m // size == j for c in codes) ** 2 for j in range(m)) * m / n - n
        k = m - 1
        first = tail(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
        high = [2 * c >= size for c in codes]
        x = 2 * sum(high) * (n - sum(high))
        turns = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        second = 0.0 if x < 2 * n else 2 * tail(abs(turns - x / n - 1) / math.sqrt(x * (x - n) / (n * n * (n - 1)) + 1e-12))
        mean = sum(codes) / n
        v = sum((c - mean) ** 2 for c in codes)
        third = 0.0 if v == 0 else 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / v) * math.sqrt(n))
        return min(1.0, 3 * min(first, second, third))

    bins = [min(BINS, math.floor(-math.log10(max(p_value(t), 1e-300)) * STEPS)) for t in tokens]
    classes = [sum(len(t) > top for top in LENGTHS) for t in tokens]
    out = []
    for b, c in zip(bins, classes, strict=True):
        mine = [y for x, y in zip(classes, bins, strict=True) if x == c]
        passing = [y for y in set(mine) if 10 ** (-y / STEPS) <= FDR * sum(z >= y for z in mine) / len(mine)]
        out.append(not passing or b < min(passing))
    return out


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """The base spans (start, kind, end) of a text by definition, for tests."""
    import re

    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
