"""The analytics tables (logs, films, entities, vectors) derived from the TPC-H-like tables, and other readers."""

from __future__ import annotations

import contextlib
import contextvars
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.work import saved

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Derived tables, in SQL that Spark and DuckDB read alike. Later ones may use earlier ones.
DERIVED = {
    "logs": """SELECT user_id, film_id, rating FROM (
        SELECT o_custkey AS user_id, l_partkey AS film_id,
            CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE CAST(ceil(l_quantity / 5.0) AS DOUBLE) / CAST(2 AS DOUBLE) END AS rating,
            row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t WHERE rn = 1""",
    "raw_logs": """SELECT o_custkey AS user_id, l_partkey AS film_id, CAST(ceil(l_quantity / 5.0) AS DOUBLE) / CAST(2 AS DOUBLE) AS rating,
            CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq, l_suppkey AS source, l_extendedprice AS price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "films": "SELECT p_partkey AS film_id, p_name AS title, CAST(1900 + 2 * p_size AS BIGINT) AS year, CAST(60 + p_size AS BIGINT) AS runtime FROM part",
    "film_country": """SELECT DISTINCT film_id, CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM (
        SELECT l_partkey AS film_id, l_suppkey, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn FROM lineitem) s
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE rn <= 2""",
    "film_entity": """SELECT p_partkey AS film_id, 'director' AS family, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS entity_id, p_brand AS name FROM part
        UNION ALL SELECT p_partkey, 'genre', CAST(instr('ECONOMY LARGE MEDIUM PROMO SMALL STANDARD', p_type) AS BIGINT), p_type FROM part
        UNION ALL SELECT film_id, 'country', entity_id, name FROM film_country
        UNION ALL SELECT DISTINCT film_id, 'language', region, r_name FROM film_country JOIN region ON region = r_regionkey
        UNION ALL SELECT film_id, 'decade', CAST(floor(year / 10.0) * 10 AS BIGINT), concat(CAST(CAST(floor(year / 10.0) * 10 AS BIGINT) AS VARCHAR(8)), 's') FROM films""",
    # Eight families: also the two words of a title as themes, a film's first supplier as studio, and some later ones as actors.
    "film_entity8": """SELECT film_id, family, entity_id, name FROM film_entity
        UNION ALL SELECT p_partkey, 'theme', CAST(ascii(substring(p_name, 1, 1)) * 10000 + ascii(substring(p_name, 2, 1)) * 100 + instr(p_name, ' ') AS BIGINT), substring(p_name, 1, instr(p_name, ' ') - 1) FROM part WHERE instr(p_name, ' ') > 1
        UNION ALL SELECT p_partkey, 'theme', CAST(ascii(substring(p_name, instr(p_name, ' ') + 1, 1)) * 10000 + ascii(substring(p_name, instr(p_name, ' ') + 2, 1)) * 100 + length(p_name) - instr(p_name, ' ') AS BIGINT), substring(p_name, instr(p_name, ' ') + 1) FROM part WHERE instr(p_name, ' ') > 1
        UNION ALL SELECT DISTINCT l_partkey, CASE WHEN rn = 1 THEN 'studio' ELSE 'actor' END, CAST(l_suppkey AS BIGINT), CAST(l_suppkey AS VARCHAR(20)) FROM (
            SELECT l_partkey, l_suppkey, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn FROM lineitem) s WHERE rn = 1 OR rn BETWEEN 3 AND 6""",
    "item_vectors": "SELECT vec_id AS film_id, embedding AS vec FROM embeddings",
}

#: The same rows for Spark in another way. An order's first line of a film is found where the order's lines meet its customer, so that what
#: goes on to the user is a film, a rating and what tells orders apart. The rows of a user lie together, so that counts by user are short.
SPARK = {
    "logs": """SELECT user_id, film_id, rating FROM (
        SELECT user_id, film_id, rating, row_number() OVER (PARTITION BY user_id, film_id ORDER BY l_shipdate, l_orderkey) AS rn FROM (
            SELECT /*+ REPARTITION(user_id) */ * FROM (
                SELECT o_custkey AS user_id, l_partkey AS film_id, rating, l_shipdate, l_orderkey FROM (
                    SELECT l_orderkey, l_partkey, rating, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_extendedprice) AS line FROM (
                        SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_partkey, l_shipdate, l_linenumber, l_suppkey, l_extendedprice,
                            CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE CAST(ceil(l_quantity / 5.0) AS DOUBLE) / CAST(2 AS DOUBLE) END AS rating
                        FROM lineitem)) JOIN orders ON l_orderkey = o_orderkey WHERE line = 1))) WHERE rn = 1""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived table (or a stored one), of the stored tables or those given in their place."""
    if name in given:
        return given[name]
    if name not in DERIVED:
        return read(spark, sf_dir, name)
    sql = SPARK.get(name, DERIVED[name])
    used = [t for t in (*TABLES, *DERIVED) if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    sql = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", sql)
    return spark.sql(sql, **{t: derived(spark, sf_dir, t, **given) for t in used})


#: What the query that runs now has written so far.
_written: contextvars.ContextVar[dict | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def one_query() -> Iterator[None]:
    """Within it, ``kept`` writes a table once."""
    mark = _written.set({})
    try:
        yield
    finally:
        _written.reset(mark)


def kept(spark: SparkSession, sf_dir: str, name: str, make=derived) -> DataFrame:
    """make(spark, sf_dir, name), by default a derived table, written once a query: for queries that read it several times."""
    known = _written.get()
    if known is None:
        return saved(make(spark, sf_dir, name))
    key = (spark.sparkContext.applicationId, sf_dir, name, make)
    if key not in known:
        known[key] = saved(make(spark, sf_dir, name))
    return known[key]


def oracle(sql: str) -> str:
    """sql with the derived tables that it names in front."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in DERIVED.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(body)
                if name not in needed:
                    needed.append(name)

    add(sql)
    heads = ", ".join(f"{n} AS ({DERIVED[n]})" for n in needed)
    if not heads:
        return sql
    body = sql.strip()
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"
