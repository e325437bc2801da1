"""Queries by name, and the SQL that gives the same rows.

Most are statements of the dialect over the shared tables; the rest call operators.  Every
query works on whole tables.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import registry as R
from ..operators import fts, kv, observe, replication, subdoc, transactions
from ..sources import changelog
from ..streaming import changes

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, KEYS)


def statement(name: str, text: str, oracle: str | None, params: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(text, params)
    if oracle:
        ORACLES[name] = oracle


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------- statements and clauses

FLAGSHIP = """
    SELECT n.n_name AS nation, o.o_orderstatus AS status, COUNT(*) AS cnt, ROUND(SUM(o.o_totalprice), 0) AS total
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_totalprice > 1000 GROUP BY n.n_name, o.o_orderstatus HAVING cnt > 1
    ORDER BY cnt DESC, nation, status"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(FLAGSHIP)


statement("flagship", FLAGSHIP, """SELECT n_name AS nation, o_orderstatus AS status, count(*) AS cnt, floor(sum(o_totalprice) + 0.5) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1, 2 HAVING count(*) > 1""")
statement("select_where_order_limit", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 5000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
    "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 5000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
statement("select_without_from", "SELECT 1 AS one, 'x' AS s, 2.5 AS f, TRUE AS t", "SELECT 1::INTEGER AS one, 'x' AS s, 2.5::DOUBLE AS f, true AS t")


@query("SELECT n_nationkey::VARCHAR AS _key, n_nationkey, n_name, n_regionkey FROM nation")
def select_star_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("SELECT * FROM nation").select("_key", "doc.*")


statement("meta_key", "SELECT META().id AS id, c_name AS name FROM customer WHERE META().id = '7' OR META().id LIKE '1_'", "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_custkey::VARCHAR = '7' OR c_custkey::VARCHAR LIKE '1_'")
statement("predicates_mix", """SELECT p_partkey, p_brand FROM part WHERE (p_size BETWEEN 5 AND 20 OR p_size IN (40, 45)) AND p_brand != 'Brand#11'
    AND NOT p_type LIKE '%TIN' AND p_retailprice <> 0 AND p_name LIKE '%a%'""", """SELECT p_partkey, p_brand FROM part WHERE (p_size BETWEEN 5 AND 20 OR p_size IN (40, 45)) AND p_brand <> 'Brand#11'
    AND p_type NOT LIKE '%TIN' AND p_retailprice <> 0 AND p_name LIKE '%a%'""")
statement("not_in_between_list", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_size NOT BETWEEN 20 AND 40 AND p_brand NOT LIKE '%3'", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_size NOT BETWEEN 20 AND 40 AND p_brand NOT LIKE '%3'")
statement("column_to_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey * 2 AND l_quantity >= l_linenumber + 45", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey * 2 AND l_quantity >= l_linenumber + 45")
statement("is_null_checks", "SELECT c.c_custkey AS c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL AND c.c_name IS NOT NULL AND missing_field IS NULL",
    "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL AND c_name IS NOT NULL")
statement("in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
statement("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL)")
statement("exists_subquery", "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey > 3) AND NOT EXISTS (SELECT n_name FROM nation WHERE n_regionkey > 1000)", "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey > 3)")
statement("scalar_subquery", "SELECT r_regionkey, (SELECT MAX(n_nationkey) AS m FROM nation) AS top FROM region", "SELECT r_regionkey, (SELECT max(n_nationkey) FROM nation) AS top FROM region")
statement("parameters", "SELECT s_suppkey FROM supplier WHERE s_acctbal > $low AND s_name != $name", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 500.5", {"low": 500.5, "name": "x' OR 1=1"})
statement("inner_join", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
statement("left_join", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
statement("key_join", "SELECT n.n_name AS n, r.r_name AS r FROM nation n JOIN region r ON TOSTRING(n.n_regionkey) = META(r).id", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
statement("join_chain", "SELECT DISTINCT r.r_name AS region, c.c_mktsegment AS segment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey ORDER BY region, segment LIMIT 20 OFFSET 2",
    "SELECT DISTINCT r_name AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY region, segment LIMIT 20 OFFSET 2")


def _nest(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = engine(spark, sf_dir).query(f"SELECT r.r_regionkey AS k, n FROM region r {kind} nation n ON r.r_regionkey + 2 = n.n_regionkey")
        return rows.select("k", F.to_json(F.array_sort(F.transform("n", lambda x: x["n_name"]))).alias("names"))

    return run


QUERIES |= {"nest": _nest("NEST"), "left_nest": _nest("LEFT NEST")}
for _name, _how in (("nest", ""), ("left_nest", "LEFT")):
    ORACLES[_name] = f"SELECT r_regionkey AS k, x.names FROM region {_how} JOIN (SELECT n_regionkey AS k, to_json(list_sort(list(n_name)))::VARCHAR AS names FROM nation GROUP BY 1) x ON x.k = r_regionkey + 2"


def _unnest(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        words = F.split("p_name", " ")
        e.register("part", table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, words).alias("words")), "p_partkey")
        return e.query(f"SELECT p_partkey, w FROM part {kind} words AS w")

    return run


QUERIES |= {"unnest": _unnest("UNNEST"), "left_unnest": _unnest("LEFT UNNEST")}
ORACLES["unnest"] = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 10"
ORACLES["left_unnest"] = ORACLES["unnest"] + " UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size IS NULL OR p_size <= 10"
statement("unnest_array", "SELECT vec_id, v FROM embeddings UNNEST embedding AS v WHERE label = 1", "SELECT vec_id, v FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings WHERE label = 1)")

statement("agg_global", "SELECT COUNT(*) AS n, COUNT(1) AS n1, COUNT(l_tax) AS nt, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d, MIN(l_shipdate) AS first, MAX(l_extendedprice) AS top FROM lineitem",
    "SELECT count(*) AS n, count(*) AS n1, count(l_tax) AS nt, floor(sum(l_quantity) * 100 + 0.5) / 100 AS q, floor(avg(l_discount) * 1000000 + 0.5) / 1000000 AS d, min(l_shipdate) AS first, max(l_extendedprice) AS top FROM lineitem")
statement("agg_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, SUM(l_returnflag) AS words FROM lineitem WHERE l_quantity < 0", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a, NULL::DOUBLE AS lo, 0.0::DOUBLE AS words")
statement("agg_of_function", "SELECT l_returnflag, ROUND(SUM(ABS(l_quantity - 25)), 2) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, floor(sum(abs(l_quantity - 25)) * 100 + 0.5) / 100 AS s FROM lineitem GROUP BY 1")
statement("group_having", "SELECT o_orderstatus, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 0) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING cnt > 10 ORDER BY cnt DESC LIMIT 5",
    "SELECT o_orderstatus, count(*) AS cnt, floor(sum(o_totalprice) + 0.5) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10 ORDER BY cnt DESC LIMIT 5")
statement("group_columns_added", "SELECT COUNT(*) AS cnt FROM events GROUP BY event_type, user_id HAVING COUNT(*) > 1", "SELECT event_type, user_id, count(*) AS cnt FROM events GROUP BY 1, 2 HAVING count(*) > 1")
statement("group_join", "SELECT c.c_mktsegment AS segment, COUNT(o.o_orderkey) AS n, MAX(o.o_totalprice) AS top FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", "SELECT c_mktsegment AS segment, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
statement("order_by_aggregate", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY COUNT(*) DESC, l_suppkey LIMIT 10", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
statement("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


def _nullable(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.register("c", table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal")), "c_custkey")
    return e


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 200")
def order_nulls_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nullable(spark, sf_dir).query("SELECT c_custkey, bal FROM c ORDER BY bal DESC, c_custkey LIMIT 200")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal NULLS LAST, c_custkey LIMIT 200")
def order_nulls_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nullable(spark, sf_dir).query("SELECT c_custkey, bal FROM c ORDER BY bal, c_custkey LIMIT 200")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 4 AS kind FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("events", table(spark, sf_dir, "events").withColumn("p", F.try_parse_json("props")), "event_id")
    return e.query("SELECT event_id, p.k AS k, user_id % 4 AS kind FROM events WHERE p.k > 50").select("event_id", F.try_variant_get("k", "$", "bigint").alias("k"), "kind")


# --------------------------------------------------------------------- functions

_R2 = "sign({0}) * floor(abs({0}) * 100 + 0.5) / 100"
statement("fn_string", """SELECT p_partkey, LOWER(p_name) AS lo, UPPER(p_brand) AS up, LENGTH(p_type) AS len, TRIM(CONCAT('  ', p_name, ' ')) AS tr, LTRIM(' x') AS lt, RTRIM('x ') AS rt, SUBSTR(p_name, 1, 3) AS sub,
    SUBSTRING(p_name, 2) AS tail, CONCAT(p_brand, '-', p_size) AS cat, CONTAINS(p_name, 'a') AS has, REPLACE(p_name, 'a', 'o') AS rep, ARRAY_LENGTH(SPLIT(p_name, ' ')) AS words, REPEAT(p_brand, 2) AS rp, REVERSE(p_name) AS rev, POSITION(p_name, 'e') AS pos FROM part""",
    """SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, strlen(p_type)::BIGINT AS len, trim('  ' || p_name || ' ') AS tr, 'x' AS lt, 'x' AS rt, substr(p_name, 2, 3) AS sub,
    substr(p_name, 3) AS tail, p_brand || '-' || p_size AS cat, contains(p_name, 'a') AS has, replace(p_name, 'a', 'o') AS rep, len(string_split(p_name, ' '))::INTEGER AS words, repeat(p_brand, 2) AS rp, reverse(p_name) AS rev, (instr(p_name, 'e') - 1)::INTEGER AS pos FROM part""")
statement("fn_math", """SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, ROUND(c_acctbal, 1) AS r, ROUND(c_acctbal) AS r0, TRUNC(c_acctbal, 1) AS t, POWER(c_nationkey, 2) AS p, ROUND(SQRT(c_custkey), 6) AS s, SIGN(c_acctbal) AS g,
    ROUND(PI(), 6) AS pi, ROUND(E(), 6) AS e, ROUND(DEGREES(c_nationkey), 4) AS d, ROUND(RADIANS(c_nationkey), 6) AS ra, SQRT(-1) AS bad, POWER(0, -1) AS inf FROM customer""",
    """SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, sign(c_acctbal) * floor(abs(c_acctbal * 10) + 0.5) / 10 AS r, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS r0, trunc(c_acctbal * 10) / 10 AS t,
    power(c_nationkey, 2) AS p, floor(sqrt(c_custkey) * 1000000 + 0.5) / 1000000 AS s, sign(c_acctbal)::INTEGER AS g, floor(pi() * 1000000 + 0.5) / 1000000 AS pi, floor(exp(1) * 1000000 + 0.5) / 1000000 AS e,
    floor(degrees(c_nationkey) * 10000 + 0.5) / 10000 AS d, floor(radians(c_nationkey) * 1000000 + 0.5) / 1000000 AS ra, NULL::DOUBLE AS bad, NULL::DOUBLE AS inf FROM customer""")
statement("fn_types", """SELECT o_orderkey, TOSTRING(o_orderkey) AS s, TONUMBER(o_orderpriority) AS n, TONUMBER('12.5') AS m, TOBOOLEAN(o_orderstatus) AS b, TOBOOLEAN(0) AS z, ARRAY_LENGTH(TOARRAY(o_orderkey)) AS arr, TYPE(o_orderstatus) AS t1, TYPENAME(o_totalprice) AS t2, TYPE(nothing) AS t3,
    ISSTRING(o_orderstatus) AS i1, ISNUMBER(o_orderstatus) AS i2, ISBOOLEAN(TRUE) AS i3, ISARRAY([1]) AS i4, ISOBJECT({"a": 1}) AS i5, ISNULL(nothing) AS i6, TOSTRING(nothing) AS ns FROM orders""",
    """SELECT o_orderkey, o_orderkey::VARCHAR AS s, NULL::DOUBLE AS n, 12.5::DOUBLE AS m, o_orderstatus NOT IN ('', 'false', '0') AS b, false AS z, 1::INTEGER AS arr, 'string' AS t1, 'number' AS t2, 'null' AS t3, true AS i1, false AS i2, true AS i3, true AS i4, true AS i5, true AS i6, 'null' AS ns FROM orders""")


@query("""SELECT vec_id, len(a)::INTEGER AS n, to_json(list_sort(a))::VARCHAR AS srt, list_min(a) AS lo, list_max(a) AS hi, list_sum(a)::DOUBLE AS s, list_avg(a)::DOUBLE AS av, len(list_distinct(a))::INTEGER AS d, list_contains(a, 3) AS has,
    to_json(list_reverse(a))::VARCHAR AS rev, to_json(list_append(a, 9))::VARCHAR AS ap, to_json(list_prepend(8, a))::VARCHAR AS pre, to_json(list_concat(a, a))::VARCHAR AS cat, to_json(a)::VARCHAR AS flat, len(a)::INTEGER AS cnt
    FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: floor(x * 10)::INTEGER) AS a FROM embeddings)""")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("v", table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x * F.lit(10).cast("float")).cast("int")).alias("a")).withColumn("nested", F.array("a")), "vec_id")
    out = e.query("""SELECT vec_id, ARRAY_LENGTH(a) AS n, ARRAY_SORT(a) AS srt, ARRAY_MIN(a) AS lo, ARRAY_MAX(a) AS hi, ARRAY_SUM(a) AS s, ARRAY_AVG(a) AS av, ARRAY_LENGTH(ARRAY_DISTINCT(a)) AS d, ARRAY_CONTAINS(a, 3) AS has,
        ARRAY_REVERSE(a) AS rev, ARRAY_APPEND(a, 9) AS ap, ARRAY_PREPEND(8, a) AS pre, ARRAY_CONCAT(a, a) AS cat, ARRAY_FLATTEN(nested) AS flat, ARRAY_COUNT(a) AS cnt FROM v""")
    return out.withColumns({c: F.to_json(c) for c in ("srt", "rev", "ap", "pre", "cat", "flat")})


statement("fn_date", """SELECT event_id, STR_TO_MILLIS(ts) AS ms, DATE_DIFF_STR(ts, '2024-01-01T00:00:00Z', 'hour') AS h, DATE_DIFF_STR('2024-01-01T00:00:00Z', ts) AS d, STR_TO_MILLIS(MILLIS_TO_STR(1700000000123)) AS back, STR_TO_MILLIS('nonsense') AS bad FROM events""",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0)::BIGINT AS h, trunc((epoch_us(TIMESTAMP '2024-01-01') - epoch_us(ts)) / 86400000000.0)::BIGINT AS d, 1700000000123::BIGINT AS back, NULL::BIGINT AS bad FROM events""")


@query("""SELECT n_nationkey, 2::INTEGER AS len, '["name","region"]' AS ks, to_json([n_name, n_regionkey::VARCHAR])::VARCHAR AS vs, 3::INTEGER AS added, '["name"]' AS rest, n_name AS got FROM nation""")
def fn_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("n", table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("o")), "n_nationkey")
    out = e.query("SELECT n_nationkey, OBJECT_LENGTH(o) AS len, OBJECT_KEYS(o) AS ks, OBJECT_VALUES(o) AS vs, OBJECT_LENGTH(OBJECT_ADD(o, 'x', 1)) AS added, OBJECT_KEYS(OBJECT_REMOVE(o, 'region')) AS rest, o.name AS got FROM n")
    return out.withColumns({c: F.to_json(c) for c in ("ks", "vs", "rest")})


statement("fn_conditional", """SELECT o_orderkey, IFNULL(NULL, o_orderstatus) AS a, IFMISSING(nothing, 'm') AS b, COALESCE(nothing, NULL, o_orderkey) AS c, NVL(o_orderpriority, 'x') AS d, NULLIF(o_orderstatus, 'F') AS e, LEAST(o_orderkey, 100) AS f, GREATEST(o_custkey, 100) AS g,
    CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS h FROM orders""",
    """SELECT o_orderkey, o_orderstatus AS a, 'm' AS b, o_orderkey AS c, coalesce(o_orderpriority, 'x') AS d, nullif(o_orderstatus, 'F') AS e, least(o_orderkey, 100) AS f, greatest(o_custkey, 100) AS g, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS h FROM orders""")


@query("SELECT n_nationkey, true AS r, true AS u, true AS m, true AS s FROM nation")
def fn_nondeterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).query("SELECT n_nationkey, RANDOM() AS r, UUID() AS u, NOW_MILLIS() AS m, NOW_UTC() AS t, NOW_STR('%Y') AS y FROM nation")
    return out.select("n_nationkey", F.col("r").between(0, 1).alias("r"), (F.length("u") == 36).alias("u"), (F.col("m") > 1600000000000).alias("m"), (F.substring("t", 1, 4) == F.col("y")).alias("s"))


# -------------------------------------------------------------- full-text search

_PLAIN = "regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in fts.STOP_WORDS)


def _tokens_sql(source: str, key: str, text: str, field: str) -> str:
    return f"""SELECT {key}::VARCHAR AS key, '{field}' AS field, list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_\\-'']+'), lambda x: lower({_PLAIN})), lambda t: strlen(t) >= 2 AND t NOT IN ({_STOP})) AS ts FROM {source}"""


_CORPUS = f"""WITH base AS ({_tokens_sql('conversations', "conv_id || '-' || turn", 'text', 'text')} UNION ALL {_tokens_sql('conversations', "conv_id || '-' || turn", 'role', 'role')}),
 toks AS (SELECT key, field, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM base),
 stats AS (SELECT field, avg(len(ts)) AS avgdl FROM base GROUP BY 1), n AS (SELECT count(DISTINCT key) AS n FROM base),
 tf AS (SELECT field, term, key, count(*) AS tf FROM toks GROUP BY 1, 2, 3), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
 scored AS (SELECT field, term, tf.key, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avgdl)) AS score
   FROM tf JOIN df USING (field, term) JOIN base USING (field, key) JOIN stats USING (field), n)"""


_BUILT: dict[tuple[str, str], fts.Index] = {}


def conversations_index(spark: SparkSession, sf_dir: str) -> fts.Index:
    """Built and stored by the first query of an application that asks for it."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _BUILT:
        rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
        _BUILT[at] = fts.build(rows, "id", ["text", "role"], numeric=("turn",)).stored()
    return _BUILT[at]


def search(name: str, tree: dict, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fts.Search(conversations_index(spark, sf_dir)).run(tree)
        return found.select("key", F.round("score", 6).alias("score"))

    QUERIES[name] = run
    ORACLES[name] = _CORPUS + oracle


def _hits(cond: str, more: str = "", factor: str = "") -> str:
    return f" SELECT key, round(sum(score){factor}, 6) AS score FROM scored WHERE {cond} GROUP BY key {more}"


search("fts_match_or", {"type": "match", "field": "text", "text": "What with thing"}, _hits("field = 'text' AND term IN ('what', 'thing')"))
search("fts_match_and", {"type": "match", "field": "text", "text": "ing er", "operator": "and"}, _hits("field = 'text' AND term IN ('ing', 'er')", "HAVING count(*) = 2"))
search("fts_term", {"type": "term", "field": "role", "term": "user"}, _hits("field = 'role' AND term = 'user'"))
search("fts_prefix", {"type": "prefix", "field": "text", "prefix": "THER"}, _hits("field = 'text' AND starts_with(term, 'ther')"))
search("fts_wildcard", {"type": "wildcard", "field": "text", "pattern": "th?r*"}, _hits("field = 'text' AND regexp_full_match(term, 'th.r.*')"))
search("fts_regexp", {"type": "regexp", "field": "text", "pattern": "(the|er)ing"}, _hits("field = 'text' AND regexp_full_match(term, '(the|er)ing')"))
search("fts_fuzzy", {"type": "match", "field": "text", "text": "thing", "fuzziness": 1}, _hits("field = 'text' AND levenshtein(term, 'thing') <= 1"))
search("fts_match_all", {"type": "match_all"}, " SELECT DISTINCT key, 1.0::DOUBLE AS score FROM base")
search("fts_match_none", {"type": "match_none"}, " SELECT DISTINCT key, 1.0::DOUBLE AS score FROM base WHERE false")
search("fts_numeric_range", {"type": "numeric_range", "field": "turn", "min": 1, "max": 3, "inclusive_max": False}, " SELECT conv_id || '-' || turn AS key, 1.0::DOUBLE AS score FROM conversations WHERE turn >= 1 AND turn < 3")
search("fts_all_fields", {"type": "match", "field": "_all", "text": "user thing"}, _hits("term IN ('user', 'thing')"))
search("fts_phrase", {"type": "match_phrase", "field": "text", "text": "ing er"}, """, hit AS (SELECT DISTINCT a.key FROM toks a JOIN toks b ON a.key = b.key AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.field = 'text' AND a.term = 'ing' AND b.term = 'er')""" + _hits("field = 'text' AND term IN ('ing', 'er') AND key IN (SELECT key FROM hit)", factor=" * 1.5"))
search("fts_bool", {"type": "bool", "must": [{"type": "term", "field": "role", "term": "user"}], "should": [{"type": "match", "field": "text", "text": "thing"}], "must_not": [{"type": "match", "field": "text", "text": "er"}]},
    _hits("((field = 'role' AND term = 'user') OR (field = 'text' AND term = 'thing' AND key IN (SELECT key FROM scored WHERE field = 'role' AND term = 'user'))) AND key NOT IN (SELECT key FROM scored WHERE field = 'text' AND term = 'er')"))


@query(_CORPUS + " SELECT field, count(*) AS docs, round(avg(len(ts)), 6) AS avgdl FROM base GROUP BY 1")
def fts_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_index(spark, sf_dir).field_stats().select("field", "docs", F.round("avgdl", 6).alias("avgdl"))


@query("""SELECT item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS ws, len(regexp_extract_all(text, '\\p{L}+'))::INTEGER AS simple, 1::INTEGER AS keyword FROM benchmark""")
def fts_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda k: F.size(fts.Analyzer(k).tokens(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", size("whitespace").alias("ws"), size("simple").alias("simple"), size("keyword").alias("keyword"))


@query(_CORPUS + ", hit AS (SELECT key, sum(score) AS s FROM scored WHERE field = 'text' AND term = 'thing' GROUP BY 1) SELECT key, round(s, 6) AS score FROM hit ORDER BY s DESC, key LIMIT 10 OFFSET 2")
def fts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fts.Search(conversations_index(spark, sf_dir)).top({"query": {"type": "match", "field": "text", "text": "thing"}, "size": 10, "from": 2})
    return found.select("key", F.round("score", 6).alias("score"))


@query(_CORPUS.replace("FROM conversations UNION", "FROM conversations WHERE turn > 0 UNION").replace("FROM conversations),", "FROM conversations WHERE turn > 0),", 1) + _hits("field = 'text' AND term = 'thing'"))
def fts_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns leave the index and come in again as others' texts would: they are put and removed."""
    index = conversations_index(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").filter("turn = 0").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    put = fts.update(index, first.withColumn("text", F.lit("some thing else")), "id")
    now = fts.update(put, first.limit(0), "id", first.select(F.col("id").alias("key")))
    return fts.Search(now).run({"type": "match", "field": "text", "text": "thing"}).select("key", F.round("score", 6).alias("score"))


@query()
def fts_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fts.Search(conversations_index(spark, sf_dir)).top({"query": {"type": "match", "field": "text", "text": "thing"}, "highlight": True, "fields": ["role"]})
    return found.select("key", "role", F.array_join("fragments", " | ").alias("fragments"))


# ------------------------------------------- mutations, keys, sub-documents, CAS


def _after(text: str, columns: str, bucket: str = "customer") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.query(text)
        return e.query(f"SELECT {columns} FROM {bucket}")

    return run


_C = "c_custkey, c_name, c_acctbal, c_mktsegment"
QUERIES["dml_insert"] = _after('INSERT INTO customer (KEY, VALUE) VALUES ("1", {"c_name": "new", "c_acctbal": 1.5, "c_mktsegment": "X"}), ("99999999", {"c_name": "more", "c_acctbal": 2.5, "c_mktsegment": "Y"})', _C)
ORACLES["dml_insert"] = f"SELECT {_C} FROM customer WHERE c_custkey <> 1 UNION ALL SELECT 1, 'new', 1.5, 'X' UNION ALL SELECT 99999999, 'more', 2.5, 'Y'"
QUERIES["dml_update"] = _after("UPDATE customer SET c_acctbal = c_acctbal + 10, c_name = CONCAT(c_name, '!') WHERE c_mktsegment = 'BUILDING'", _C)
ORACLES["dml_update"] = "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"
QUERIES["dml_unset"] = _after("UPDATE customer UNSET c_name WHERE c_custkey > 100", "c_custkey, c_name")
ORACLES["dml_unset"] = "SELECT c_custkey, CASE WHEN c_custkey > 100 THEN NULL ELSE c_name END AS c_name FROM customer"
QUERIES["dml_delete"] = _after("DELETE FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'", _C)
ORACLES["dml_delete"] = f"SELECT {_C} FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY')"
statement("dml_returning", "DELETE FROM customer WHERE c_acctbal < 0 RETURNING c_custkey, META().id AS id", "SELECT c_custkey, c_custkey::VARCHAR AS id FROM customer WHERE c_acctbal < 0")



NOW = _dt.datetime(2024, 6, 1)
CLOCK = kv.Clock(NOW, 1)


def documents_of(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return kv.documents(df, CLOCK, key, value)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: numbers as values, and an expiry for each tenth."""
    df = table(spark, sf_dir, "customer")
    docs = documents_of(df, F.col("c_custkey"), F.col("c_nationkey").cast("string"))
    return docs.withColumn("expiry", F.when(F.col("key").cast("long") % 10 == 0, F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp")))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 0 THEN greatest(0, c_nationkey - 5)::VARCHAR ELSE c_nationkey::VARCHAR END AS value, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 0 THEN 2 ELSE 1 END::BIGINT AS rev FROM customer")
def kv_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _customers(spark, sf_dir)
    return kv.counter(state, state.filter(F.col("key").cast("long") % 3 == 0).select("key"), -5, CLOCK).select("key", "value", F.col("rev_id").alias("rev"))


@query("SELECT c_custkey::VARCHAR AS key, to_json(c_name || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '' END)::VARCHAR AS value FROM customer")
def kv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = documents_of(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit('"')))
    return kv.append(state, state.filter(F.col("key").cast("long") % 2 == 0).select("key"), "+", CLOCK).select("key", "value")


@query("SELECT count(*) FILTER (WHERE c_custkey % 10 <> 0) AS live, count(*) FILTER (WHERE c_custkey % 10 = 0) AS purged FROM customer")
def kv_touch_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = kv.purge_expired(_customers(spark, sf_dir), CLOCK)
    return state.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("purged"))


@query("SELECT count(*) AS documents, sum(strlen(c_custkey::VARCHAR) + strlen(c_nationkey::VARCHAR) + 128)::BIGINT AS bytes FROM customer WHERE c_custkey % 10 <> 0")
def kv_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.stats(_customers(spark, sf_dir), now=CLOCK.time)


@query()
def vbucket_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.stats(_customers(spark, sf_dir), by_vbucket=True, now=CLOCK.time)


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_nationkey::VARCHAR END AS value, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS rev FROM customer UNION ALL SELECT 'extra', 'new', 1")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _customers(spark, sf_dir)
    batch = state.filter(F.col("key").cast("long") % 4 == 0).select("key").union(spark.createDataFrame([("extra",)], "key string")).withColumn("value", F.lit("new"))
    return kv.upsert(state, batch, CLOCK).select("key", "value", F.col("rev_id").alias("rev"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 4 = 0 THEN 'third' ELSE c_nationkey::VARCHAR END AS value, CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 1 END::BIGINT AS rev FROM customer")
def kv_upsert_repeated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes of a key in one batch: the last one counts."""
    state = _customers(spark, sf_dir)
    values = F.explode(F.array(F.lit("first"), F.lit("second"), F.lit("third")))
    batch = state.filter(F.col("key").cast("long") % 4 == 0).select("key", values.alias("value"))
    return kv.upsert(state, batch, CLOCK).select("key", "value", F.col("rev_id").alias("rev"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_nationkey::VARCHAR END AS value, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS rev FROM customer WHERE c_custkey % 5 <> 0")
def kv_replace_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace documents that are there, by CAS, then delete others."""
    state = _customers(spark, sf_dir)
    some = state.filter(F.col("key").cast("long") % 4 == 0).filter(F.col("key").cast("long") % 5 != 0)
    now = kv.replace(state, some.select("key", F.lit("new").alias("value")), CLOCK)
    now = kv.delete(now, state.filter(F.col("key").cast("long") % 5 == 0).filter(F.col("key").cast("long") % 10 != 0).select("key"), CLOCK)
    return kv.live(now, CLOCK.time).select("key", "value", F.col("rev_id").alias("rev"))


@query("SELECT event_id::VARCHAR AS key, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') IS NOT NULL AS has, json_extract_string(props, '$.none') IS NOT NULL AS none FROM events")
def subdoc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("key", F.col("event_id").cast("string"))
    return subdoc.multi_lookup(df, "props", ["k", "none"]).select("key", "k", F.col("`k?`").alias("has"), F.col("`none?`").alias("none"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k, event_type AS deep, user_id AS u FROM events""")
def subdoc_mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("v", F.from_json("props", "k bigint, old string"))
    t = df.schema["v"].dataType
    v = subdoc.put(F.col("v"), t, ["a", "b"], F.col("event_type"))
    v = subdoc.remove(subdoc.put(v, t, ["u"], F.col("user_id")), "old")
    df = df.withColumn("v", v)
    return df.withColumn("v", F.col("v").withField("k", F.col("v.k") + 1)).select("event_id", "v.k", F.col("v.a.b").alias("deep"), "v.u")


@query("SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'insert' ELSE 'replace' END AS op FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def txn_cas_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("cas"))
    n = F.col("key").cast("long")
    staged = live.select("key", F.when(n % 7 == 0, "insert").otherwise("replace").alias("op"), F.when(n % 11 == 0, F.col("cas") + 1).otherwise(F.col("cas")).alias("original_cas"))
    return transactions.conflicts(staged, live).select("key", "op")


# ------------------------------------------ change log, replication, observation


@query("SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return changelog.latest(rows, ("user_id",), "o").select("user_id", "event_id", "value")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS last FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq_no"), "event_type", (F.col("event_type") == "purchase").alias("deleted"))
    return changelog.compact(log).select("key", F.col("event_type").alias("last"))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "events")
    rows = df.select(F.col("user_id").cast("string").alias("key"), "event_id", (F.col("event_id") % 5).alias("rev_id"), F.col("event_id").alias("cas"), F.col("ts").alias("updated_at"))
    pick = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.col("event_id")).alias("r")).select("r.*")
    return pick(0), pick(1)


_SIDES = """WITH l AS (SELECT user_id AS key, max(event_id) AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT user_id AS key, max(event_id) AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1),
 both_ AS (SELECT x.key::VARCHAR AS key, e, e % 5 AS rev, ts FROM (SELECT * FROM l UNION ALL SELECT * FROM r) x JOIN events ON event_id = e)"""


@query(_SIDES + " SELECT key, arg_max(e, row(rev, e)) AS winner FROM both_ GROUP BY 1")
def conflict_seqno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.resolve(*_clusters(spark, sf_dir), "sequence").select("key", F.col("event_id").alias("winner"))


@query(_SIDES + " SELECT key, arg_max(e, row(ts, e)) AS winner FROM both_ GROUP BY 1")
def conflict_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.resolve(*_clusters(spark, sf_dir), "timestamp").select("key", F.col("event_id").alias("winner"))


@query(_SIDES + " SELECT count(*) FILTER (WHERE l.e IS NULL OR row(r.e % 5, r.e) > row(l.e % 5, l.e)) AS accepted, count(*) FILTER (WHERE NOT (l.e IS NULL OR row(r.e % 5, r.e) > row(l.e % 5, l.e))) AS rejected, count(l.e) AS conflicts FROM r LEFT JOIN l USING (key)")
def replication_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.statistics(*_clusters(spark, sf_dir), "sequence")


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("source", F.when(F.col("user_id") % 3 == 0, "west"))
    docs = df.select(F.concat(F.col("event_type"), F.lit("-"), F.col("event_id")).alias("key"), F.lit("_default").alias("scope"), F.lit("_default").alias("collection"), F.col("props").alias("value"), F.col("event_id").alias("cas"), F.col("event_id").alias("seq_no"), F.col("source").alias("source_cluster"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("expiry"), F.col("ts").cast("timestamp").alias("updated_at"), F.lit(0).cast("bigint").alias("flags"))
    return docs.withColumn("vbucket_id", kv.vbucket(F.col("key")))


@query("SELECT event_type || '-' || event_id AS key, coalesce(CASE WHEN user_id % 3 = 0 THEN 'west' END, 'east') AS source FROM events WHERE starts_with(event_type, 'c') AND event_id > 100 AND NOT coalesce(user_id % 3 = 0, false)")
def replication_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = replication.outgoing(_event_documents(spark, sf_dir), "east", "west", "key:c", since=100)
    return sent.select("key", F.col("source_cluster").alias("source"))


@query("SELECT event_type || '-' || event_id AS key FROM events WHERE json_extract_string(props, '$.k') = '42'")
def replication_filter_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_documents(spark, sf_dir).filter(replication.keep("k = 42")).select("key")


@query("SELECT 'mutation' AS event_type, event_type || '-' || event_id AS key, event_id AS seq_no FROM events WHERE event_id > 50")
def change_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.backfill(_event_documents(spark, sf_dir), "events", from_seq_no=50).select("event_type", "key", "seq_no")


@query("SELECT event_id FROM events WHERE event_id > 500")
def mutations_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.mutations_since(_event_documents(spark, sf_dir), 500).select(F.col("seq_no").alias("event_id"))


@query()
def high_seqno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.high_seqno(_event_documents(spark, sf_dir))


@query("SELECT vec_id AS id FROM (SELECT vec_id, sum(400) OVER (ORDER BY label, vec_id) - 400 AS b FROM embeddings) WHERE b < 20000")
def eviction_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(400).alias("bytes"))
    return kv.evict(sizes, 20000, [F.col("label"), F.col("vec_id")]).select(F.col("vec_id").alias("id"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 20 OFFSET 5")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.audit(table(spark, sf_dir, "events"), 20, 5, "click", id_col="event_id", type_col="event_type").select("event_id", "event_type")


@query("SELECT * FROM (SELECT c_custkey::VARCHAR AS _key, count(*) OVER () AS total, count(*) OVER () > 15 AS has_more FROM customer WHERE starts_with(c_custkey::VARCHAR, '1')) ORDER BY _key LIMIT 10 OFFSET 5")
def list_docs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).list_documents("customer", "1", 5, 10).select("_key", "total", "has_more")


@query("SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'with_ttl', count(*)::DOUBLE FROM customer WHERE c_custkey % 10 = 0")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.gauges({"customer": _customers(spark, sf_dir)}).filter(F.col("metric").isin("documents", "with_ttl")).select("metric", "value")


@query("SELECT i::INTEGER AS vbucket_id, ['n1', 'n2', 'n3'][i % 3 + 1] AS owner, ['n1', 'n2', 'n3'][(i + 1) % 3 + 1] AS replica FROM range(1024) t(i)")
def partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.partition_map(spark, ["n1", "n2", "n3"]).select("vbucket_id", "owner", F.get("replicas", F.lit(0)).alias("replica"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus = 'F'")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.query("CREATE INDEX price ON orders(o_totalprice, o_orderstatus) INCLUDE (o_orderkey) WHERE o_orderstatus = 'F'")
    return e.query("SELECT o_orderkey, o_totalprice FROM orders USE INDEX (price) WHERE o_totalprice >= 250000 AND o_orderstatus = 'F'")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#23'")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.query("CREATE INDEX brand ON part(p_brand)")
    return e.query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#23'")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.query("PREPARE by_nation AS SELECT s_suppkey FROM supplier WHERE s_nationkey = $n")
    return e.query('EXECUTE by_nation USING {"n": 3}')


@query()
def explain_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("EXPLAIN SELECT c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name LIMIT 3").select("plan")


@query("SELECT 6 AS rank, 'true' AS v UNION ALL SELECT 2, '3' UNION ALL SELECT 1, '\"a\"' UNION ALL SELECT 5, 'null' UNION ALL SELECT 7, '{\"a\":1}' UNION ALL SELECT 3, '[1]' UNION ALL SELECT 4, 'false'")
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("true", "3", '"a"', "null", '{"a":1}', "[1]", "false")], "v string")
    return rows.select(R.sort_key(F.parse_json("v"))["rank"].alias("rank"), "v")


