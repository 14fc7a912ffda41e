"""Named queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session_for(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session with the tables that the text names."""
    session = Session(spark)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            session.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return session


# name: (dialect, DuckDB); a single text serves both
SQL: dict[str, tuple[str, str] | str] = {
    # scans and filters
    "scan_project": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "scan_key_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77",
    "scan_key_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900",
    "scan_empty": "SELECT o_orderkey FROM orders WHERE 1 = 0",
    "filter_cmp": ("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.05 AND l_quantity >= 30 AND l_returnflag <> 'A'",) * 2,
    "filter_is_null_safe": ("SELECT c_custkey, c_mktsegment IS 'BUILDING' AS same, c_nationkey IS NOT NULL AS known FROM customer", "SELECT c_custkey, CAST(c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AS BIGINT) AS same, CAST(c_nationkey IS NOT NULL AS BIGINT) AS known FROM customer"),
    "filter_in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 13)",
    "filter_not_in_list_null": ("SELECT p_partkey, p_size NOT IN (1, NULL) AS other FROM part", "SELECT p_partkey, CAST(CASE WHEN p_size = 1 THEN 0 END AS BIGINT) AS other FROM part"),
    "filter_mixed_classes": ("SELECT o_orderkey FROM orders WHERE o_orderstatus > 5 AND o_custkey = '7'", "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "truth_test": ("SELECT l_orderkey, l_linenumber, (l_discount > 0.05) IS TRUE AS low, (l_tax - l_tax) IS NOT FALSE AS tax FROM lineitem WHERE l_linenumber - 1", "SELECT l_orderkey, l_linenumber, CAST((l_discount > 0.05) IS TRUE AS BIGINT) AS low, CAST(0 AS BIGINT) AS tax FROM lineitem WHERE l_linenumber <> 1"),
    "select_no_from": ("SELECT 1 AS a, 7 / 2 AS b, -7 % 3 AS c, 'x' || 1 AS d, 1 / 0 AS e", "SELECT CAST(1 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(-1 AS BIGINT) AS c, 'x1' AS d, CAST(NULL AS BIGINT) AS e"),
    "values_rows": ("VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, NULL)) AS t(column1, column2)"),
    "alias_in_where": ("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE twice > 400000", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 400000"),
    # joins
    "join_comma_where": "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 9000",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_inner_equi": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_inner_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_left_on_extra": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal",
    "join_using": ("SELECT * FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "join_full_using_merged": ("SELECT doc_id, n_chars, quality FROM documents FULL JOIN labels USING (doc_id)",) * 2,
    "join_natural": ("SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels",) * 2,
    "join_self": "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
    "join_is_key": ("SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON a.n_nationkey IS b.s_nationkey", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON a.n_nationkey IS NOT DISTINCT FROM b.s_nationkey"),
    "join_forward_on": ("SELECT r_name, n_name, s_name FROM region JOIN nation ON n_nationkey = s_nationkey JOIN supplier ON r_regionkey = n_regionkey", "SELECT r_name, n_name, s_name FROM region, nation, supplier WHERE n_nationkey = s_nationkey AND r_regionkey = n_regionkey"),
    "join_multiway": ("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' GROUP BY n_name", "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' GROUP BY n_name"),
    # aggregates
    "agg_global": ("SELECT count(*) AS n, count(c_name) AS names, sum(c_custkey) AS keys, min(c_acctbal) AS lo, max(c_name) AS hi FROM customer", "SELECT count(*) AS n, count(c_name) AS names, CAST(sum(c_custkey) AS BIGINT) AS keys, min(c_acctbal) AS lo, max(c_name) AS hi FROM customer"),
    "agg_global_empty": ("SELECT count(*) AS n, sum(c_custkey) AS s, avg(c_acctbal) AS a, max(c_name) AS m FROM customer WHERE c_custkey < 0", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s, avg(c_acctbal) AS a, max(c_name) AS m FROM customer WHERE c_custkey < 0"),
    "agg_total_empty": ("SELECT total(c_custkey) AS t FROM customer WHERE c_custkey < 0", "SELECT coalesce(CAST(sum(c_custkey) AS DOUBLE), 0.0::DOUBLE) AS t FROM customer WHERE c_custkey < 0"),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS s, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2"),
    "agg_group_ordinal_alias": ("SELECT o_custkey % 10 AS bucket, o_orderstatus, count(*) AS n FROM orders GROUP BY bucket, 2", "SELECT o_custkey % 10 AS bucket, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(o_custkey) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY o_orderpriority",
    "agg_concat_ordered": ("SELECT n_regionkey, group_concat(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "agg_concat_distinct": ("SELECT c_nationkey, group_concat(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey"),
    "agg_bare_minmax": ("SELECT c_nationkey, max(c_acctbal) AS most, c_custkey FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, max(c_acctbal) AS most, arg_max(c_custkey, c_acctbal) AS c_custkey FROM customer GROUP BY c_nationkey"),
    "agg_nocase_group": ("SELECT count(*) AS n, min(lower(c_mktsegment)) AS segment FROM customer GROUP BY c_mktsegment COLLATE NOCASE", "SELECT count(*) AS n, min(lower(c_mktsegment)) AS segment FROM customer GROUP BY lower(c_mktsegment)"),
    "agg_over_join": ("SELECT n_name, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name",) * 2,
    "agg_total_avg": ("SELECT o_orderstatus, total(o_custkey) AS t, avg(o_custkey) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) AS t, avg(o_custkey) AS a FROM orders GROUP BY o_orderstatus"),
    # columns whose storage class varies by row
    "mixed_filter": ("SELECT o_orderkey FROM orders WHERE iif(o_orderkey % 2, o_custkey, o_orderstatus) > 100", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey > 100 ELSE true END"),
    "mixed_group": ("SELECT iif(o_orderkey % 2, o_custkey, o_orderstatus) || '' AS v, count(*) AS n FROM orders GROUP BY iif(o_orderkey % 2, o_custkey, o_orderstatus)", "SELECT CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS v, count(*) AS n FROM orders GROUP BY 1"),
    "mixed_distinct": ("SELECT o_orderpriority, count(DISTINCT iif(o_orderkey % 3, iif(o_orderkey % 2, o_custkey, o_custkey * 1.0), o_orderstatus)) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END) AS n FROM orders GROUP BY o_orderpriority"),
    "mixed_sum": ("SELECT o_orderstatus, sum(iif(o_orderkey % 2, o_custkey, '2')) || '' AS s, sum(DISTINCT iif(o_orderkey % 2, o_custkey, 0.0)) || '' AS d, total(iif(o_orderkey % 2, o_custkey, '0.5x')) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey ELSE 2 END) AS VARCHAR) AS s, CAST(CAST(sum(DISTINCT CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS VARCHAR) || '.0' AS d, CAST(sum(CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey ELSE 0.5 END) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus"),
    "mixed_minmax": ("SELECT min(iif(o_orderkey % 2, o_custkey, o_orderstatus)) || '' AS lo, max(iif(o_orderkey % 2, o_custkey, o_orderstatus)) || '' AS hi FROM orders", "SELECT CAST(min(CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey END) AS VARCHAR) AS lo, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS hi FROM orders"),
    "mixed_typeof": ("SELECT typeof(iif(o_orderkey % 2, o_custkey, iif(o_orderkey % 3, o_totalprice, o_orderstatus))) AS t, count(*) AS n FROM orders GROUP BY 1", "SELECT CASE WHEN o_orderkey % 2 <> 0 THEN 'integer' WHEN o_orderkey % 3 <> 0 THEN 'real' ELSE 'text' END AS t, count(*) AS n FROM orders GROUP BY 1"),
    "mixed_join": ("SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON iif(a.n_nationkey % 2, a.n_nationkey, a.n_name) = iif(b.s_suppkey % 2, b.s_nationkey * 1.0, 'CHINA')", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a JOIN supplier b ON (a.n_nationkey % 2 <> 0 AND b.s_suppkey % 2 <> 0 AND a.n_nationkey = b.s_nationkey) OR (a.n_nationkey % 2 = 0 AND b.s_suppkey % 2 = 0 AND a.n_name = 'CHINA')"),
    # order and limit
    "order_nulls_default": ("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality, doc_id", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS FIRST, doc_id"),
    "order_nulls_last": ("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id",) * 2,
    "order_hidden_expr": "SELECT o_orderkey FROM orders ORDER BY o_totalprice * -1, o_orderkey",
    "topn_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7, 3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 7"),
    "limit_negative": ("SELECT n_name FROM nation ORDER BY n_name LIMIT -1 OFFSET 3", "SELECT n_name FROM nation ORDER BY n_name OFFSET 3"),
    "limit_far": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3000000000 OFFSET 7",
    "limit_zero": "SELECT n_name FROM nation LIMIT 0",
    # sets
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_nocase": ("SELECT DISTINCT lower(c_mktsegment) COLLATE NOCASE AS segment FROM customer", "SELECT DISTINCT lower(c_mktsegment) AS segment FROM customer"),
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    "compound_left_assoc": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT r_regionkey FROM region", "((SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT r_regionkey FROM region"),
    "compound_order_limit": "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 20",
    # subqueries
    "scalar_uncorrelated_first": ("SELECT o_orderkey, o_totalprice - (SELECT max(o_totalprice) FROM orders) AS below, (SELECT n_name FROM nation ORDER BY n_name) AS first FROM orders", "SELECT o_orderkey, o_totalprice - (SELECT max(o_totalprice) FROM orders) AS below, (SELECT n_name FROM nation ORDER BY n_name LIMIT 1) AS first FROM orders"),
    "scalar_correlated": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer",) * 2,
    "scalar_correlated_range": "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey < n_nationkey) AS below FROM nation",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "exists_projected": ("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer", "SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS buys FROM customer"),
    "outer_aggregate": ("SELECT c_nationkey, (SELECT count(c.c_custkey)) AS n, (SELECT max(n_name) FROM nation WHERE n_nationkey = c.c_nationkey) AS name FROM customer c GROUP BY c_nationkey", "SELECT c_nationkey, count(c_custkey) AS n, (SELECT max(n_name) FROM nation WHERE n_nationkey = c_nationkey) AS name FROM customer GROUP BY c_nationkey"),
    "nested_alias": ("SELECT n_nationkey + 1 AS k, (SELECT k * 2) AS twice FROM nation", "SELECT CAST(n_nationkey AS BIGINT) + 1 AS k, (CAST(n_nationkey AS BIGINT) + 1) * 2 AS twice FROM nation"),
    # names
    "star_qualified": ("SELECT labels.* FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "name_quoted_text": ("SELECT n_nationkey, \"nosuch\" AS word FROM nation", "SELECT n_nationkey, 'nosuch' AS word FROM nation"),
    # scalars
    "fn_literals": ("SELECT 0xff AS h, 1_000 AS u, length(x'0102') AS b, count(*) AS n FROM nation", "SELECT CAST(255 AS BIGINT) AS h, CAST(1000 AS BIGINT) AS u, CAST(2 AS BIGINT) AS b, count(*) AS n FROM nation"),
    "fn_collate_rtrim": ("SELECT c_custkey FROM customer WHERE c_mktsegment || '  ' = 'BUILDING' COLLATE RTRIM", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "fn_arith_edge": ("SELECT l_orderkey, l_linenumber, l_orderkey / (l_linenumber - 1) AS d, l_orderkey % (l_linenumber - 2) AS m, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey // (l_linenumber - 1) END AS d, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey % (l_linenumber - 2) END AS m, -CAST(l_linenumber AS BIGINT) AS neg FROM lineitem"),
    "fn_bitwise_shift": ("SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS o, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 65 AS r FROM orders", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS o, ~o_orderkey AS n, o_orderkey * 4 AS l, CAST(0 AS BIGINT) AS r FROM orders"),
    "fn_text": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n FROM customer",
    "fn_typeof": ("SELECT typeof(c_custkey) AS a, typeof(c_name) AS b, typeof(c_acctbal) AS c, typeof(NULL) AS d, count(*) AS n FROM customer GROUP BY 1, 2, 3, 4", "SELECT 'integer' AS a, 'text' AS b, 'real' AS c, 'null' AS d, count(*) AS n FROM customer"),
    "fn_minmax_scalar": ("SELECT s_suppkey, min(s_suppkey, 40, s_nationkey) AS lo, max(s_suppkey, s_nationkey) AS hi, max(s_suppkey, NULL) AS none FROM supplier", "SELECT s_suppkey, least(s_suppkey, 40, s_nationkey) AS lo, greatest(s_suppkey, s_nationkey) AS hi, CAST(NULL AS BIGINT) AS none FROM supplier"),
    "fn_coalesce_iif_nullif": ("SELECT c_custkey, coalesce(NULL, c_name) AS a, iif(c_acctbal > 0, 'plus', 'minus') AS b, nullif(c_mktsegment, 'BUILDING') AS c, ifnull(NULL, 1) AS d FROM customer", "SELECT c_custkey, c_name AS a, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS b, nullif(c_mktsegment, 'BUILDING') AS c, CAST(1 AS BIGINT) AS d FROM customer"),
    "fn_sign_abs": ("SELECT c_custkey, sign(c_acctbal) AS s, abs(c_acctbal) AS a FROM customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS BIGINT) AS s, abs(c_acctbal) AS a FROM customer"),
    "fn_likelihood": ("SELECT o_orderkey FROM orders WHERE likelihood(o_totalprice > 300000, 0.1) AND likely(o_orderstatus = 'O')", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'"),
    "fn_concat_op": ("SELECT n_nationkey || ':' || n_name AS label, n_name || NULL AS none FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) || ':' || n_name AS label, CAST(NULL AS VARCHAR) AS none FROM nation"),
}

#: Statements before the query, which reads what they leave.
SCRIPTS: dict[str, tuple[list[str], str, str]] = {
    "dml_insert": (["INSERT INTO region VALUES (5, 'ATLANTIS')", "INSERT INTO region(r_name, r_regionkey) VALUES ('LEMURIA', 2 * 3)"], "SELECT r_regionkey, r_name FROM region", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 5::INTEGER, 'ATLANTIS' UNION ALL SELECT 6::INTEGER, 'LEMURIA'"),
    "dml_update": (["UPDATE nation SET n_name = n_name || '!', n_regionkey = 9 WHERE n_regionkey = 1"], "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "dml_default_values": (["CREATE TABLE d(a INTEGER DEFAULT 3, b TEXT DEFAULT 'x')", "INSERT INTO d DEFAULT VALUES", "INSERT INTO d(b) VALUES (7)"], "SELECT rowid AS r, a || '' AS a, typeof(b) AS t FROM d", "SELECT * FROM (VALUES (1::BIGINT, '3', 'text'), (2, '3', 'text')) AS x(r, a, t)"),
    "group_mixed": (["CREATE TABLE m(id INTEGER PRIMARY KEY, value)", "INSERT INTO m VALUES (1, 1)", "INSERT INTO m VALUES (2, 1.0)", "INSERT INTO m VALUES (3, '1')", "INSERT INTO m VALUES (4, x'31')", "INSERT INTO m VALUES (5, NULL)", "INSERT INTO m VALUES (6, 2.0)", "INSERT INTO m VALUES (7, 2)"], "SELECT typeof(value) AS t, count(*) AS n, min(id) AS first FROM m GROUP BY value", "SELECT * FROM (VALUES ('integer', 2::BIGINT, 1::BIGINT), ('text', 1, 3), ('blob', 1, 4), ('null', 1, 5), ('real', 2, 6)) AS x(t, n, first)"),
    "dml_delete": (["DELETE FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (1, 2)"], "SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2))"),
    "txn_rollback": (["BEGIN", "DELETE FROM nation", "ROLLBACK"], "SELECT count(*) AS n FROM nation", "SELECT count(*) AS n FROM nation"),
    "txn_savepoint": (["BEGIN", "DELETE FROM nation WHERE n_regionkey = 0", "SAVEPOINT a", "DELETE FROM nation", "ROLLBACK TO a", "RELEASE a", "COMMIT"], "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "analyze_stat1": (["CREATE INDEX by_segment ON customer(c_mktsegment, c_nationkey)", "ANALYZE customer"], "SELECT tbl, idx, stat FROM sqlite_stat1", "SELECT 'customer' AS tbl, 'by_segment' AS idx, count(*) || ' ' || CAST(ceil(count(*) / count(DISTINCT c_mktsegment)) AS BIGINT) || ' ' || CAST(ceil(count(*) / count(DISTINCT (c_mktsegment, c_nationkey))) AS BIGINT) AS stat FROM customer"),
    "ddl_create_table": (["CREATE TABLE notes(id INTEGER PRIMARY KEY, body TEXT NOT NULL, weight REAL DEFAULT 1.5)", "INSERT INTO notes(body) VALUES ('a')", "INSERT INTO notes(body, weight) VALUES ('b', 2)", "CREATE UNIQUE INDEX u ON notes(body)"], "SELECT id, length(body) AS n, typeof(weight) AS t FROM notes", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'real'), (2, 1, 'real')) AS x(id, n, t)"),
    "schema_table": (["CREATE INDEX i ON nation(n_name)"], "SELECT type, name, tbl_name FROM sqlite_schema", "SELECT * FROM (VALUES ('table', 'nation', 'nation'), ('index', 'i', 'nation')) AS x(type, name, tbl_name)"),
}


def _plain(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session_for(spark, sf_dir, text).sql(text)


def _script(name: str) -> Callable[[SparkSession, str], DataFrame]:
    before, text, _ = SCRIPTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = session_for(spark, sf_dir, " ".join([*before, text]))
        for s in before:
            session.execute(s)
        return session.sql(text)

    return run


def params_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = session_for(spark, sf_dir, "orders")
    return session.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ?1 AND o_orderstatus = :status AND o_orderkey < ?1", 50000, status="O")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2"
    return session_for(spark, sf_dir, text).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _plain(q if isinstance(q, str) else q[0]) for name, q in SQL.items()}
    out |= {name: _script(name) for name in SCRIPTS}
    return out | {"params_bound": params_bound}


def oracle_sql() -> dict[str, str]:
    out = {name: q if isinstance(q, str) else q[1] for name, q in SQL.items()}
    out |= {name: s[2] for name, s in SCRIPTS.items()}
    return out | {"params_bound": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' AND o_orderkey < 50000"}
